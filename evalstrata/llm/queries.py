"""The queries of this subpackage: thin digests of the operators' results over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .backoff import score_documents
from .common import table
from .decontamination import find_contamination
from .factorisation import score_quality, train
from .license_scan import scan_licenses
from .media import media_clips
from .near_duplicates import near_duplicates
from .piece_codec import encode_pieces
from .pii import PATTERNS, find_pii, listed
from .token_counts import count_tokens
from .web_archives import archived_pages


def _is(k: int) -> Callable[[Column], Column]:
    return lambda x: x == k


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    return found.select(
        F.col("key").alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256")
    return encode_pieces(table(spark, sf_dir, "documents"), columns).withColumnRenamed("key", "doc_id")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"))
    return counted.select(F.col("key").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_duplicates(table(spark, sf_dir, "documents"))
    return classes.select(F.col("key").alias("doc_id"), F.col("class_key").alias("class_id"), "class_size")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.array_sort(F.array_distinct("places.label"))
    own = F.array_sort(F.array_union("places.label", "matches.label"))
    best = F.coalesce(F.array_max("matches.containment"), F.lit(0.0))
    return found.select(
        F.col("key").alias("doc_id"),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(own, ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = archived_pages(table(spark, sf_dir, "pages"))
    return back.select(F.col("page_id").cast("long"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    kinds = F.transform("pii_base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, _is(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(PATTERNS)]
    return found.select(F.col("key").alias("doc_id"), *counts, F.sha2(listed(F.col("pii_base")), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    machine = train(documents, table(spark, sf_dir, "labels"))
    scored = score_quality(documents.select("doc_id", "text", "n_chars"), machine)
    return scored.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media_clips(table(spark, sf_dir, "documents"))
    clips = F.transform("clips", lambda c: F.concat_ws("-", c["start_ms"].cast("string"), c["end_ms"].cast("string")))
    return stored.withColumn("feature", F.array_join(clips, ",")).drop("clips").withColumnRenamed("key", "doc_id")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(table(spark, sf_dir, "documents"))
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return scored.select(F.col("key").alias("doc_id"), "n_words", F.round("log_score", 4).alias("log_score"), F.round(mean, 6).alias("mean_log_score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_token_counts": op3_token_counts,
        "op4_near_duplicates": op4_near_duplicates,
        "op5_license_scan": op5_license_scan,
        "op6_warc": op6_warc,
        "op7_pii": op7_pii,
        "op8_quality": op8_quality,
        "op9_media": op9_media,
        "op10_lm_scoring": op10_lm_scoring,
    }


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return oracles.SQL
