"""A training corpus from `documents`: quality filter, near-dedup, decontamination, PII masking, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the docs of the next. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalstrata.llm.common import kept, table
from evalstrata.llm.decontamination import find_contamination
from evalstrata.llm.factorisation import score_quality, train
from evalstrata.llm.near_duplicates import near_duplicates
from evalstrata.llm.piece_codec import encode_pieces
from evalstrata.llm.pii import mask_pii

#: Documents that score below it are rejected.
LEAST_QUALITY = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, fitted on the labels of docs, doesn't reject. Empty and
    null texts are scored as any other."""
    machine = train(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs, machine, column="_quality_score")
    return scored.filter(F.col("_quality_score") >= LEAST_QUALITY).select(*(F.col(f"`{c}`") for c in docs.columns))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row with the smallest doc_id; texts without words stay."""
    own = docs.select(
        F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("row")).alias("_key"),
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"),
        F.col("text").alias("_text"),
    )
    own = kept(own, "dedup")
    classes = near_duplicates(own, key="_key", text="_text")
    stay = classes.filter(F.col("key.row") == F.col("class_key.row")).select(F.col("key.row").alias("_id"))
    return own.select(F.col("_key.row").alias("_id"), "_row").join(stay, "_id", "left_semi").select("_row.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("text").alias("_text"))
    found = find_contamination(own, table(spark, sf_dir, "benchmark"), key="_row", text="_text")
    return found.filter(F.size("spans") == 0).select("key.*")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data in their texts masked; n_chars follows the text."""
    done = mask_pii(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return done


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids with the end id, their number, digests of ids and of the text decoded from them."""
    return encode_pieces(docs, ("n_tokens", "ids", "ids_sha256", "decoded_sha256")).withColumnRenamed("key", "doc_id")


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", pii),
    ("SentencePiece encoding and decoding", sentencepiece_encoding),
]

#: A fitted model and sketches aren't expressible in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = kept(docs, "stage")
    return docs
