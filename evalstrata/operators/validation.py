"""Checks of a dataset: text health, duplicates, conflicts, leakage, diacritics, label balance, statistics.

Frames of examples have id, pos, messages, reference, lang. Keys are the tone-insensitive normal forms
of the input (message contents joined by line feeds) and of the reference, so near-copies are caught.
Ids that are listed are the first five in dataset order.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType
from pyspark.sql.window import Window

from ..functions.flags import BLANK_ENDS
from ..functions.text import MARKED, STABLE, TONE_MARKS, normalized_columns, words

LISTED, MOST_LINES = 5, 50
#: Shares beyond which classes are out of balance, and texts needed to judge diacritics.
MAJORITY, MINORITY, ENOUGH_TEXTS = 0.80, 0.10, 20
#: Hooked letters of Hausa.
HOOKED = "ɓɗƙƴƁƊƘƳ"
PROBLEMS = ("replacement", "controls", "non_nfc", "padded", "empty_inputs", "empty_refs")
EXPECTED = {"yo": ("tone_rate", "underdot_rate"), "ig": ("underdot_rate",), "ha": ("hooked_rate",)}


def input_text(messages: Column | str = "messages") -> Column:
    return F.array_join(F.transform(messages, lambda m: m["content"]), "\n")


def keyed(examples: DataFrame) -> DataFrame:
    """Examples with input, input_key and ref_key."""
    own = examples.withColumn("input", input_text())
    lang = "lang" if "lang" in examples.columns else None
    return normalized_columns(own, {"input_key": ("input", "strip"), "ref_key": ("reference", "strip")}, lang)


def texts(examples: DataFrame) -> DataFrame:
    """A row for each free text of an example: (id, pos, lang, text)."""
    own = F.concat(F.transform("messages", lambda m: m["content"]), F.when(F.col("reference").isNotNull(), F.array("reference")).otherwise(F.array().cast("array<string>")))
    return examples.select("id", "pos", "lang", F.explode(own).alias("text"))


def _is_nfc():
    @F.pandas_udf(BooleanType())
    def f(text: pd.Series) -> pd.Series:
        return text.map(lambda t: unicodedata.is_normalized("NFC", t)).astype(bool)

    return f


def problem_rows(examples: DataFrame, task: str = "generation") -> DataFrame:
    """(id, pos, problem), each once for an example."""
    t = texts(examples)
    text = F.col("text")
    native = F.array_compact(
        F.array(
            F.when(text.contains("�"), "replacement"),
            F.when(text.rlike(r"[\p{Cc}&&[^\t\n\r]]"), "controls"),
            F.when(F.regexp_replace(text, BLANK_ENDS, "") != text, "padded"),
        )
    )
    found = t.select("id", "pos", F.explode(native).alias("problem"))
    odd = t.filter(~text.rlike(STABLE))  # only these pass through Python
    found = found.unionByName(odd.filter(~_is_nfc()("text")).select("id", "pos", F.lit("non_nfc").alias("problem")))
    k = keyed(examples)
    if task != "asr":
        found = found.unionByName(k.filter("input_key = ''").select("id", "pos", F.lit("empty_inputs").alias("problem")))
    found = found.unionByName(k.filter("ref_key = ''").select("id", "pos", F.lit("empty_refs").alias("problem")))
    return found.distinct()


def first_ids(rows: DataFrame, by: str) -> DataFrame:
    """(by, n, ids): how many rows, and the first few ids in dataset order. The ids are cut within each
    task before they meet."""
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    top = rows.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy("pos", "id"))).filter(F.col("_k") <= LISTED)
    ids = top.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda s: s["id"]).alias("ids"))
    return counts.join(ids, by)


def duplicates(k: DataFrame) -> DataFrame:
    """Examples that repeat an earlier one with the same input and reference."""
    own = k.filter(F.col("reference").isNotNull())
    first = own.groupBy("input_key", "ref_key").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return own.join(first, ["input_key", "ref_key"]).filter("pos > first_pos").select("id", "pos", "first_pos")


def conflicts(k: DataFrame) -> DataFrame:
    """The first example of each reference of an input that has several."""
    own = k.filter(F.col("reference").isNotNull())
    refs = own.groupBy("input_key", "ref_key").agg(F.min("pos").alias("pos"), F.min_by("id", "pos").alias("id"))
    several = refs.groupBy("input_key").agg(F.count(F.lit(1)).alias("references")).filter("references > 1")
    return refs.join(several, "input_key").select("id", "pos", "references")


def leakage(k: DataFrame, other: DataFrame) -> DataFrame:
    """Examples whose input is among those of `other`, and whether it is so to the letter. Each side's key
    has been made in its own language."""
    keys = other.select("input_key").distinct()
    exact = other.select(F.col("input").alias("input"), F.lit(True).alias("identical")).distinct()
    hit = k.join(keys, "input_key", "left_semi").join(exact, "input", "left")
    return hit.select("id", "pos", F.coalesce("identical", F.lit(False)).alias("identical"))


def diacritics(examples: DataFrame) -> DataFrame:
    """(lang, texts, tone_rate, underdot_rate, hooked_rate) over texts of ha, yo and ig. Letters are told by
    their composed forms and by combining marks."""
    dotted = "".join(c for c in map(chr, range(0xC0, 0x2000)) if "̣" in unicodedata.normalize("NFD", c))
    t = texts(examples).filter(F.col("lang").isin("ha", "yo", "ig"))
    has = lambda signs: F.when(F.col("text").rlike(f"[{signs}]"), 1.0).otherwise(0.0)
    return t.groupBy("lang").agg(
        F.count(F.lit(1)).alias("texts"),
        F.avg(has(MARKED + TONE_MARKS)).alias("tone_rate"),
        F.avg(has(dotted + "̣")).alias("underdot_rate"),
        F.avg(has(HOOKED)).alias("hooked_rate"),
    )


def diacritics_missing(rates: DataFrame) -> DataFrame:
    """(lang, field, texts) of rates that are zero though there are enough texts."""
    pairs = [(lang, field) for lang, fields in EXPECTED.items() for field in fields]
    rows = F.explode(F.array(*(F.struct(F.lit(a).alias("l"), F.lit(b).alias("field"), F.col(b).alias("rate")) for a, b in pairs))).alias("x")
    cut = rates.filter(F.col("texts") >= ENOUGH_TEXTS).select("lang", "texts", rows)
    return cut.filter("x.l = lang and x.rate = 0").select("lang", "x.field", "texts")


def labels(k: DataFrame) -> DataFrame:
    """(label, n, first_pos)."""
    return k.filter(F.col("ref_key").isNotNull()).groupBy(F.col("ref_key").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


def label_balance(counts: DataFrame) -> DataFrame:
    """One row: classes, total, the most and the least common label (the first and the last seen of equals)
    and what is wrong: single-class, majority, minority or nothing. A minority is not reported beside a
    majority."""
    one = counts.agg(
        F.count(F.lit(1)).alias("classes"),
        F.sum("n").alias("total"),
        F.max_by(F.struct("label", "n"), F.struct("n", -F.col("first_pos"))).alias("top"),
        F.min_by(F.struct("label", "n"), F.struct("n", -F.col("first_pos"))).alias("low"),
    )
    issue = (
        F.when(F.col("classes") == 0, F.lit(None).cast("string"))
        .when(F.col("classes") == 1, "single-class")
        .when(F.col("top.n") / F.col("total") > MAJORITY, "majority")
        .when(F.col("low.n") / F.col("total") < MINORITY, "minority")
    )
    return one.select("classes", "total", F.col("top.label").alias("top_label"), F.col("top.n").alias("top_n"), F.col("low.label").alias("low_label"), F.col("low.n").alias("low_n"), issue.alias("issue"))


def statistics(examples: DataFrame) -> DataFrame:
    """(field, n, min, median, max) of word counts of inputs and references."""
    rows = F.explode(
        F.array(
            F.struct(F.lit("input_words").alias("field"), F.when(F.size("messages") > 0, F.size(words(input_text()))).alias("n")),
            F.struct(F.lit("reference_words").alias("field"), F.when(F.col("reference").isNotNull(), F.size(words(F.col("reference")))).alias("n")),
        )
    ).alias("x")
    x = examples.select(rows).select("x.field", "x.n").filter("n is not null")
    return x.groupBy("field").agg(F.count("n").alias("n_texts"), F.min("n").alias("min"), F.median("n").alias("median"), F.max("n").alias("max"))


def languages(examples: DataFrame) -> DataFrame:
    return examples.groupBy(F.coalesce("lang", F.lit("(none)")).alias("lang")).agg(F.count(F.lit(1)).alias("n"))
