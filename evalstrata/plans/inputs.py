"""Examples and runs derived from the driver's tables by plain arithmetic, the same in SQL.

examples: id = pos = doc_id, reference = the whole text with single blanks, domain = source. The two runs
fail, drop and change words by doc_id; in each the first rule that fits holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapsed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    message = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("doc_id").alias("pos"),
        collapsed(F.col("text")).alias("reference"),
        "lang",
        F.col("source").alias("domain"),
        message.alias("messages"),
    )


def dealt(ex: DataFrame) -> DataFrame:
    """(id, pos, reference, lang) of examples, dealt by id. Frames made of it that are joined by id lie where they
    belong, and read one exchange that is written once: the texts are in an array, so that all need the same columns
    of it, and no filter passes the index, which is always 0 but doesn't count as known."""
    first = F.spark_partition_id() * 0
    e = ex.select("id", F.array("reference", "lang").alias("texts")).repartition("id")
    return e.select("id", F.col("id").alias("pos"), F.col("texts")[first].alias("reference"), F.col("texts")[1].alias("lang"))


def results(ex: DataFrame, run: str) -> DataFrame:
    """(id, prediction, latency_ms, error) of a derived run: base or candidate."""
    i, r = F.col("id"), F.col("reference")
    short = F.substr(r, F.lit(1), F.length(r) - F.length(F.substring_index(r, " ", -1)) - 1)
    if run == "base":
        first = F.instr(r, " ")
        changed = F.when(first > 0, F.concat(F.lit("x"), F.substr(r, first))).otherwise(F.when(r.isNotNull(), "x"))
        prediction = F.when(i % 4 == 1, short).when(i % 4 == 2, changed).otherwise(r)
        own, failed = ex.filter(i % 31 != 0), i % 29 == 0
    else:
        # of ASCII texts the built-in upper case is the same, and faster
        upper = F.when(F.octet_length(r) == F.length(r), F.upper(r)).otherwise(F.translate(r, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        prediction = F.when(i % 7 == 3, short).when(i % 11 == 5, F.concat(F.lit("x "), r)).when(i % 5 == 0, F.concat(upper, F.lit("!"))).otherwise(r)
        own, failed = ex, i % 41 == 0
    return own.select(
        "id",
        F.when(~failed, prediction).alias("prediction"),
        F.when(~failed, (850 + (i * 37) % 220).cast("double")).alias("latency_ms"),
        F.when(failed, "timeout").alias("error"),
    )


def troubled(ex: DataFrame) -> DataFrame:
    """Examples with what checks of texts look for, put in by id."""
    i, text = F.col("id"), F.col("messages")[0]["content"]
    for k, what in ((5, " "), (7, "\ufffd"), (11, "\x01"), (13, "e\u0301")):
        text = F.when(i % k == 0, F.concat(text, F.lit(what))).otherwise(text)
    text = F.when(i % 17 == 0, "...").otherwise(text)
    message = F.array(F.struct(F.lit("user").alias("role"), text.alias("content")))
    return ex.withColumns({"messages": message, "reference": F.when(i % 19 == 0, "?").otherwise(F.col("reference"))})


def graded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Classification: good or bad by the quality label; the answer is good but for every sixth."""
    rows = table(spark, sf_dir, "labels").filter("quality is not null")
    ex = rows.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("reference"), F.lit("en").alias("lang"))
    answer = F.when(F.col("id") % 6 == 0, "Bad.").when(F.col("id") % 6 == 1, "good").otherwise("the answer is good")
    return ex, ex.select("id", answer.alias("prediction"), F.lit(None).cast("double").alias("latency_ms"), F.lit(None).cast("string").alias("error"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An example for each assistant turn: the turns before it are its messages, its text the reference."""
    c = table(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    whole = c.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.explode("turns").alias("t"), "turns").filter("t.role = 'assistant'")
    before = F.filter("turns", lambda x: x["turn"] < F.col("t.turn"))
    return whole.select("conv_id", "t.turn", F.transform(before, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"), F.col("t.content").alias("reference"))


#: The same in SQL, as common table expressions.
TROUBLED = r"""troubled AS (SELECT id, pos, lang, CASE WHEN id % 17 = 0 THEN '...' ELSE text || CASE WHEN id % 5 = 0 THEN ' ' ELSE '' END ||
  CASE WHEN id % 7 = 0 THEN chr(65533) ELSE '' END || CASE WHEN id % 11 = 0 THEN chr(1) ELSE '' END || CASE WHEN id % 13 = 0 THEN 'e' || chr(769) ELSE '' END END AS text,
  CASE WHEN id % 19 = 0 THEN '?' ELSE reference END AS reference FROM ex)"""
SQL = r"""
ex AS (SELECT doc_id AS id, doc_id AS pos, lang, source AS domain, text,
  trim(regexp_replace(text, '\s+', ' ', 'g')) AS reference FROM documents),
w AS (SELECT *, string_split(reference, ' ') AS ws FROM ex),
base AS (SELECT id, CASE WHEN id % 29 = 0 THEN 'timeout' END AS error, CASE WHEN id % 29 <> 0 THEN CAST(850 + (id * 37) % 220 AS DOUBLE) END AS latency_ms,
  CASE WHEN id % 29 = 0 THEN NULL WHEN id % 4 = 1 THEN array_to_string(list_slice(ws, 1, len(ws) - 1), ' ')
    WHEN id % 4 = 2 THEN array_to_string(list_concat(['x'], list_slice(ws, 2, len(ws))), ' ') ELSE reference END AS prediction
  FROM w WHERE id % 31 <> 0),
candidate AS (SELECT id, CASE WHEN id % 41 = 0 THEN 'timeout' END AS error, CASE WHEN id % 41 <> 0 THEN CAST(850 + (id * 37) % 220 AS DOUBLE) END AS latency_ms,
  CASE WHEN id % 41 = 0 THEN NULL WHEN id % 7 = 3 THEN array_to_string(list_slice(ws, 1, len(ws) - 1), ' ')
    WHEN id % 11 = 5 THEN 'x ' || reference WHEN id % 5 = 0 THEN translate(reference, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || '!' ELSE reference END AS prediction
  FROM w)
"""
