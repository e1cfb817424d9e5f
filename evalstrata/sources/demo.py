"""A small made-up dataset with two runs, to try the plans on. Its 92 items, with what both runs answered and
how long they took, are fixed values in demo_items.jsonl; an answer of null is one that failed."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "id string, lang string, domain string, prompt string, reference string, base string, base_ms double, tuned string, tuned_ms double"


def demo(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(examples, results of base, results of tuned)."""
    lines = Path(__file__).with_name("demo_items.jsonl").read_text(encoding="utf-8").splitlines()
    items = spark.createDataFrame([(n, line) for n, line in enumerate(lines)], "pos long, line string").select("pos", F.from_json("line", ITEM).alias("i")).select("pos", "i.*")
    message = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))
    examples = items.select("id", "pos", "lang", "domain", message.alias("messages"), "reference")
    results = [items.select("id", F.col(run).alias("prediction"), F.col(f"{run}_ms").alias("latency_ms"), F.when(F.col(run).isNull(), "no answer").alias("error")) for run in ("base", "tuned")]
    return examples, *results
