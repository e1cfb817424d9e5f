"""Result files of an outside benchmark harness, and settings of a project."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError

#: Families of tasks, metrics preferred as the headline, and those that are fractions.
FAMILIES = ("afrixnli", "belebele", "afrimmlu", "flores", "sib", "injongo", "afrimgsm")
PREFERRED = ("acc_norm", "acc", "exact_match", "f1", "chrf", "bleu")
FRACTIONS = frozenset({"acc", "acc_norm", "f1", "exact_match", "accuracy", "accuracy_strict", "macro_f1", "macro_f1_strict", "wer", "cer"})
SETTINGS = {"backend": str, "base_url": str, "model": str, "revision": str, "api_key_env": str, "timeout_s": float, "concurrency": int}


def latest_results(spark: SparkSession, folder: str, preferred: str = "results.json") -> str | None:
    """The preferred file of a folder, else the last of results*.json by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "results*.json").load(folder)
    best = files.select("path").agg(F.max(F.struct(F.col("path").endswith("/" + preferred).alias("p"), "path"))["path"]).first()
    return best[0]


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(task, metric, value) of the numbers of a result file; strings and booleans aren't results."""
    v = F.try_parse_json("value")
    raw = spark.read.text(path, wholetext=True).select(v.alias("v"))
    if raw.filter(F.try_variant_get("v", "$.results", "variant").isNotNull()).isEmpty():
        raise ConfigError(f"{path} has no 'results' object.", "It must be the file that the harness writes.")
    raw.createOrReplaceTempView("_harness")
    rows = spark.sql("SELECT t.key AS task, m.key AS metric, m.value AS x FROM _harness, LATERAL variant_explode(try_variant_get(v, '$.results', 'variant')) t, LATERAL variant_explode(t.value) m")
    kind = F.schema_of_variant("x")
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return rows.filter(number).select("task", "metric", F.try_variant_get("x", "$", "double").alias("value"))


def headlines(results: DataFrame) -> DataFrame:
    """(task, metric, value) of each task's headline: the first preferred metric it has, else the first by name."""
    name = F.lower(F.split("metric", ",")[0])
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PREFERRED)), name), F.lit(0)), F.lit(len(PREFERRED) + 1))
    return results.groupBy("task").agg(F.min_by(F.struct("metric", "value"), F.struct(rank, "metric")).alias("h")).select("task", "h.metric", "h.value")


def in_families(tasks: DataFrame, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """Distinct tasks whose name holds a family, in order."""
    own = F.exists(F.array(*map(F.lit, families)), lambda f: F.contains(F.lower("task"), F.lower(f)))
    return tasks.filter(own).select("task").distinct().orderBy("task")


def missing_families(tasks: DataFrame, families: tuple[str, ...] = FAMILIES) -> list[str]:
    """Families without a task."""
    there = tasks.agg(*(F.coalesce(F.bool_or(F.contains(F.lower("task"), F.lit(f.lower()))), F.lit(False)).alias(f) for f in families)).first()
    return [f for f in families if not there[f]]


def shown(metric: str | None, value: float | None) -> str:
    if value is None:
        return "-"
    return f"{100 * value:.2f}" if (metric or "").split(",")[0].lower() in FRACTIONS else f"{value:.2f}"


def settings(start: str, name: str = "evalstrata.toml") -> dict:
    """The table [evalstrata] of the nearest settings file upward; unknown keys and wrong types are errors."""
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        file = folder / name
        if file.is_file():
            own = tomllib.loads(file.read_text(encoding="utf-8")).get("evalstrata", {})
            for key, value in own.items():
                if key not in SETTINGS:
                    raise ConfigError(f"{file}: unknown setting {key!r}.", f"Known: {', '.join(SETTINGS)}.")
                kind = SETTINGS[key]
                if isinstance(value, bool) or not isinstance(value, (int, float) if kind is float else kind):
                    raise ConfigError(f"{file}: {key!r} must be a {kind.__name__}.")
            return own
    return {}
