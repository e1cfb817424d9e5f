"""Running a model over a dataset: what is pending, answers from a plug-in, the failure breaker, summaries."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import BackendError, ConfigError, RunAborted

BREAKER = 20
ANSWER = "id string, prediction string, latency_ms double, error string, request_id string"
#: Statuses worth another try, and the longest waits in seconds.
RETRIED, LONGEST_WAIT, LONGEST_ASKED = frozenset({429, 500, 502, 503, 504}), 8.0, 30.0


class Backend(Protocol):
    """A model. Made in each worker by a factory, so it may hold connections."""

    def generate(self, messages: list[dict]) -> dict: ...

    def close(self) -> None: ...


BACKENDS: dict[str, Callable[..., Backend]] = {}


def register_backend(name: str, factory: Callable[..., Backend]) -> None:
    BACKENDS[name] = factory


def make_backend(name: str, **settings) -> Backend:
    if name not in BACKENDS:
        raise ConfigError(f"Unknown backend {name!r}.", f"Registered: {', '.join(sorted(BACKENDS)) or 'none'}.")
    return BACKENDS[name](**settings)


def finished(results: DataFrame, retry_failed: bool = True) -> DataFrame:
    """Ids that need no further call."""
    return (results.filter("error is null") if retry_failed else results).select("id")


def pending(examples: DataFrame, results: DataFrame, retry_failed: bool = True) -> DataFrame:
    """Examples without a final record."""
    return examples.join(finished(results, retry_failed), "id", "left_anti")


def wait(attempt: int, asked: float | None = None) -> float:
    """Seconds before the next try."""
    return min(asked, LONGEST_ASKED) if asked is not None else min(0.5 * 2**attempt, LONGEST_WAIT)


def with_retries(call: Callable[[], dict], tries: int = 3, sleep: Callable[[float], None] = time.sleep) -> dict:
    for attempt in range(tries):
        try:
            return call()
        except BackendError as e:
            status = getattr(e, "status", None)
            if attempt == tries - 1 or (status is not None and status not in RETRIED):
                raise
            sleep(wait(attempt, getattr(e, "retry_after", None)) * random.uniform(0.9, 1.0))
    raise AssertionError


def predict(examples: DataFrame, factory: Callable[[], Backend], limit: int = BREAKER) -> DataFrame:
    """Answers of a backend, an example at a time within each partition. An error of one example is its
    record; of unexpected errors only the type is kept. A partition stops after `limit` failures in a
    row (0: never)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend, streak = factory(), 0
        try:
            for rows in batches:
                out = []
                for row in rows.itertuples():
                    try:
                        got = backend.generate([dict(m) for m in row.messages])
                        out.append((row.id, got["text"], got.get("latency_ms"), None, got.get("request_id")))
                        streak = 0
                    except BackendError as e:
                        out.append((row.id, None, None, str(e), getattr(e, "request_id", None)))
                        streak += 1
                    except Exception as e:  # noqa: BLE001  one example must not end the run
                        out.append((row.id, None, None, f"unexpected error: {type(e).__name__}", None))
                        streak += 1
                    if limit and streak >= limit:
                        break
                yield pd.DataFrame(out, columns=["id", "prediction", "latency_ms", "error", "request_id"])
                if limit and streak >= limit:
                    return
        finally:
            backend.close()

    return examples.select("id", "messages").mapInPandas(run, ANSWER)


def streaks(rows: DataFrame, failed: Column, order: list, by: list[str] | None = None) -> DataFrame:
    """Rows with `streak`, the number of failures in a row up to each, 0 at a success. `by` keeps runs apart
    and in parallel."""
    by = by or []
    own = rows.withColumn("_f", failed.cast("int"))
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("_g", F.sum(1 - F.col("_f")).over(w))
    v = Window.partitionBy(*by, "_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return own.withColumn("streak", F.sum("_f").over(v)).drop("_f", "_g")


def check_breaker(records: DataFrame, limit: int = BREAKER, order: str = "line") -> None:
    """Raises if a run log has `limit` failures in a row."""
    if limit and not streaks(records, F.col("error").isNotNull(), [order]).filter(F.col("streak") >= limit).isEmpty():
        raise RunAborted(f"{limit} failures in a row.", "Fix the backend and run again; finished examples are kept.")


def run_summary(examples: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: total, skipped (final before), ok and failed among final records of the dataset."""
    known = examples.select("id")
    skipped = known.join(finished(before), "id", "left_semi").agg(F.count(F.lit(1)).alias("skipped"))
    final = known.join(after, "id").agg(F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    total = known.agg(F.count(F.lit(1)).alias("total"))
    return total.crossJoin(skipped).crossJoin(final)  # three single rows


def models_of(manifest: dict, langs: DataFrame) -> list[str]:
    """Names of the models that served the languages of a run, the entry * standing for the others."""
    models = manifest.get("models") or {}
    chosen = F.coalesce(F.create_map(*(F.lit(x) for p in models.items() for x in p))[F.col("lang")] if models else F.lit(None), F.lit(models.get("*")))
    rows = langs.select(chosen.alias("m")).filter("m is not null").distinct().collect()  # at most one a model
    return sorted(r.m for r in rows)
