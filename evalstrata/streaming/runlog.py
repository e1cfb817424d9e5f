"""Run logs as streams: records arrive as JSON lines, the latest of each id stands, failures are watched."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

RECORD = "id string, prediction string, latency_ms double, error string, request_id string"


def read_log(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Records of a folder of JSON-lines files as a stream, each with its place in the log: when its file was
    written, the file, and the line in it. Files are read whole, which gives lines their numbers, so a writer
    should keep them small. Damaged lines are left out."""
    reader = spark.readStream.option("wholetext", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    files = reader.text(path).select(F.posexplode(F.split("value", "\n")).alias("line", "value"), F.col("_metadata.file_modification_time").alias("written"), F.col("_metadata.file_path").alias("file"))
    rows = files.select(F.from_json("value", RECORD, {"mode": "PERMISSIVE"}).alias("r"), F.struct("written", "file", "line").alias("place"))
    return rows.filter("r.id is not null").select("r.*", "place")


def latest_by_id(records: DataFrame) -> DataFrame:
    """The record of each id that comes last in the log, also among those of one batch; state is one record an id."""
    best = F.max_by(F.struct("prediction", "latency_ms", "error", "request_id"), "place").alias("r")
    return records.groupBy("id").agg(best).select("id", "r.*")


def failure_counts(events: DataFrame, time: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Beyond the run log: failures in windows of event time, with a watermark for late records."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, width).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "failed")
    )


def breaker_states(records: DataFrame, limit: int) -> DataFrame:
    """For each run (column `run`) the failures in a row so far and whether the breaker has tripped. Within a
    batch records are taken in the order of `line`."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches, state):
        streak, tripped = state.get if state.exists else (0, False)
        rows = pd.concat(list(batches)).sort_values("line")
        for bad in rows["error"].notna():
            streak = streak + 1 if bad else 0
            tripped = tripped or (limit > 0 and streak >= limit)
        state.update((int(streak), bool(tripped)))
        yield pd.DataFrame({"run": [key[0]], "streak": [int(streak)], "tripped": [bool(tripped)]})

    return records.groupBy("run").applyInPandasWithState(step, "run string, streak long, tripped boolean", "streak long, tripped boolean", "update", GroupStateTimeout.NoTimeout)


def append_to(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes a stream of records as JSON lines; after a restart each record is written once."""
    return records.drop("place").writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
