"""JSON-lines datasets and run logs.

A dataset line is parsed by Python's own JSON rules in one Arrow pass, which also yields the exact
reason of each bad line; what follows is relational. Files of any size are read as lines by splits; a
row for each split, with the lines it holds, turns places in splits into line numbers of the files.
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..errors import ConfigError, DatasetError, RunError
from ..functions.text import ALIASES, LANGUAGES

TASKS = ("generation", "classification", "asr")
ROLES = ("system", "user", "assistant")
KEYS = {"id", "input", "messages", "audio", "reference", "lang", "meta"}
#: Below the folder of a run log, a folder for each session that appended to it.
SESSION = "run-"

EXAMPLE = (
    "line long, id string, messages array<struct<role:string,content:string>>, audio string, reference string, lang string, meta string, error string"
)
RECORD = "file string, line long, at long, id string, prediction string, latency_ms double, error string, request_id string, damaged boolean"


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, at, value) of the non-blank lines of a text file, or of all files below a folder: the number
    in the file, from 1, and the place in all of them in the order of sessions, of the times of writing, and of
    names. Lines end at line feeds only; a leading byte order mark is removed. Bytes that aren't UTF-8 are an
    error with their place."""
    meta = {"file": "file_path", "start": "file_block_start", "changed": "file_modification_time"}
    try:
        text = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
        text = text.select("value", *(F.col(f"_metadata.{v}").alias(k) for k, v in meta.items()), F.monotonically_increasing_id().alias("id"))
        bad = F.min(F.when(~F.is_valid_utf8("value"), F.col("id")))
        splits = text.groupBy("file", "start", "changed").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), bad.alias("bad")).collect()  # a row a split
    except AnalysisException:
        raise DatasetError(f"{path} can't be read.") from None
    session = lambda file: int(found[-1]) if (found := re.findall(f"/{SESSION}([0-9]+)/", file)) else 0
    places, at, line, last = [], 0, 0, None
    for r in sorted(splits, key=lambda r: (session(r.file), r.changed, r.file, r.start)):
        line, last = line if r.file == last else 0, r.file
        places.append((r.file, r.start, r.first, line, at))
        if r.bad is not None:
            number = line + r.bad - r.first + 1
            value = bytes(text.filter((F.col("file") == r.file) & (F.col("id") == r.bad)).select(F.col("value").cast("binary")).first()[0])
            try:
                value.decode()
            except UnicodeDecodeError as e:
                raise DatasetError(f"{r.file} isn't UTF-8: line {number}, byte {e.start}.") from None
        line, at = line + r.n, at + r.n
    if not places:
        places.append(("", 0, 0, 0, 0))
    place = spark.createDataFrame(places, "file string, start long, first long, lines long, before long")
    rows = text.join(F.broadcast(place), ["file", "start"])
    nth = F.col("id") - F.col("first") + 1
    rows = rows.select("file", (F.col("lines") + nth).alias("line"), (F.col("before") + nth).alias("at"), "value")
    value = F.when(F.col("line") == 1, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value"))
    return rows.withColumn("value", value).filter(~F.col("value").rlike(r"(?U)^[\s\x1c-\x1f]*$"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of the non-blank lines of a text file."""
    return numbered(spark, path).select("line", "value")


def parse_line(value: str, task: str) -> dict:
    """The fields of a dataset line, or why it is bad."""

    def bad(message: str) -> dict:
        return {"error": message}

    try:
        row = json.loads(value)
    except ValueError as e:
        return bad(f"invalid JSON ({e.msg if isinstance(e, json.JSONDecodeError) else e})")
    if not isinstance(row, dict):
        return bad("expected a JSON object")
    if extra := sorted(row.keys() - KEYS):
        return bad(f"unknown field(s): {', '.join(extra)}")
    reference, lang, meta = row.get("reference"), row.get("lang"), row.get("meta", {})
    if reference is not None and not isinstance(reference, str):
        return bad("'reference' must be a string")
    if reference is None and task in ("classification", "asr"):
        return bad(f"'reference' is required for {task}")
    if lang is not None:
        name = lang.strip().casefold() if isinstance(lang, str) else ""
        lang = ALIASES.get(name, name)
        if lang not in LANGUAGES:
            return bad("unsupported 'lang'")
    if meta is None or not isinstance(meta, dict):
        return bad("'meta' must be an object")
    has_input, has_messages, audio = "input" in row, "messages" in row, row.get("audio")
    messages: list = []
    if task == "asr":
        if has_input or has_messages:
            return bad("speech examples have 'audio', not 'input' or 'messages'")
        if not isinstance(audio, str) or not audio:
            return bad("'audio' is required for asr")
    else:
        if "audio" in row:
            return bad("'audio' is only for asr")
        if has_input == has_messages:
            return bad("give exactly one of 'input' and 'messages'")
        if has_input:
            if not isinstance(row["input"], str) or not row["input"].strip():
                return bad("'input' must be a non-empty string")
            messages = [{"role": "user", "content": row["input"]}]
        else:
            messages = row["messages"]
            good = isinstance(messages, list) and messages and all(isinstance(m, dict) and m.get("role") in ROLES and isinstance(m.get("content"), str) and m.keys() == {"role", "content"} for m in messages)
            if not good:
                return bad("'messages' must be a non-empty list of {role, content}")
    own = row.get("id")
    if own is None:
        dump = json.dumps([messages, audio.rpartition("/")[2] if audio else None, reference], ensure_ascii=False, sort_keys=True)
        own = hashlib.sha256(dump.encode()).hexdigest()[:12]
    elif isinstance(own, bool) or not isinstance(own, (str, int)) or own == "":
        return bad("'id' must be a non-empty string or a whole number")
    return {
        "id": str(own),
        "messages": [{"role": m["role"], "content": m["content"]} for m in messages],
        "audio": audio,
        "reference": reference,
        "lang": lang,
        "meta": json.dumps(meta, ensure_ascii=False),
        "error": None,
    }


def _mapped(rows: DataFrame, one, ddl: str) -> DataFrame:
    """Rows with the fields that `one` makes of their value; columns of `rows` that `ddl` names stay."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)
    own = [c for c in rows.columns if c in schema.names]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = [one(v) for v in batch.column(len(own)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(own.index(f.name)) if f.name in own else pa.array([m.get(f.name) for m in made], f.type) for f in arrow], schema=arrow)

    return rows.select(*own, "value").mapInArrow(run, schema)


def parse_dataset(spark: SparkSession, path: str, task: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad): examples with pos and line, and (line, message) of every bad line. Of an id that comes
    twice, the later lines are bad."""
    if task not in TASKS:
        raise ConfigError(f"Unknown task {task!r}.", f"Use one of: {', '.join(TASKS)}.")
    parsed = _mapped(lines(spark, path), lambda v: parse_line(v, task), EXAMPLE)
    fine = parsed.filter("error is null")
    first = F.min("line").over(Window.partitionBy("id"))
    fine = fine.withColumn("_first", first)
    good = fine.filter("line = _first").withColumn("pos", F.col("line")).drop("_first", "error")
    repeated = fine.filter("line <> _first").select("line", F.concat(F.lit("duplicate id '"), "id", F.lit("' (first used on line "), F.col("_first").cast("string"), F.lit(")")).alias("message"))
    bad = parsed.filter("error is not null").select("line", F.col("error").alias("message")).unionByName(repeated)
    return good, bad


def load_dataset(spark: SparkSession, path: str, task: str) -> DataFrame:
    """Examples of a dataset whose lines are all good; the first bad line is raised."""
    good, bad = parse_dataset(spark, path, task)
    first = bad.orderBy("line").first()
    if first is not None:
        raise DatasetError(f"line {first.line}: {first.message}")
    if good.isEmpty():
        raise DatasetError(f"{path} has no examples.")
    return good


def fingerprint(spark: SparkSession, path: str) -> str:
    """SHA-256 of the file's bytes."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]


def meta_field(meta, name: str):
    """A field of the free-form meta object as Python would print it; null if absent."""
    v = F.variant_get(F.try_parse_json(meta), f"$.{name}", "string")
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(meta), f"$.{name}", "variant"))
    return F.when(kind == "BOOLEAN", F.initcap(v)).otherwise(v)


def parse_record(value: str) -> dict:
    try:
        row = json.loads(value)
    except ValueError:
        return {"damaged": True}
    if not isinstance(row, dict) or not isinstance(row.get("id"), str):
        return {"damaged": True}
    number = row.get("latency_ms")
    return {
        "id": row["id"],
        "prediction": row.get("prediction"),
        "latency_ms": None if number is None else float(number),
        "error": row.get("error"),
        "request_id": row.get("request_id"),
        "damaged": False,
    }


def latest(records: DataFrame) -> DataFrame:
    """The last record of each id."""
    best = F.max_by(F.struct(*(F.col(c) for c in records.columns)), "at").alias("r")
    return records.groupBy("id").agg(best).select("r.*")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The last record of each id of a run log, a file or a folder of what several sessions appended. A damaged
    last line of a file is ignored, one before it is an error; a log that doesn't exist has no records."""
    if not exists(spark, path):
        return spark.createDataFrame([], RECORD).drop("damaged")
    parsed = _mapped(numbered(spark, path), parse_record, RECORD)
    ends = parsed.groupBy("file").agg(F.max("line").alias("last"), F.min(F.when(F.col("damaged"), F.col("line"))).alias("bad"))
    worst = ends.filter("bad < last").orderBy("file").first()
    if worst is not None:
        raise RunError(f"{worst.file}: line {worst.bad} is damaged.", "Restore it or start a new run.")
    return latest(parsed.filter(~F.col("damaged"))).drop("damaged")


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The manifest of a run, a JSON object."""
    if not exists(spark, path):
        raise RunError(f"{path} doesn't exist.")
    text = spark.read.text(path, wholetext=True).first()[0]
    try:
        found = json.loads(text)
    except ValueError:
        raise RunError(f"{path} isn't valid JSON.") from None
    if not isinstance(found, dict):
        raise RunError(f"{path} isn't a JSON object.")
    return found


def write_results(records: DataFrame, path: str) -> str:
    """Appends records as JSON lines, as a session's own folder with the next number; returns that folder."""
    spark, jvm = records.sparkSession, records.sparkSession._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []
    before = [int(n.removeprefix(SESSION)) for n in names if re.fullmatch(f"{SESSION}[0-9]+", n)]
    folder = f"{path}/{SESSION}{max(before, default=0) + 1:06d}"
    records.select("id", "prediction", "latency_ms", "error", "request_id").write.json(folder)
    return folder
