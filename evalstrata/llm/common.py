"""What the operators share: words, the shared scratch folder, and Arrow plumbing."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of UTF-8: A-Z become a-z, the other ASCII bytes that are not letters or digits
#: become blanks. What is left between blanks are the words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8 bytes; null and empty texts have none."""
    return text.encode().translate(WORD_BYTES).split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's setting spark.checkpoint.dir. Only where
    that is unset a folder is made: a temporary one in local mode (tests), else one in the warehouse,
    which a cluster's executors share too."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder and not context._jsc.sc().getCheckpointDir().isEmpty():
        return context._jsc.sc().getCheckpointDir().get()
    if not folder and context.master.split("[")[0] == "local":
        folder = tempfile.mkdtemp(prefix="evalstrata-checkpoint-")
    elif not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, kind: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def kept(df: DataFrame, kind: str) -> DataFrame:
    """`df` written once to the shared folder and read back: its lineage ends there, it survives
    lost executors, and later readers don't compute it again. `dropped` deletes it; what a lazy result
    still reads stays until the folder is cleaned."""
    path = scratch(df.sparkSession, kind)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def kept_by(df: DataFrame, kind: str, column: str) -> DataFrame:
    """`df` written once to the shared folder in buckets of a column, as many as there are shuffle partitions, so
    that what is joined or grouped by it later doesn't move these rows. The catalog keeps no entry."""
    spark, path = df.sparkSession, scratch(df.sparkSession, kind)
    name = f"{kind}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).saveAsTable(name)
    out = spark.table(name)
    out.schema, out._jdf.queryExecution().analyzed()  # noqa: B018  resolved before the entry goes; the files stay
    spark.sql(f"DROP TABLE {name}")
    out.kept_at = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes kept frames that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.kept_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Rows up to which a narrow frame, whose rows have been counted, is sent to all executors.
SENT = 100_000


def sent(df: DataFrame, rows: int) -> DataFrame:
    """`df` marked for a broadcast join if it has few rows; else Spark shuffles it. Results are equal."""
    return F.broadcast(df) if rows <= SENT else df


def in_few(df: DataFrame, rows: int) -> DataFrame:
    """`df` in few partitions if it has few rows, so that it isn't written as many small files."""
    return df.coalesce(8) if rows <= SENT else df


def spread(df: DataFrame, rows: int, each: int, *by: str) -> DataFrame:
    """`df` dealt by columns into partitions of about `each` rows, as many as there are shuffle partitions at
    least. For rows that are small in bytes and dear in time, which adaptive execution would put together."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // each)), *by)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows, so that what is made of a batch stays small. After the last the worker, which waits
    for other tasks, gives the memory that very long texts took back to the system."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    given_back()


def given_back() -> None:
    """Gives freed memory that this process still holds back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


#: Bytes of the Arrow batches in which rows go to Python and back, on either side of the pipe.
BATCH_BYTES = 4 << 20
#: Spark's own bound, under which a session has set none.
DEFAULT_BATCH_BYTES = "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes: counted in rows, a batch of long texts has no bound."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == DEFAULT_BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def two_columns(df: DataFrame, key: str, text: str) -> DataFrame:
    """Only the key and the text, under fixed names, so other columns can't clash."""
    small_batches(df.sparkSession)
    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))


def arrow_rows(df: DataFrame, make: Callable[[], Callable[[list, list], dict]], schema: str) -> DataFrame:
    """One output row for each row of `df` (key, text). `make` runs once in each worker and
    returns the function that turns the keys and texts of a batch into the output columns."""
    target = StructType.fromDDL(schema)
    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in sliced(batches):
            columns = work(batch.column(0), batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in arrow], schema=arrow
            )

    return df.mapInArrow(run, target)


def here(name: str) -> str:
    """The file of a public tokenizer."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
