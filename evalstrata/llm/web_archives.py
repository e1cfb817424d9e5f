"""Web archives as DataFrames: pages to WARC files and back.

The archives are written by Spark's text sink, so they may lie in any store that Spark writes, and
are read as binary files, each as a whole: a file holds at most `records_per_file` records, and fewer where
the longest payload would let them exceed `file_bytes`. A record's id names its page and payload digest, so
rows of one page id with different payloads stay apart.

Defined cases: a null page is an empty payload. Of records with equal payloads of at least `least`
bytes, that with the smallest page id is the response (a null id comes last) and the others are
revisits; rows that repeat that id with that payload are responses too. URLs that are null are left
out; line ends in them become blanks. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, scratch, sent
from .warc import payload_of, salvage

LEAST = 100
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Bytes of an archive, which is read as one value.
FILE_BYTES = 256 << 20
READ = "file string, start long, end long, gap string, record_type string, page_id string, refers_to string, declared_digest string, payload_bytes long, payload_digest string"


def record_text(page: Column, url: Column, html: Column, digest: Column, first: Column, revisit: Column) -> Column:
    """A WARC record without its last line feed, which the text sink adds."""
    block = F.when(revisit, F.lit("")).otherwise(F.concat(F.lit(HTTP), html))
    name = F.coalesce(page.cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.concat(F.lit("\r\nWARC-Record-ID: <urn:page:"), name, F.lit(":"), digest, F.lit(">\r\nWARC-Date: 1970-01-01T00:00:00Z")),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), F.regexp_replace(url, "[\\r\\n]+", " ")), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"),
        digest,
        F.lit("\r\nWARC-Block-Digest: sha256:"),
        F.sha2(F.encode(block, "UTF-8"), 256),
        F.when(
            revisit,
            F.concat(
                F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"),
                F.coalesce(first.cast("string"), F.lit("")),
                F.lit(":"),
                digest,
                F.lit(">"),
            ),
        ).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
        block,
        F.lit("\r\n\r"),
    )


def write_warc(pages: DataFrame, path: str, least: int = LEAST, key: str = "page_id", url: str = "url", html: str = "html", records_per_file: int = 2_000, file_bytes: int = FILE_BYTES) -> None:
    """Writes a record for each page below `path`. Payloads that repeat become revisits."""
    rows = pages.select(F.col(f"`{key}`").alias("page"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    groups = rows.filter(F.octet_length("html") >= least).groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("page").alias("first"))
    repeated = kept(groups.filter("copies > 1").select("digest", "first"), "repeated")
    joined = rows.join(sent(repeated, repeated.count()), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    text = record_text(*(F.col(c) for c in ("page", "url", "html", "digest", "first")), revisit)
    longest = 4096 + (rows.agg(F.max(F.octet_length("html") + F.coalesce(F.octet_length("url"), F.lit(0)))).first()[0] or 0)
    records_per_file = max(1, min(records_per_file, file_bytes // longest))
    joined.select(text.alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", records_per_file).option("compression", "none").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record and each quarantined gap of the archives below `path`. Payload sizes and
    digests are of the bytes read; a revisit has those of no payload, and declares that of the payload it
    refers to."""

    def page(name: str) -> str | None:
        if name.startswith("<urn:page:"):
            return name[10:-1].rpartition(":")[0]
        return name or None

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for what, start, end, info, block in salvage(content.as_py()):
                    if what == "gap":
                        rows.append((file, start, end, info, *[None] * 6))
                        continue
                    payload = payload_of(info, block)
                    declared = info.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    rows.append((file, start, end, None, info["warc-type"], page(info.get("warc-record-id", "")), page(info.get("warc-refers-to", "")), declared, len(payload), hashlib.sha256(payload).hexdigest()))
                columns = list(zip(*rows, strict=True)) or [()] * 10
                kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "start", "end", "gap", "record_type", "page_id", "refers_to", "declared_digest", "payload_bytes", "payload_digest"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, READ)


def resolved(records: DataFrame) -> DataFrame:
    """The records of read_warc, revisits with the size and digest of the payload they refer to, which is that
    of the page and the digest that they name; null where no such response was read."""
    good = records.filter("gap is null")
    first = good.filter("record_type = 'response'").groupBy(F.col("page_id").alias("first_id"), F.col("payload_digest").alias("digest")).agg(F.first("payload_bytes").alias("bytes"))
    revisits = good.filter("record_type = 'revisit'").drop("payload_bytes", "payload_digest")
    found = revisits.join(first, (F.col("refers_to") == F.col("first_id")) & (F.col("declared_digest") == F.col("digest")), "left")
    out = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    back = found.select("page_id", "record_type", "refers_to", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"))
    return good.filter("record_type <> 'revisit'").select(*out).unionByName(back)


def archived_pages(pages: DataFrame) -> DataFrame:
    """Pages written to archives in the shared folder and read back."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_warc(pages, path)
    return resolved(kept(read_warc(spark, path), "records"))
