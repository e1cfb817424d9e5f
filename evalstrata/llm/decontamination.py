r"""Benchmark decontamination with Wu-Manber multi-pattern search over words.

Every benchmark item gives windows of `size` consecutive words (an item of fewer words is one
window). The windows of one length share a machine whose alphabet is the set of words: a shift
table over blocks of two words tells how far the search may jump, the block at a window's end picks
the bucket of windows that could end there, a second block at their start thins the bucket, and a
direct comparison of words confirms each occurrence.

Defined cases: null and empty texts have no words and no hits. A null item id still marks words but
is not listed. Repeated documents and items give a row and a mention each, as equal items would.
Item ids are compared as strings. Other columns of either table are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, sliced, two_columns, words

SCHEMA = "key {key}, text string, n_words long, spans array<struct<first:int,last:int>>, item_ids array<string>"


class WuManber:
    """Searches for patterns of one length, given as tuples of words."""

    def __init__(self, patterns: dict[tuple, list], block: int = 2):
        self.length = len(next(iter(patterns)))
        self.block = min(block, self.length)
        self.furthest = self.length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, list]] = defaultdict(lambda: defaultdict(list))
        for pattern, value in patterns.items():
            for end in range(self.block, self.length + 1):
                at = pattern[end - self.block : end]
                self.shift[at] = min(self.shift.get(at, self.furthest), self.length - end)
            self.buckets[pattern[-self.block :]][pattern[: self.block]].append((list(pattern), value))

    def find(self, text: list) -> Iterator[tuple[int, list]]:
        """(start, value) of every occurrence."""
        length, block, furthest, shift = self.length, self.block, self.furthest, self.shift.get
        end, n = length, len(text)
        while end <= n:
            at = tuple(text[end - block : end])
            jump = shift(at, furthest)
            if jump:
                end += jump
                continue
            start = end - length
            for pattern, value in self.buckets[at].get(tuple(text[start : start + block]), ()):
                if text[start:end] == pattern:
                    yield start, value
            end += 1


def machines(windows: Iterable[tuple[str, str | None]]) -> list[WuManber]:
    """One machine for each length among (window, item id)."""
    by_length: dict[int, dict[tuple, list]] = defaultdict(lambda: defaultdict(list))
    for window, item in windows:
        pattern = tuple(window.encode().split(b" "))
        by_length[len(pattern)][pattern].append(item)
    return [WuManber(patterns) for patterns in by_length.values()]


def merged(spans: Iterable[tuple[int, int]]) -> list[dict]:
    """Spans of words (first, last) as disjoint sorted spans."""
    out: list[dict] = []
    for first, last in sorted(spans):
        if out and first <= out[-1]["last"] + 1:
            out[-1]["last"] = max(out[-1]["last"], last)
        else:
            out.append({"first": first, "last": last})
    return out


def item_windows(benchmark: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """Distinct (window, item_id) of the benchmark."""

    def run(batches):
        for batch in batches:
            ids, out = [], []
            for item, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words(body)
                for i in range(max(1, len(w) - size + 1) if w else 0):
                    out.append(b" ".join(w[i : i + size]).decode())
                    ids.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(ids, pa.string())], ["window", "item_id"])

    rows = two_columns(benchmark, key, text).select(F.col("key").cast("string"), "text")
    return rows.mapInArrow(run, "window string, item_id string").distinct()


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    size: int = 10,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    block_windows: int = 200_000,
) -> DataFrame:
    """One row a document: its key, text, n_words, the hit spans of words (disjoint, sorted) and the
    distinct items that occur (sorted as strings).

    Windows are broadcast in blocks of about `block_windows` rows of at most `size` words, however
    many the benchmark has; every block is searched in all documents, one pass after another, each
    adding to the spans and items that the passes before it found."""
    spark = documents.sparkSession
    windows = kept(item_windows(benchmark, size, item_key, item_text), "windows")
    blocks = max(1, -(-windows.count() // block_windows))
    rows = two_columns(documents, key, text).withColumns(
        {
            "n_words": F.lit(0).cast("long"),
            "spans": F.array().cast("array<struct<first:int,last:int>>"),
            "item_ids": F.array().cast("array<string>"),
        }
    )
    schema = SCHEMA.format(key=dict(rows.dtypes)["key"])
    for k in range(blocks):
        part = windows.filter(F.expr(f"pmod(xxhash64(window, item_id), {blocks}) = {k}")).collect() if blocks > 1 else windows.collect()
        own = spark.sparkContext.broadcast([(r.window, r.item_id) for r in part])

        def run(batches, own=own):
            found = machines(own.value)
            for batch in sliced(batches):
                n, all_spans, all_items = [], [], []
                for body, spans, items in zip(*(batch.column(i).to_pylist() for i in (1, 3, 4)), strict=True):
                    w = words(body)
                    n.append(len(w))
                    got, ids = [], set()
                    for machine in found:
                        for start, value in machine.find(w):
                            got.append((start, start + machine.length - 1))
                            ids.update(value)
                    if got:
                        spans = merged([*got, *((s["first"], s["last"]) for s in spans)])
                        items = sorted({*items, *(i for i in ids if i is not None)})
                    all_spans.append(spans)
                    all_items.append(items)
                columns = [pa.array(n, pa.int64()), pa.array(all_spans, batch.schema.field(3).type), pa.array(all_items, batch.schema.field(4).type)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=batch.schema.names)

        if k:
            rows = kept(rows, "decontamination")
        rows = rows.mapInArrow(run, schema)
    return rows
