"""Stupid-backoff language model scores of documents under the counts of all other documents.

S(w | context) is c(context w) / c(context) where the n-gram occurs, else alpha times the score with
the context shortened by its first word; a single word scores c(w) / N, a word not seen elsewhere as
if seen once. Counts and N are of the whole corpus less the document's own occurrences, without which
every n-gram of the corpus would be seen.

Plan: documents become chunks of some million words, written once, in buckets of chunks. Each chunk explodes into rows of its
distinct n-grams (gram, chunk, n), a gram being a 64-bit hash. These rows are partitioned by the hash; the count
table of a partition is joined to its rows where they lie, as a window over the gram, so that they are moved
once. What that leaves, the count of each n-gram in other chunks, goes back to its chunk as lists in the order
of grams, a list for each part of the hashes and chunk, so that no gram is sent twice. There a document's own
occurrences are taken off and the log scores are summed per document. Rows grow with the corpus: a chunk has
one for each of its distinct n-grams, so a frequent n-gram has a row a chunk and not one an occurrence. No task
holds more than a chunk or a partition of hashes.

Defined cases: null and empty texts have no words and the log score 0. Repeated rows are documents of
their own, so they support each other. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .common import kept_by, two_columns, words

ALPHA = 0.4
#: Words of a chunk, rows of n-grams in an Arrow batch, and n-grams aimed at in a part of the hashes.
CHUNK_WORDS, BATCH_ROWS, PART_GRAMS = 1_000_000, 50_000, 1_000_000


def packed(x: np.ndarray) -> bytes:
    """Integers as compressed planes of bytes."""
    import zstandard

    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T
    return zstandard.ZstdCompressor(level=9).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(blob: bytes, kind: str) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(word: np.ndarray, document: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 to `order`, the hashes of the n-grams that end at each word; only places of at least n
    words into a document count (those from n - 1 on where n - 1 places back is the same document)."""
    out = [mixed(word)]
    for n in range(2, order + 1):
        h = np.zeros_like(word)
        h[1:] = mixed(out[-1][:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:] + np.uint64(n))
        out.append(h)
    return out


def inside(document: np.ndarray, n: int) -> np.ndarray:
    ok = np.zeros(len(document), bool)
    ok[n - 1 :] = document[n - 1 :] == document[: len(document) - n + 1]
    return ok


def chunks(documents: DataFrame, chunk_words: int) -> DataFrame:
    """(chunk, n_words, keys, sizes, vocabulary, word) with words as numbers in the chunk's vocabulary."""
    kind = dict(documents.dtypes)["key"]
    target = StructType.fromDDL(f"chunk long, n_words long, keys array<{kind}>, sizes binary, vocabulary binary, word binary")

    def run(batches):
        import xxhash
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        hashes: dict[bytes, int] = {}
        first = TaskContext.get().partitionId() << 32
        keys, sizes, found, total, k = [], [], [], 0, 0

        def made():
            h = np.concatenate([*found, np.zeros(0, np.uint64)])
            vocabulary, word = np.unique(h, return_inverse=True)
            row = [[first + k], [total], [keys], [packed(np.array(sizes, np.uint32))], [packed(vocabulary)], [packed(word.astype(np.uint32))]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = words(text.as_py())
                h = np.empty(len(own), np.uint64)
                for i, w in enumerate(own):
                    if (x := hashes.get(w)) is None:
                        if len(hashes) > 200_000:
                            hashes.clear()
                        x = hashes[w] = xxhash.xxh3_64_intdigest(w)
                    h[i] = x
                keys.append(key)
                sizes.append(len(own))
                found.append(h)
                total += len(own)
                if total >= chunk_words:
                    yield made()
                    keys, sizes, found, total, k = [], [], [], 0, k + 1
        if keys:
            yield made()

    return documents.mapInArrow(run, target)


def opened(sizes: bytes, vocabulary: bytes, word: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, word hashes, document of each word) of a chunk."""
    n = unpacked(sizes, "<u4").astype(np.int64)
    return n, unpacked(vocabulary, "<u8")[unpacked(word, "<u4")], np.repeat(np.arange(len(n)), n)


def all_grams(word: np.ndarray, document: np.ndarray, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The n-grams of all orders in a row, and the places of each order."""
    places = [np.flatnonzero(inside(document, n)) for n in range(1, order + 1)]
    return np.concatenate([h[p] for h, p in zip(grams(word, document, order), places, strict=True)]), places


def exploded(state: DataFrame, order: int) -> DataFrame:
    """(gram, chunk, n) for each distinct n-gram of a chunk."""

    def run(batches):
        for batch in batches:
            for chunk, *blobs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                _, word, document = opened(*blobs)
                h, n = np.unique(all_grams(word, document, order)[0], return_counts=True)
                for at in range(0, len(h), BATCH_ROWS):
                    part = slice(at, at + BATCH_ROWS)
                    columns = [pa.array(h[part].view(np.int64)), pa.array(np.full(len(h[part]), chunk)), pa.array(n[part].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, ["gram", "chunk", "n"])

    return state.select("chunk", "sizes", "vocabulary", "word").mapInArrow(run, "gram long, chunk long, n int")


def left_out(flat: np.ndarray, of: np.ndarray, more: np.ndarray) -> np.ndarray:
    """For each n-gram of a chunk its count in other documents: those of the chunk (`of` names the document of
    each) and, for the distinct n-grams in order, `more` in other chunks."""
    order = np.argsort(flat, kind="stable")  # within an n-gram, documents stay in order
    h, sorted_of = flat[order], of[order]
    new = np.concatenate([np.ones(min(1, len(h)), bool), h[1:] != h[:-1]])
    group = np.cumsum(new) - 1
    counts = np.bincount(group, minlength=len(more)) + more
    runs = np.flatnonzero(new | (np.diff(sorted_of, prepend=-1) != 0))
    del h, sorted_of, new
    own = np.diff(np.append(runs, len(flat)))
    left = np.empty(len(flat), np.int64)
    left[order] = counts[group] - np.repeat(own, own)
    return left


def log_scores(sizes: np.ndarray, word: np.ndarray, document: np.ndarray, more: np.ndarray, total: int, order: int, alpha: float) -> np.ndarray:
    """The summed log score of each document of a chunk."""
    flat, places = all_grams(word, document, order)
    left = left_out(flat, np.concatenate([document[p] for p in places]), more)
    del flat
    rest = np.maximum(1, total - sizes)[document]
    at, below, before = 0, np.zeros(len(word)), rest
    for k, p in enumerate(places):
        c = np.zeros(len(word), np.int64)
        c[p] = left[at : at + len(p)]
        at += len(p)
        if k == 0:
            below = np.log(np.maximum(c, 1)) - np.log(rest)
        else:
            context = np.ones(len(word), np.int64)
            context[1:] = before[:-1]
            seen = np.zeros(len(word), bool)
            seen[p] = c[p] > 0
            full = np.log(np.where(seen, c, 1)) - np.log(np.where(seen, context, 1))
            shorter = below.copy()
            shorter[p] += np.log(alpha)
            below = np.where(seen, full, shorter)
        before = c
    return np.bincount(document, below, len(sizes))


def score_documents(documents: DataFrame, order: int = 2, alpha: float = ALPHA, key: str = "doc_id", text: str = "text", chunk_words: int = CHUNK_WORDS, part_grams: int = PART_GRAMS) -> DataFrame:
    """One row a document: key, n_words, log_score (natural, summed over its words)."""
    kind = dict(documents.dtypes)[key]
    state = kept_by(chunks(two_columns(documents, key, text), chunk_words), "chunks", "chunk")
    total = state.agg(F.sum("n_words")).first()[0] or 0

    def score(chunk_rows, replies):
        import pandas as pd

        more = np.concatenate([np.zeros(0, np.int64), *replies.sort_values("part")["more"]]).astype(np.int64)
        out = [pd.DataFrame({"key": [], "n_words": [], "log_score": []})]
        for row in chunk_rows.itertuples():
            sizes, word, document = opened(row.sizes, row.vocabulary, row.word)
            out.append(pd.DataFrame({"key": list(row.keys), "n_words": sizes, "log_score": log_scores(sizes, word, document, more, total, order, alpha)}))
        return pd.concat(out[1:] or out)

    bits = max(1, (-(-total * order // part_grams) - 1).bit_length())
    part = F.shiftrightunsigned("gram", 64 - bits)
    rows = exploded(state, order).repartition(part).withColumn("part", part)
    elsewhere = F.sum("n").over(Window.partitionBy("part", "gram")) - F.col("n")
    counted = rows.select("part", "chunk", F.struct("gram", elsewhere.alias("more")).alias("row"))
    lists = counted.groupBy("part", "chunk").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    more = lists.select("part", "chunk", F.col("rows.more").alias("more"))
    return state.groupBy("chunk").cogroup(more.groupBy("chunk")).applyInPandas(score, f"key {kind}, n_words long, log_score double")
