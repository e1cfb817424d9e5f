"""MinHash near-dedup with Order MinHash sketches and verification by banded alignment.

Two texts are near copies if, of the shingles of five words of both, at least 0.8 align in order
(aligned / (all - aligned)). Texts of the same words are one node. A node's sketch has a key for each
of `tables` tables; nodes with a common key form a bucket, and of buckets of the same nodes one stays.

Buckets of up to `BLOCK` nodes are settled in one task each: all pairs are held against the bound that
common shingles set, and those that may reach the threshold are aligned until what belongs together is
joined. Larger buckets are dealt by a salted hash into blocks, which are settled in the same way. Links
are joined to components. Between the blocks of the larger buckets, pairs of different components
remain; an exact set-similarity join finds them: shingles get one global order, the rare ones first, and
near copies have a shingle in common among the first `n - ceil(0.8 n) + 1` of both, at places that leave
enough of both behind it. Changed shingles of near copies are rare and those of the text that they are
copies of are frequent, so this join makes few pairs where one text has a great many copies. Pairs found
are aligned and join components to classes. Nothing caps a bucket.

A pair that just reaches 0.8 shares a table's key with probability about 0.41, so all 24 tables miss
it three times in a million.

Defined cases: null and empty texts have no words and are a class of their own each. A text of fewer
than five words is one shingle. Repeated rows are copies of each other. A null key is the last in
order. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, in_few, kept, sent, sliced, spread, two_columns, words
from .components import components
from .order_minhash import SAMPLE, SHINGLE, SIMILARITY, TABLES, labelled, links_within, near, shingles, sketch

#: Nodes, and words, of a bucket that one task settles.
BLOCK, BLOCK_WORDS = 128, 4_000_000
#: Slots in which shingles are counted to order them, whatever the size of the corpus.
SLOTS = 1 << 20
#: Rows of a shingle that meet in one task.
TOKEN_ROWS = 4096


def node_of(own: list[bytes]) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(b" ".join(own))


def word_hashes(own: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh32_intdigest, own), np.uint32, len(own))


def prints(documents: DataFrame, tables: int, sample: int, size: int) -> DataFrame:
    """(key, node, n_words, sketch): node and sketch are null for texts of no words. Of equal texts in a
    task only the first has a sketch."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in sliced(batches):
            nodes, sizes, sketches = [], [], []
            for text in batch.column(1):
                own = words(text.as_py())
                node = node_of(own) if own else None
                nodes.append(node)
                sizes.append(len(own))
                if node is None or node in seen:
                    sketches.append(None)
                else:
                    if len(seen) < 50_000:
                        seen.add(node)
                    sketches.append(sketch(word_hashes(own), tables, sample, size).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.list_(pa.int64()))], ["key", "node", "n_words", "sketch"])

    return documents.mapInArrow(run, f"key {dict(documents.dtypes)['key']}, node binary, n_words long, sketch array<long>")


def members(own: DataFrame) -> DataFrame:
    """(bucket, block, blocks, node) of the buckets of several nodes, one of each set of equal buckets."""
    one = own.filter("sketch is not null").groupBy("node").agg(F.first("n_words").alias("n_words"), F.first("sketch").alias("sketch"))
    rows = one.select("node", "n_words", F.explode(F.array_distinct("sketch")).alias("bucket"))
    signs = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in range(2)]
    several = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("n_words"), *signs).filter("n > 1")
    parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("n_words") / BLOCK_WORDS)).cast("int")
    buckets = several.groupBy("n", "n_words", "x0", "x1").agg(F.min("bucket").alias("bucket")).select("bucket", parts.alias("blocks"))
    return rows.join(buckets, "bucket").select("bucket", F.pmod(F.xxhash64("bucket", "node"), "blocks").cast("int").alias("block"), "blocks", "node")


def sequences(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, words): the word hashes of one text for each of the nodes."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in sliced(batches):
            out, own_words = [], []
            for text in batch.column(0):
                own = words(text.as_py())
                if not own or (node := node_of(own)) in seen:
                    continue
                if len(seen) < 50_000:
                    seen.add(node)
                out.append(node)
                own_words.append(word_hashes(own).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(own_words, pa.binary())], ["node", "words"])

    found = documents.select("text").mapInArrow(run, "node binary, words binary")
    return found.join(sent(nodes, nodes.count()), "node", "left_semi").groupBy("node").agg(F.first("words").alias("words"))


def groups_of(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[list[tuple]]:
    """Rows in sorted order, gathered while the first `by` columns are the same."""
    last, rows = None, []
    for batch in sliced(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:by] != last and rows:
                yield rows
                rows = []
            last = row[:by]
            rows.append(row[by:])
    if rows:
        yield rows


def settled(rows: DataFrame, texts: DataFrame, least: float, size: int) -> DataFrame:
    """Links (a, b) that join the near copies of each block of the rows of `members`."""

    def run(batches):
        for group in groups_of(batches, 2):
            found = links_within([np.frombuffer(w, np.uint32) for _, w in group], least, size)
            if found:
                ends = [pa.array([group[pair[k]][0] for pair in found], pa.binary()) for k in range(2)]
                yield pa.RecordBatch.from_arrays(ends, ["a", "b"])

    both = rows.join(texts, "node").select("bucket", "block", "node", "words")
    return spread(both, rows.count(), 2_000, "bucket", "block").sortWithinPartitions("bucket", "block", "node").mapInArrow(run, "a binary, b binary")


def shingle_counts(texts: DataFrame, size: int) -> np.ndarray:
    """How often shingles occur, counted in a fixed number of slots of their hashes."""

    def run(batches):
        counts = np.zeros(SLOTS, np.int64)
        for batch in sliced(batches):
            for w in batch.column(1):
                slots, n = np.unique(labelled(shingles(np.frombuffer(w.as_py(), np.uint32), size)) % np.uint64(SLOTS), return_counts=True)
                counts[slots.astype(np.int64)] += n
        slots = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(counts[slots], pa.int64())], ["slot", "n"])

    found = texts.select("node", "words").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def beginnings(texts: DataFrame, least: float, size: int) -> DataFrame:
    """(token, place, node, label, size) of the first labelled shingles of texts (node, label, words), the
    rarest first: near copies have one of them in common."""
    counts = texts.sparkSession.sparkContext.broadcast(shingle_counts(texts, size))

    def run(batches):
        for batch in sliced(batches):
            tokens, places, rows, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [], []
            for w in batch.column(2):
                x = labelled(shingles(np.frombuffer(w.as_py(), np.uint32), size))
                n = len(x) - int(np.ceil(least * len(x) - 1e-9)) + 1
                order = np.lexsort((x, counts.value[(x % np.uint64(SLOTS)).astype(np.int64)]))[:n]
                tokens.append(x[order])
                places.append(np.arange(len(order)))
                rows.append(len(order))
                sizes.append(len(x))
            at = pa.array(np.repeat(np.arange(len(rows)), rows))
            columns = [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(places)), batch.column(0).take(at), batch.column(1).take(at), pa.array(np.repeat(np.array(sizes, np.int64), rows))]
            yield pa.RecordBatch.from_arrays(columns, ["token", "place", "node", "label", "size"])

    return texts.select("node", "label", "words").mapInArrow(run, "token long, place long, node binary, label binary, size long")


def across(texts: DataFrame, least: float, size: int) -> DataFrame:
    """Distinct (a, b) of texts (node, label, words) with different labels that may be near copies: they have
    one of their first shingles in common, with enough of both behind it."""
    first = kept(beginnings(texts, least, size), "beginnings")
    tokens = first.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"))
    tokens = tokens.filter("low <> high").select("token", F.ceil(F.col("n") / TOKEN_ROWS).cast("int").alias("salts"))
    mixed = kept(first.join(tokens, "token"), "mixed")
    a = mixed.select("token", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *(F.col(c).alias(f"{c}_a") for c in ("place", "node", "label", "size")))
    b = mixed.withColumn("salt", F.pmod(F.xxhash64("node"), "salts").cast("int"))
    behind = F.least(F.col("size_a") - F.col("place_a"), F.col("size") - F.col("place"))
    enough = behind >= least / (1 + least) * (F.col("size_a") + F.col("size")) - 1e-6
    pairs = a.join(b, ["token", "salt"]).filter((F.col("label_a") < F.col("label")) & enough)
    out = kept(pairs.select(F.col("node_a").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    dropped(first, mixed)
    return out


def compared(pairs: DataFrame, texts: DataFrame, least: float, size: int) -> DataFrame:
    """Those of the pairs (a, b) that are near copies."""

    def run(batches):
        for batch in sliced(batches):
            both = [[shingles(np.frombuffer(w.as_py(), np.uint32), size) for w in pair] for pair in zip(batch.column(2), batch.column(3), strict=True)]
            good = pa.array([near(a, b, least) for a, b in both], pa.bool_())
            yield batch.select([0, 1]).filter(good)

    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("words").alias("wa")), "a")
    both = with_a.join(texts.select(F.col("node").alias("b"), F.col("words").alias("wb")), "b").select("a", "b", "wa", "wb")
    return spread(both, pairs.count(), 2_000, "a", "b").mapInArrow(run, "a binary, b binary")


def labelled_nodes(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """`nodes` with the label of each, itself where it has none."""
    return nodes.join(sent(labels, labels.count()), "node", "left").withColumn("label", F.coalesce("label", "node"))


def classes_of(own: DataFrame, documents: DataFrame, least: float, size: int) -> DataFrame | None:
    """(node, label) of the nodes that have near copies, or None if no two nodes share a bucket."""
    rows = kept(members(own), "members")
    if rows.isEmpty():
        return None
    texts = kept(sequences(documents, rows.select("node").distinct()), "texts")
    links = kept(settled(rows, texts, least, size), "links")
    labels = components(links)
    large = kept(in_few(rows.filter("blocks > 1").select("node").distinct(), rows.count()), "large")
    n = large.count()
    if n:
        pairs = across(labelled_nodes(texts.join(sent(large, n), "node", "left_semi"), labels), least, size)
        more = kept(compared(pairs, texts, least, size), "links")
        few = labels.count()
        ends = more
        for end in ("a", "b"):
            of = sent(labels.select(F.col("node").alias(end), F.col("label").alias(f"l{end}")), few)
            ends = ends.join(of, end, "left").withColumn(f"l{end}", F.coalesce(f"l{end}", end))
        upper = components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b")))
        every = labels.union(more.select("a", "a").union(more.select("b", "b"))).groupBy("node").agg(F.min_by("label", F.col("node") == F.col("label")).alias("label"))
        joined = every.join(sent(upper.select(F.col("node").alias("label"), F.col("label").alias("up")), upper.count()), "label", "left")
        joined = kept(joined.select("node", F.coalesce("up", "label").alias("label")), "labels")
        dropped(pairs, more, upper, labels)
        labels = joined
    dropped(rows, texts, links, large)
    return labels


def near_duplicates(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least: float = SIMILARITY,
    size: int = SHINGLE,
    tables: int = TABLES,
    sample: int = SAMPLE,
) -> DataFrame:
    """One row a document: key, node (a digest of its words), class_key and class_node (key and node of
    the first document of its class, the smallest key) and class_size."""
    rows = two_columns(documents, key, text)
    own = kept(prints(rows, tables, sample, size), "prints")
    labels = classes_of(own, rows, least, size)
    named = own.filter("node is not null").select("key", "node")
    named = named.withColumn("class", F.col("node")) if labels is None else labelled_nodes(named, labels).withColumnRenamed("label", "class")
    first = named.groupBy("class").agg(F.min(F.struct(F.col("key").isNull().alias("last"), "key", "node")).alias("first"), F.count(F.lit(1)).alias("class_size"))
    out = named.join(first, "class").select("key", "node", F.col("first.key").alias("class_key"), F.col("first.node").alias("class_node"), "class_size")
    alone = own.filter("node is null").select("key", "node", F.col("key").alias("class_key"), F.col("node").alias("class_node"), F.lit(1).cast("long").alias("class_size"))
    return out.unionByName(alone)
