"""Token counts from counts of distinct pre-tokens.

The corpus is cut into pre-tokens twice. The first pass gives the distinct ones with their
frequencies; the library's tokenizer counts the pieces of each once. The second pass joins those
counts to the frequencies of pre-tokens within each document and sums; ids of texts are never made.
The most frequent pre-tokens (a bounded number of bounded length) are joined by a table sent to every
executor, all others by a shuffle.

Defined cases: null and empty texts have 0 bytes and 0 tokens. Special strings in a text are one token
each, as the library has it by default. Repeated rows are counted each; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import here, kept, sliced, two_columns

#: Characters that are letters, numbers, blanks or others to the library and to `regex` alike. Texts
#: with any other are cut by the library itself.
ALIKE = r"[\x00-՗、-ヿ一-鿿가-힣]*+"
#: At most so many distinct pre-tokens are held before they are passed on.
FLUSH = 100_000


class PreTokens:
    """Cuts texts as the tokenizer does before its merges."""

    def __init__(self, path: str, special: tuple[str, ...]):
        import public_tokenizers
        import regex

        self.path = path
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.cut = regex.compile(public_tokenizers.PATTERN).findall
        self.alike = regex.compile(ALIKE).fullmatch

    @cached_property
    def tokenizer(self):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def of(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text and the number of special strings in it."""
        if self.special is None or not self.special.search(text):
            return self._cut(text), 0
        segments = self.special.split(text)
        return [p for s in segments for p in self._cut(s)], len(segments) - 1

    def _cut(self, text: str) -> list[str]:
        if self.alike(text):
            return self.cut(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, pretokens: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch(pretokens, add_special_tokens=False)]


@lru_cache(2)
def pretokens(path: str, special: tuple[str, ...]) -> PreTokens:
    """One for each worker process."""
    return PreTokens(path, special)


def count_tokens(
    documents: DataFrame,
    tokenizer: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    head: int = 150_000,
    head_chars: int = 64,
) -> DataFrame:
    """One row a document: key, n_bytes, n_tokens. The table sent to executors has at most `head`
    pre-tokens of at most `head_chars` characters."""
    from tokenizers import Tokenizer

    path = tokenizer or here("byte_bpe_50k.json")
    special = tuple(t.content for t in Tokenizer.from_file(path).get_added_tokens_decoder().values())
    spark = documents.sparkSession
    rows = two_columns(documents, key, text)

    def distinct(batches):
        cut, counts = pretokens(path, special).of, Counter()
        flushed = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])
        for batch in batches:
            for value in batch.column(1):
                if t := value.as_py():
                    counts.update(cut(t)[0])
                    if len(counts) > FLUSH:
                        yield flushed()
                        counts.clear()
        yield flushed()

    def count(batches):
        pieces = pretokens(path, special).pieces
        for batch in sliced(batches, 2_000):
            n = pieces(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32())], ["token", "n", "pieces"])

    tokens = rows.mapInArrow(distinct, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counted = kept(tokens.mapInArrow(count, "token string, n long, pieces int"), "pieces")
    short = counted.filter(F.length("token") <= head_chars).withColumn("step", F.floor(8 * F.log2("n")))
    least, total = None, 0
    for r in short.groupBy("step").count().orderBy(F.desc("step")).collect():  # some hundred steps at most
        total += r["count"]
        if total > head:
            break
        least = r.step
    frequent = short.filter(F.col("step") >= F.lit(least)).select("token", "pieces").toArrow()
    known = spark.sparkContext.broadcast(dict(zip(frequent.column(0).to_pylist(), frequent.column(1).to_pylist(), strict=True)))

    def per_document(batches):
        cut, pieces = pretokens(path, special).of, known.value
        for batch in sliced(batches):
            size, sums, rest = [], [], []
            for t in batch.column(1).to_pylist():
                t = t or ""
                own, total = cut(t)  # a special string is one token
                left = []
                for token, n in Counter(own).items():
                    if (p := pieces.get(token)) is None:
                        left.append({"token": token, "n": n})
                    else:
                        total += n * p
                size.append(len(t.encode()))
                sums.append(total)
                rest.append(left)
            columns = [pa.array(size, pa.int64()), pa.array(sums, pa.int64()), pa.array(rest, pa.list_(pa.struct([("token", pa.string()), ("n", pa.int64())])))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["key", "row", "n_bytes", "known", "rest"])

    schema = f"key {dict(rows.dtypes)['key']}, row long, n_bytes long, known long, rest array<struct<token:string,n:long>>"
    partial = kept(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(per_document, schema), "frequencies")
    rest = partial.select("row", F.explode("rest").alias("r")).select("row", "r.token", "r.n")
    more = rest.join(counted.select("token", "pieces"), "token").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    return partial.join(more, "row", "left").select("key", "n_bytes", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_tokens"))
