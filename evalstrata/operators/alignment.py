"""Word alignment of answers and references, and what the errors are.

Of equally short alignments the one is taken that, from the end back, prefers a match or substitution to
a deletion and that to an insertion. Totals of errors don't depend on this choice, their split into
kinds may.
"""

from __future__ import annotations

from itertools import accumulate
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions.rows import ROWS, common_ends, form, places, sliced, small_batches, step
from ..functions.text import VIEWS, normalized, words

OPS = "array<struct<op:string,ref:string,hyp:string>>"
#: Buckets of reference length in words.
LENGTHS = (("1-5", 1, 5), ("6-15", 6, 15), ("16-30", 16, 30), ("31+", 31, None))
TOP, EXAMPLES = 10, 3


def align(ref: list[str], hyp: list[str]) -> list[tuple[str, str | None, str | None]]:
    """(op, reference word, answer word) of a shortest alignment; common ends are set aside first."""
    head, tail = common_ends(ref, hyp)
    same = lambda ws: [("equal", w, w) for w in ws]
    between = middle(ref[head : len(ref) - tail], hyp[head : len(hyp) - tail])
    return same(ref[:head]) + between + same(ref[len(ref) - tail :] if tail else [])


def middle(r: list[str], h: list[str]) -> list[tuple[str, str | None, str | None]]:
    """The same for any two lists. Columns of the table of distances are bits; every so many of them are kept
    and those between are made again on the way back, so memory grows with n to the power 1.5 in bits."""
    if not r or not h:
        return [("delete", w, None) for w in r] + [("insert", None, w) for w in h]
    full, at = (1 << len(r)) - 1, places(r)
    every, state, kept = isqrt(len(h)) + 1, (full, 0), []
    for j, w in enumerate(h):
        if j % every == 0:
            kept.append(state)
        state = step(at.get(w, 0), *state, full)
    i, j, out = len(r), len(h), []
    own, start = [], len(h)
    known = len(h) + state[0].bit_count() - state[1].bit_count()
    while i and j:
        if j <= start:
            start = (j - 1) // every * every
            own = [kept[start // every]]
            for w in h[start : j]:
                own.append(step(at.get(w, 0), *own[-1], full))
        a, b = r[i - 1], h[j - 1]
        if a == b:
            i, j = i - 1, j - 1
            out.append(("equal", a, b))
            continue
        pv, mv = own[j - 1 - start]
        low = (1 << (i - 1)) - 1
        if (j - 1) + (pv & low).bit_count() - (mv & low).bit_count() == known - 1:
            i, j = i - 1, j - 1
            out.append(("substitute", a, b))
        elif own[j - start][0] >> (i - 1) & 1:
            i -= 1
            out.append(("delete", a, None))
        else:
            j -= 1
            out.append(("insert", None, b))
        known -= 1
    out += [("delete", w, None) for w in r[:i][::-1]] + [("insert", None, w) for w in h[:j][::-1]]
    return out[::-1]


def aligned(pairs: DataFrame, ref: str = "r", hyp: str = "p") -> DataFrame:
    """Utterances whose reference has words, with `ops`: the operations that turn the reference into the answer."""
    small_batches(pairs.sparkSession)

    @F.arrow_udf(OPS)
    def f(r: pa.Array, h: pa.Array) -> pa.Array:
        parts = []
        for k in range(0, max(len(r), 1), ROWS):
            ops = [align((x or "").split(), (y or "").split()) for x, y in zip(r.slice(k, ROWS).to_pylist(), h.slice(k, ROWS).to_pylist(), strict=True)]
            flat = [pa.array([o[c] for own in ops for o in own], pa.string()) for c in range(3)]
            ends = pa.array([0, *accumulate(map(len, ops))], pa.int32())
            parts.append(pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(flat, ["op", "ref", "hyp"])))
        return pa.concat_arrays(parts)

    return pairs.filter(F.size(words(F.col(ref))) > 0).withColumn("ops", f(F.col(ref), F.col(hyp)))


def errors(scored: DataFrame, view: str = "tone_aware") -> DataFrame:
    """(id, pos, status, hits, ops) of scored examples whose reference has words under a view: how many words
    are right, and the operations that aren't `equal`. Normal forms are made on the way, not passed on."""
    small_batches(scored.sparkSession)
    lang = F.col("lang").cast("string") if "lang" in scored.columns else F.lit(None).cast("string")
    has = scored.filter(F.col("reference").isNotNull()).select("id", "pos", "status", lang.alias("_lang"), "answer", "reference")
    target = StructType([*has.select("id", "pos", "status").schema.fields, *StructType.fromDDL(f"hits long, ops {OPS}").fields])
    arrow, tones = to_arrow_schema(target), VIEWS[view]

    def run(batches):
        for batch in sliced(batches):
            lang, answer, reference = (batch.column(k).to_pylist() for k in (3, 4, 5))
            at, hits, ops = [], [], []
            for k, (a, r, x) in enumerate(zip(answer, reference, lang, strict=True)):
                r_words = form(r, tones, x == "ha").split()
                if not r_words:
                    continue
                own = [] if a == r else [o for o in align(r_words, form(a, tones, x == "ha").split()) if o[0] != "equal"]
                at.append(k)
                hits.append(len(r_words) - sum(o[1] is not None for o in own))
                ops.append([dict(zip(("op", "ref", "hyp"), o, strict=True)) for o in own])
            kept = [batch.column(c).take(pa.array(at, pa.int64())) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(hits, pa.int64()), pa.array(ops, arrow.field("ops").type)], schema=arrow)

    return has.mapInArrow(run, target)


def operations(rows: DataFrame) -> DataFrame:
    """A row for each operation: (id, pos, op, ref, hyp, tone_only)."""
    o = rows.select("id", "pos", F.explode("ops").alias("o")).select("id", "pos", "o.op", "o.ref", "o.hyp")
    bare = lambda c: normalized(F.col(c), "strip")
    return o.withColumn("tone_only", (F.col("op") == "substitute") & (bare("ref") == bare("hyp")))


def totals(ops: DataFrame) -> DataFrame:
    op = F.col("op")
    return ops.agg(
        F.count_if(op == "equal").alias("hits"),
        F.count_if(op == "substitute").alias("substitutions"),
        F.count_if(op == "delete").alias("deletions"),
        F.count_if(op == "insert").alias("insertions"),
        F.count_if("tone_only").alias("tone_only_substitutions"),
    )


def length_bucket(n: Column) -> Column:
    out = F.lit(LENGTHS[-1][0])
    for label, _, high in reversed(LENGTHS[:-1]):
        out = F.when(n <= high, label).otherwise(out)
    return out


def wer_by_length(pairs: DataFrame, edits: Column, n: Column) -> DataFrame:
    """(bucket, n, wer) pooled within buckets of reference length; buckets without utterances are left out."""
    own = pairs.select(edits.alias("e"), n.alias("w")).filter("w > 0")
    return own.groupBy(length_bucket(F.col("w")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), (F.sum("e") / F.sum("w")).alias("wer"))


def top_errors(ops: DataFrame, op: str, k: int = TOP, examples: bool = True) -> DataFrame:
    """The k most frequent errors of a kind, by count, then words, with the first ids in dataset order; without
    those, a single pass."""
    own = ops.filter(F.col("op") == op)
    best = own.groupBy("ref", "hyp").agg(F.count(F.lit(1)).alias("n"), F.bool_or("tone_only").alias("tone_only")).orderBy(F.desc("n"), "ref", "hyp").limit(k)
    if not examples:
        return best
    on = F.col("a.ref").eqNullSafe(F.col("b.ref")) & F.col("a.hyp").eqNullSafe(F.col("b.hyp"))
    hits = own.alias("a").join(F.broadcast(best.alias("b")), on).select("a.ref", "a.hyp", "a.id", "a.pos").groupBy("ref", "hyp", "id").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("ref", "hyp").orderBy("pos")
    ids = hits.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= EXAMPLES).groupBy("ref", "hyp").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda s: s["id"]).alias("examples"))
    j = best.alias("b").join(ids.alias("i"), F.col("b.ref").eqNullSafe(F.col("i.ref")) & F.col("b.hyp").eqNullSafe(F.col("i.hyp")), "left")
    return j.select("b.*", "i.examples").orderBy(F.desc("n"), "ref", "hyp")


