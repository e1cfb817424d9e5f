"""Paired statistics of two runs: bootstrap intervals, wins and losses, McNemar, slices, verdicts."""

from __future__ import annotations

from math import comb, exp, lgamma, log, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

EPSILON = 1e-12
#: Cells of the matrix of draws that are held at once.
CELLS = 4_000_000
MIN_SLICE = 30
BUILTIN_FIELDS = ("lang", "length", "has_number")


def pairs(base: DataFrame, candidate: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Long values of both runs, only where both have one: (id, pos, view, metric, base, candidate)."""
    on = on or ["id", "view", "metric"]
    b = base.select(*on, "pos", F.col("value").alias("base")).filter(F.col("base").isNotNull())
    c = candidate.select(*on, F.col("value").alias("candidate")).filter(F.col("candidate").isNotNull())
    return b.join(c, on)


def wide_pairs(base: DataFrame, candidate: DataFrame, names: list[str]) -> DataFrame:
    """`pairs` of two runs that have a column for each metric: joined once for all metrics, stacked after that."""
    own = lambda side: F.struct(*(F.col(f"`{n}`").alias(f"m{k}") for k, n in enumerate(names))).alias(side)
    b, c = base.select("id", "view", "pos", own("b")), candidate.select("id", "view", own("c"))
    stacked = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(f"b.m{k}").alias("base"), F.col(f"c.m{k}").alias("candidate")) for k, n in enumerate(names))))
    out = b.join(c, ["id", "view"]).select("id", "view", "pos", stacked.alias("_s")).select("id", "view", "_s.metric", "pos", "_s.base", "_s.candidate")
    return out.filter(F.col("base").isNotNull() & F.col("candidate").isNotNull())


def outcomes(paired: DataFrame, by: list[str], sign: Column | None = None) -> DataFrame:
    """n, means, delta, wins, ties, losses; and of 0/1 values those that only one run has right."""
    d = (F.col("candidate") - F.col("base")) * (F.lit(1.0) if sign is None else sign)
    binary = F.bool_and(F.col("base").isin(0.0, 1.0) & F.col("candidate").isin(0.0, 1.0))
    return paired.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("base").alias("base_mean"),
        F.avg("candidate").alias("candidate_mean"),
        F.avg(F.col("candidate") - F.col("base")).alias("delta"),
        F.count_if(d > EPSILON).alias("wins"),
        F.count_if(F.abs(d) <= EPSILON).alias("ties"),
        F.count_if(d < -EPSILON).alias("losses"),
        F.when(binary, F.count_if((F.col("base") == 1) & (F.col("candidate") == 0))).alias("base_only"),
        F.when(binary, F.count_if((F.col("base") == 0) & (F.col("candidate") == 1))).alias("candidate_only"),
    )


#: Pairs that differ up to which the p-value is a sum of whole numbers.
COUNTED = 1_000


def mcnemar_p(base_only: int, candidate_only: int) -> float:
    """Two-sided exact binomial p-value."""
    n, least = base_only + candidate_only, min(base_only, candidate_only)
    if not n:
        return 1.0
    if n <= COUNTED:
        return min(1.0, 2 * sum(comb(n, k) for k in range(least + 1)) / 2**n)
    first = half_binomial(n, least)
    total = part = 1.0
    for k in range(least, 0, -1):  # each term from the one above, until they no longer count
        part *= k / (n - k + 1)
        if part < total * 1e-18:
            break
        total += part
    return min(1.0, 2 * first * total)


def half_binomial(n: int, k: int) -> float:
    """comb(n, k) / 2**n for large n by Loader's expansion, to some 1e-13 of its value."""
    if not 0 < k < n:
        return 0.5**n
    rest = lambda x: lgamma(x + 1) - (x + 0.5) * log(x) + x - log(2 * pi) / 2 if x < 16 else (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / x / x) / x / x) / x / x) / x / x) / x

    def deviance(x: int) -> float:
        """x log(x / m) + m - x for m = n / 2, without cancellation where both are near."""
        m = n / 2
        v = (x - m) / (x + m)
        if abs(v) >= 0.1:
            return x * log(x / m) + m - x
        total, term, j = (x - m) * v, 2 * x * v, 1
        while True:
            term *= v * v
            more = total + term / (2 * j + 1)
            if more == total:
                return more
            total, j = more, j + 1

    return exp(rest(n) - rest(k) - rest(n - k) - deviance(k) - deviance(n - k)) * sqrt(n / (2 * pi * k * (n - k)))


def mcnemar_column(base_only: Column, candidate_only: Column) -> Column:
    """The same, vectorised over groups."""
    @F.pandas_udf("double")
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else mcnemar_p(int(x), int(y)) for x, y in zip(a, b, strict=True)])

    return f(base_only, candidate_only)


def draw(diffs, draws: int, seed: int, confidence: float) -> tuple[float, float, float]:
    """Mean and interval of the mean of resampled differences."""
    n = len(diffs)
    rng = np.random.default_rng(seed)
    rows = max(1, min(draws, CELLS // n))
    means = np.empty(draws)
    whole = np.isin(diffs, (-1.0, 0.0, 1.0)).all()
    taken = diffs.astype(np.int8) if whole else diffs  # small, so it stays in the processor's cache; sums are exact
    for start in range(0, draws, rows):
        stop = min(start + rows, draws)
        own = taken[rng.integers(0, n, size=(stop - start, n))]
        means[start:stop] = own.sum(axis=1, dtype=np.int64) / n if whole else own.mean(axis=1)
    low, high = np.quantile(means, [(1 - confidence) / 2, (1 + confidence) / 2])
    return float(diffs.mean()), float(low), float(high)


def bootstrap(paired: DataFrame, by: list[str], draws: int = 1000, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """Exact paired bootstrap of each group in dataset order: (by, n, delta, low, high). A group is held by
    one task; `poisson_bootstrap` has no such limit."""
    return tested(paired, by, 1, draws, seed, confidence).select(*by, "n", "delta", "low", "high")


def tested(paired: DataFrame, by: list[str], least: int = 1, draws: int = 1000, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """`outcomes`, the first position and the interval of `bootstrap` of each group, from one pass and one
    shuffle; groups of fewer than `least` have no interval. A group is held by one task, as in `bootstrap`."""
    kinds = dict(paired.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + f", n long, base_mean double, candidate_mean double, delta double, wins long, ties long, losses long, base_only long, candidate_only long, first_pos {kinds['pos']}, low double, high double"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def f(key, table):
        pos, base, candidate = (table.column(c).to_numpy() for c in ("pos", "base", "candidate"))
        order = np.argsort(pos, kind="stable")
        base, candidate = base[order].astype(float), candidate[order].astype(float)
        d, n = candidate - base, len(base)
        binary = bool(np.isin(base, (0.0, 1.0)).all() and np.isin(candidate, (0.0, 1.0)).all())
        only = [int(((base == x) & (candidate == 1 - x)).sum()) if binary else None for x in (1, 0)]
        _, low, high = draw(d, draws, seed, confidence) if n >= least else (None, None, None)
        counts = [int((d > EPSILON).sum()), int((abs(d) <= EPSILON).sum()), int((d < -EPSILON).sum())]
        row = [*(k.as_py() for k in key), n, base.mean(), candidate.mean(), d.mean(), *counts, *only, pos[order[0]], low, high]
        return pa.Table.from_arrays([pa.array([x], t.type) for x, t in zip(row, arrow, strict=True)], schema=arrow)

    # small in bytes and dear in time: dealt explicitly, as adaptive execution would put all groups in one task
    dealt = paired.select(*by, "pos", "base", "candidate").repartition(int(paired.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
    return dealt.groupBy(*by).applyInArrow(f, schema)


def poisson_bootstrap(paired: DataFrame, by: list[str], draws: int = 1000, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """Bootstrap for groups of any size: each row has in each draw a Poisson(1) weight that its position,
    the draw and the seed decide. Equal differences of a group and of one of 1,024 strata of positions
    are summed before they are weighed, so Python sees no more rows than that; the weighted sums of all
    draws are then added up. Not the same draws as `bootstrap`. The
    mean difference comes from the same sums, so the pairs are made once."""
    keys = dict(paired.dtypes)
    stratum = F.pmod(F.xxhash64("pos"), F.lit(1024))
    strata = paired.groupBy(*by, stratum.alias("_s"), (F.col("candidate") - F.col("base")).alias("_d")).agg(F.count(F.lit(1)).alias("_c"))
    schema = ", ".join(f"`{c}` {keys[c]}" for c in by) + ", _n long, _d double, _w array<double>, _x array<double>"

    def partial(batches):
        for rows in batches:
            out = []
            for key, own in rows.groupby(by, dropna=False, sort=False):
                w, x = np.zeros(draws), np.zeros(draws)
                for s, d, c in zip(own["_s"], own["_d"], own["_c"], strict=True):
                    k = np.random.default_rng([seed, int(s), abs(hash(float(d))) % 2**32]).poisson(c, draws)
                    w += k
                    x += k * d
                out.append([*(key if isinstance(key, tuple) else (key,)), int(own["_c"].sum()), float((own["_c"] * own["_d"]).sum()), w.tolist(), x.tolist()])
            yield pd.DataFrame(out, columns=[*by, "_n", "_d", "_w", "_x"])

    parts = strata.mapInPandas(partial, schema)
    cells = parts.select(*by, "_n", "_d", F.posexplode(F.arrays_zip("_w", "_x")).alias("_k", "_v"))
    per_draw = cells.groupBy(*by, "_k").agg(F.sum("_n").alias("n"), (F.sum("_d") / F.sum("_n")).alias("delta"), (F.sum("_v._x") / F.sum("_v._w")).alias("mean"))
    tail = (1 - confidence) / 2
    ends = per_draw.groupBy(*by).agg(F.max("n").alias("n"), F.max_by("delta", -F.col("_k")).alias("delta"), F.percentile("mean", F.lit(tail)).alias("low"), F.percentile("mean", F.lit(1 - tail)).alias("high"))
    return ends.select(*by, "n", "delta", "low", "high")


def verdict(low: Column, high: Column, higher: Column | bool = True) -> Column:
    """Improved or regressed only if the whole interval lies on one side of zero."""
    higher = F.lit(higher) if isinstance(higher, bool) else higher
    up, down = F.when(higher, "improved").otherwise("regressed"), F.when(higher, "regressed").otherwise("improved")
    return F.when(low > 0, up).when(high < 0, down).otherwise("no clear change")


def slice_value(field: str, meta: Column | None = None) -> Column:
    """The bucket of an example: by language, reference length, whether it has a digit, or a meta field."""
    ref = F.coalesce("reference", F.lit(""))
    if field == "lang":
        return F.coalesce("lang", F.lit("(none)"))
    if field == "length":
        # fifteen words and a sixteenth are told apart by the first pieces
        n = F.size(F.filter(F.split(ref, r"(?U)[\s\x1c-\x1f]+", 18), lambda w: w != ""))
        return F.when(n <= 5, "short (<=5 words)").when(n <= 15, "medium (6-15 words)").otherwise("long (>15 words)")
    if field == "has_number":
        return F.when(ref.rlike(r"\p{Nd}"), "yes").otherwise("no")
    return F.coalesce((F.col(field) if meta is None else meta).cast("string"), F.lit("(missing)"))


def sliced(paired: DataFrame, examples: DataFrame, fields: list[str]) -> DataFrame:
    """Paired values with (field, bucket), a row for each field."""
    buckets = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), slice_value(f).alias("bucket")) for f in fields)))
    return paired.join(examples.select("id", buckets.alias("_b")).select("id", "_b.field", "_b.bucket"), "id")


def slices(cut: DataFrame, higher: bool = True, least: int = MIN_SLICE, draws: int = 1000, seed: int = 0) -> DataFrame:
    """(field, bucket, n, means, delta, low, high, status), judged only from `least` examples on."""
    by = ["field", "bucket"]
    found = tested(cut, by, least, draws, seed)
    enough = F.col("n") >= least
    status = F.when(enough, verdict(F.col("low"), F.col("high"), higher)).otherwise("insufficient data")
    return found.select(*by, "n", "base_mean", "candidate_mean", F.when(enough, F.col("delta")).alias("delta"), "low", "high", "first_pos", status.alias("status"))


def flag_changes(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """(name, base, candidate, delta) of the flag counts (name, n) of two runs."""
    b, c = base.select("name", F.col("n").alias("base")), candidate.select("name", F.col("n").alias("candidate"))
    zero = F.lit(0).cast("long")
    both = b.join(c, "name", "full").select("name", F.coalesce("base", zero).alias("base"), F.coalesce("candidate", zero).alias("candidate"))
    return both.withColumn("delta", F.col("candidate") - F.col("base"))
