"""Scoring a run: examples joined to answers, metrics under both views, counts, latencies.

Frames: examples (id, pos, reference, lang, ...), results (id, prediction, latency_ms, error), one row an
id. Values are a long table (id, pos, view, metric, value); wide maps are made only for export.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..errors import ConfigError
from ..functions import metrics as m
from ..functions import rows
from ..functions.text import VIEWS, normalized_columns, words


def answered(examples: DataFrame, results: DataFrame) -> DataFrame:
    """Every example with `status` (ok, failed, missing), `answer` (empty unless ok) and latency_ms."""
    r = results.select("id", "prediction", "latency_ms", "error", F.lit(True).alias("_there"))
    status = F.when(F.col("_there").isNull(), "missing").when(F.col("error").isNotNull(), "failed").otherwise("ok")
    joined = examples.join(r, "id", "left").withColumn("status", status)
    answer = F.when(F.col("status") == "ok", F.coalesce("prediction", F.lit(""))).otherwise("")
    return joined.withColumn("answer", answer).withColumn("latency_ms", F.when(F.col("status") == "ok", F.col("latency_ms"))).drop("_there")


def run_counts(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    s = F.col("status")
    return scored.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(s == "ok").alias("n_ok"),
        F.count_if(s == "failed").alias("n_failed"),
        F.count_if(s == "missing").alias("n_missing"),
    )


def latency(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Of ok records with a latency; null if there are none."""
    x = "latency_ms"
    return scored.groupBy(*(by or [])).agg(F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("p50"), F.percentile(x, F.lit(0.95)).alias("p95"), F.max(x).alias("max"))


def check_metrics(task: str, names: list[str]) -> None:
    """Metrics that exist, once each, and fit the task."""
    if len({*names}) < len(names):
        raise ConfigError("A metric is given more than once.")
    unknown = [n for n in names if n not in m.KNOWN and n not in CUSTOM]
    if unknown:
        raise ConfigError(f"Unknown metric {unknown[0]!r}.", f"Available: {', '.join(sorted(m.KNOWN))}.")
    misused = sorted({*names} & m.CLASSIFICATION_ONLY)
    if misused and task != "classification":
        raise ConfigError(f"{', '.join(misused)}: only for classification.", "Pick exact_match, chrf, wer or cer.")


#: Custom metrics by name: (column builder or Python function, whether higher is better).
CUSTOM: dict[str, tuple[Callable, bool]] = {}


def register_metric(fn: Callable, name: str | None = None, higher_is_better: bool | None = None, python: bool = False) -> str:
    """Adds a metric. `fn(prediction, reference, row)` builds a column; with `python` it takes two strings
    and a dict and runs vectorised over Arrow batches. Built-in names are refused."""
    name = name or getattr(fn, "__name__", "")
    if not name or name == "<lambda>" or "@" in name:
        raise ConfigError("A custom metric needs a plain name.")
    if name in m.KNOWN:
        raise ConfigError(f"{name!r} is a built-in metric.", "Rename the function.")
    better = getattr(fn, "higher_is_better", True) if higher_is_better is None else higher_is_better
    CUSTOM[name] = (_vectorised(fn) if python else fn, bool(better))
    return name


def _vectorised(fn: Callable) -> Callable:
    def build(pred: Column, ref: Column, row: Column) -> Column:
        @F.pandas_udf("double")
        def f(p: pd.Series, r: pd.Series, e: pd.DataFrame) -> pd.Series:
            rows = e.to_dict("records")
            return pd.Series([float(fn(a, b, x)) for a, b, x in zip(p, r, rows, strict=True)])

        return f(pred, ref, row)

    return build


def views(scored: DataFrame) -> DataFrame:
    """A row for each example that has a reference and each view, with normal forms `p` and `r`. Both views
    come from one pass."""
    has = scored.filter(F.col("reference").isNotNull())
    columns = {f"_{side}_{view}": (source, tones) for view, tones in VIEWS.items() for side, source in (("p", "answer"), ("r", "reference"))}
    wide = normalized_columns(has, columns, "lang" if "lang" in scored.columns else None)
    both = F.explode(F.array(*(F.struct(F.lit(v).alias("view"), F.col(f"_p_{v}").alias("p"), F.col(f"_r_{v}").alias("r")) for v in VIEWS)))
    return wide.withColumn("_v", both).withColumns({c: F.col(f"_v.{c}") for c in ("view", "p", "r")}).drop("_v", *columns)


def with_statistics(viewed: DataFrame, names: list[str]) -> DataFrame:
    """Columns that several metrics share: chrF statistics and edits."""
    p, r = F.col("p"), F.col("r")
    extra = {}
    if "chrf" in names:
        extra["_chrf"] = m.chrf_statistics(p, r)
    if "chrf++" in names:
        extra["_chrf2"] = m.chrf_statistics(p, r, 2)
    if "wer" in names:
        extra |= {"_we": m.word_edits(p, r), "_wn": F.size(words(r))}
    if "cer" in names:
        extra |= {"_ce": m.edits(p, r), "_cn": F.length(r)}
    return viewed.withColumns(extra) if extra else viewed


#: Metrics that `measured` knows, and its columns.
MEASURED = frozenset({"exact_match", "chrf", "chrf++", "wer", "cer"})
MEASURES = {"_same": "boolean", "_we": "long", "_wn": "long", "_ce": "long", "_cn": "long", "_pn": "long", "_chrf": "array<long>", "_chrf2": "array<long>"}
#: Metrics by the columns that are worked out for them only.
ASKED = {"_we": {"wer"}, "_ce": {"cer"}, "_chrf": {"chrf"}, "_chrf2": {"chrf++"}}


def makers(names: list[str]) -> dict[str, Callable]:
    """Functions of a pair for the columns that `names` need."""
    gram_counts, chrf_tokens = m.gram_counts, m.chrf_tokens

    def sign_counts(a: str, b: str) -> list[int]:
        return gram_counts(*(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (a, b)), m.CHAR_ORDER)[2::3]

    def token_counts(a: list[str], b: list[str]) -> list[int]:
        number = {w: i for i, w in enumerate(dict.fromkeys([*a, *b]))}
        return gram_counts(*(np.array([number[w] for w in x], np.int64) for x in (a, b)), 2)[2::3]

    def signs(x: rows.Pair) -> list[int]:
        if not hasattr(x, "of_signs"):
            x.of_signs = x.signs(m.CHAR_ORDER, sign_counts)
        return x.of_signs

    make = {
        "_same": lambda x: x.same(),
        "_we": lambda x: x.word_edits(),
        "_wn": lambda x: x.n_words(x.r),
        "_ce": lambda x: x.edits(),
        "_cn": lambda x: x.size(x.r),
        "_pn": lambda x: x.size(x.p),
        "_chrf": signs,
        "_chrf2": lambda x: signs(x) + x.tokens(2, chrf_tokens, token_counts),
    }
    return {c: make[c] for c in MEASURES if c not in ASKED or ASKED[c] & {*names}}


def with_reference(scored: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """`keep`, language, answer and reference of the examples that have one, for a pass over Arrow."""
    rows.small_batches(scored.sparkSession)
    lang = F.col("lang").cast("string") if "lang" in scored.columns else F.lit(None).cast("string")
    return scored.filter(F.col("reference").isNotNull()).select(*keep, lang.alias("_lang"), "answer", "reference")


def measured(scored: DataFrame, names: list[str], keep: tuple[str, ...] = ("id", "pos")) -> DataFrame:
    """What `views` and `with_statistics` give for the metrics `names`, without the normal forms themselves:
    a row for each example that has a reference and each view, from one pass over Arrow."""
    has, make = with_reference(scored, keep), makers(names)
    target = StructType([*has.select(*keep).schema.fields, *StructType.fromDDL("view string, " + ", ".join(f"{c} {MEASURES[c]}" for c in make)).fields])
    arrow = to_arrow_schema(target)

    def run(batches):
        for batch in rows.sliced(batches):
            lang, answer, reference = (batch.column(len(keep) + k).to_pylist() for k in range(3))
            out = {c: [] for c in ("view", *make)}
            for a, r, x in zip(answer, reference, lang, strict=True):
                done = {}
                for view, pair in rows.pairs_of(a, r, x).items():
                    if id(pair) not in done:
                        done[id(pair)] = {c: f(pair) for c, f in make.items()}
                    out["view"].append(view)
                    for c, v in done[id(pair)].items():
                        out[c].append(v)
            twice = pa.array(np.repeat(np.arange(batch.num_rows), len(VIEWS)))
            kept = [batch.column(k).take(twice) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(out[f.name], f.type) for f in [*arrow][len(keep) :])], schema=arrow)

    return has.mapInArrow(run, target)


def totals(scored: DataFrame, names: list[str]) -> DataFrame:
    """(view, metric, n, sums, pool) from one pass over Arrow, a row for each task, view and metric: how many values,
    their exact sum in limbs, and the sums behind the pooled form."""
    has, make = with_reference(scored, ()), makers(names)
    target = StructType.fromDDL("view string, metric string, n long, sums array<long>, pool array<long>")
    arrow = to_arrow_schema(target)
    rate = lambda edits, n, empty: edits / n if n else 0.0 if empty else 1.0
    value_of = {
        "exact_match": lambda x: float(x["_same"]),
        "chrf": lambda x: m.chrf_value(x["_pn"], x["_cn"], x["_chrf"]),
        "chrf++": lambda x: m.chrf_value(x["_pn"], x["_cn"], x["_chrf2"]),
        "wer": lambda x: rate(x["_we"], x["_wn"], not x["_pn"]),
        "cer": lambda x: rate(x["_ce"], x["_cn"], not x["_pn"]),
    }
    pool_of = {
        "exact_match": lambda x: [],
        "chrf": lambda x: x["_chrf"],
        "chrf++": lambda x: x["_chrf2"],
        "wer": lambda x: [x["_we"], x["_wn"]] if x["_wn"] else [0, 0],
        "cer": lambda x: [x["_ce"], x["_cn"]] if x["_cn"] else [0, 0],
    }

    def run(batches):
        sums = {(v, n): 0 for v in VIEWS for n in names}
        pools: dict = {}
        count = 0
        for batch in rows.sliced(batches):
            lang, answer, reference = (batch.column(k).to_pylist() for k in range(3))
            own = {k: [] for k in sums}
            for a, r, x in zip(answer, reference, lang, strict=True):
                done = {}
                for view, pair in rows.pairs_of(a, r, x).items():
                    if id(pair) not in done:
                        found = {c: f(pair) for c, f in make.items()}
                        done[id(pair)] = {n: (fixed(value_of[n](found)), pool_of[n](found)) for n in names}
                    for n, (value, pool) in done[id(pair)].items():
                        sums[view, n] += value
                        own[view, n].append(pool)
            for k, pool in own.items():
                if pool:
                    pools[k] = pools.get(k, 0) + np.array(pool, np.int64).sum(axis=0)
            count += batch.num_rows
        if count:
            out = [(*k, count, limbs(x), pools[k].tolist()) for k, x in sums.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return has.mapInArrow(run, target)


def values(viewed: DataFrame, names: list[str], labels: dict[str, list[str]] | None = None) -> DataFrame:
    """`viewed`, or what was `measured`, with a column for each per-example metric. labels: view to label set."""
    if "_same" in viewed.columns:
        no_answer, no_reference = F.col("_pn") == 0, F.col("_cn") == 0
        known = {
            "exact_match": lambda: F.col("_same").cast("double"),
            "chrf": lambda: m.chrf_where(no_answer, no_reference, F.col("_chrf")),
            "chrf++": lambda: m.chrf_where(no_answer, no_reference, F.col("_chrf2")),
            "wer": lambda: m.rate_of(F.col("_we"), F.col("_wn"), no_answer),
            "cer": lambda: m.rate_of(F.col("_ce"), F.col("_cn"), no_answer),
        }
        return viewed.withColumns({n: known[n]() for n in names})
    p, r = F.col("p"), F.col("r")
    out = {}
    for name in names:
        if name == "exact_match":
            out[name] = m.exact_match(p, r)
        elif name == "chrf":
            out[name] = m.chrf(p, r, F.col("_chrf"))
        elif name == "chrf++":
            out[name] = m.chrf(p, r, F.col("_chrf2"))
        elif name == "wer":
            out[name] = m.rate(F.col("_we"), F.col("_wn"), p)
        elif name == "cer":
            out[name] = m.rate(F.col("_ce"), F.col("_cn"), p)
        elif name in ("accuracy", "accuracy_strict"):
            out[name] = label_of(p, labels or {}, name.endswith("strict")).eqNullSafe(r).cast("double")
        elif name in CUSTOM:
            out[name] = CUSTOM[name][0](p, r, F.struct(*(F.col(f"`{c}`") for c in viewed.columns if not c.startswith("_"))))
    return viewed.withColumns(out) if out else viewed


def label_of(p: Column, labels: dict[str, list[str]], strict: bool) -> Column:
    """The label an answer names, of its own view's labels."""
    out = F.lit(None).cast("string")
    for view, own in labels.items():
        out = F.when(F.col("view") == view, m.extract_label(p, own, strict)).otherwise(out)
    return out


def view_labels(viewed: DataFrame) -> dict[str, list[str]]:
    return {v: m.label_set(viewed.filter(F.col("view") == v), "r") for v in VIEWS}


def long_values(wide: DataFrame, names: list[str]) -> DataFrame:
    """(id, pos, view, metric, value)."""
    own = [n for n in names if n in wide.columns]
    stacked = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").alias("value")) for n in own)))
    return wide.select("id", "pos", "view", stacked.alias("_s")).select("id", "pos", "view", "_s.metric", "_s.value")


def pooled(wide: DataFrame, names: list[str], labels: dict[str, list[str]] | None = None) -> DataFrame:
    """(view, metric, corpus) of metrics that have a pooled form, from one pass of sums; macro-F1 by class."""
    aggregates = {}
    if "wer" in names:
        aggregates["wer"] = m.pooled_rate(F.col("_we"), F.col("_wn"))
    if "cer" in names:
        aggregates["cer"] = m.pooled_rate(F.col("_ce"), F.col("_cn"))
    if "chrf" in names:
        aggregates["chrf"] = m.pooled_statistics(F.col("_chrf"), m.CHAR_ORDER)
    if "chrf++" in names:
        aggregates["chrf++"] = m.pooled_statistics(F.col("_chrf2"), m.CHAR_ORDER + 2)
    parts = []
    if aggregates:
        sums = wide.groupBy("view").agg(*(c.alias(n) for n, c in aggregates.items()))
        final = {n: m.chrf_of(F.col(f"`{n}`")) if n.startswith("chrf") else F.col(n) for n in aggregates}
        stacked = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), c.alias("corpus")) for n, c in final.items())))
        parts.append(sums.select("view", stacked.alias("_s")).select("view", "_s.metric", "_s.corpus"))
    for name in ("macro_f1", "macro_f1_strict"):
        if name in names:
            labelled = wide.withColumn("_label", label_of(F.col("p"), labels or {}, name.endswith("strict")))
            f1 = m.macro_f1(labelled, ["view"], "_label", "r")
            parts.append(f1.select("view", F.lit(name).alias("metric"), F.col("macro_f1").alias("corpus")))
    if not parts:
        return wide.sparkSession.createDataFrame([], "view string, metric string, corpus double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def higher_is_better(name: str) -> bool:
    return CUSTOM[name][1] if name in CUSTOM else name not in m.LOWER_IS_BETTER


#: Bits of a limb of an exact sum and how many follow the whole part.
LIMB, LIMBS = 30, 4


def exact_sum(x: Column) -> Column:
    """Aggregate: the exact sum of numbers from 2^-60 to 2^30, and 0, as sums of limbs, from any order of rows."""
    parts, rest = [], x
    for _ in range(LIMBS):
        parts.append(F.floor(rest))
        rest = (rest - F.floor(rest)) * F.lit(float(1 << LIMB))
    return F.array(*(F.sum(p) for p in (*parts, F.floor(rest))))


def fixed(x: float) -> int:
    """A number in units of the last limb, as `exact_sum` takes it."""
    if not x:
        return 0
    top, bottom = x.as_integer_ratio()
    return (top << LIMB * LIMBS) // bottom


def limbs(x: int) -> list[int]:
    """Such a whole number as the limbs of `exact_sum`."""
    out = []
    for _ in range(LIMBS):
        x, own = divmod(x, 1 << LIMB)
        out.append(own)
    return [x, *reversed(out)]


def mean_of(limbs: Column, n: Column) -> Column:
    """The exact sum, rounded once, over n."""
    @F.pandas_udf("double")
    def f(sums: pd.Series, n: pd.Series) -> pd.Series:
        whole = lambda own: sum(int(x) << LIMB * (LIMBS - k) for k, x in enumerate(own))
        return pd.Series([whole(s) / (1 << LIMB * LIMBS) / k if k else None for s, k in zip(sums, n, strict=True)], dtype=float)

    return f(F.transform(limbs, lambda x: F.coalesce(x, F.lit(0).cast("long"))), n)


def summed(scored: DataFrame, names: list[str], order: DataFrame) -> DataFrame:
    """The summary of metrics that `measured` knows from one pass of sums, which leave Python added up."""
    orders = {"chrf": m.CHAR_ORDER, "chrf++": m.CHAR_ORDER + 2}
    size = 3 * max((orders[n] for n in names if n in orders), default=1)
    total = lambda c, k: F.array(*(F.sum(F.get(c, F.lit(i))) for i in range(k)))
    one = totals(scored, names).groupBy("view", "metric").agg(F.sum("n").alias("n"), total("sums", LIMBS + 1).alias("x"), total("pool", size).alias("c"))
    corpus = F.when(F.col("metric").isin("wer", "cer") & (F.get("c", F.lit(1)) > 0), F.get("c", F.lit(0)) / F.get("c", F.lit(1)))
    for name, k in orders.items():
        if name in names:
            corpus = F.when(F.col("metric") == name, m.chrf_of(F.slice("c", 1, 3 * k))).otherwise(corpus)
    means = one.select("view", "metric", "n", mean_of(F.col("x"), F.col("n")).alias("mean"), corpus.alias("corpus"))
    return means.join(F.broadcast(order), "metric").select("view", "metric", "n", "position", "higher_is_better", "mean", "corpus")


def score_run(examples: DataFrame, results: DataFrame, task: str = "generation", names: list[str] | None = None) -> dict[str, DataFrame]:
    """Frames of a scored run: `answers`, `values` (long), `summary` (view, metric, n, mean, corpus)."""
    names = list(names or m.TASK_DEFAULTS[task])
    check_metrics(task, names)
    answers = answered(examples, results)
    order = examples.sparkSession.createDataFrame([(k, n, higher_is_better(n)) for k, n in enumerate(names)], "position int, metric string, higher_is_better boolean")
    if {*names} <= MEASURED:
        wide = values(measured(answers, names), names)
        return {"answers": answers, "values": long_values(wide, names), "summary": summed(answers, names, order)}
    viewed = views(answers)
    labels = view_labels(viewed) if m.CLASSIFICATION_ONLY & {*names} else None
    wide = values(with_statistics(viewed, names), names, labels)
    long = long_values(wide, names) if any(n in m.PER_EXAMPLE or n in CUSTOM for n in names) else None
    n = wide.groupBy("view").agg(F.count(F.lit(1)).alias("n"))
    summary = n.crossJoin(F.broadcast(order))  # at most two views by the metrics asked for
    if long is not None:
        summary = summary.join(long.groupBy("view", "metric").agg(m.exact_mean(F.col("value")).alias("mean")), ["view", "metric"], "left")
    else:
        summary = summary.withColumn("mean", F.lit(None).cast("double"))
    summary = summary.join(pooled(wide, names, labels), ["view", "metric"], "left")
    return {"answers": answers, "values": long, "summary": summary}
