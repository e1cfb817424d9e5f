"""The whole comparison of two runs: scores, paired statistics, slices of the primary metric, flags."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions import flags as fl
from ..functions import metrics as m
from ..operators import paired, scoring


@dataclass
class Comparison:
    """The result: aggregates only, so small whatever the runs' size."""

    task: str
    primary: str | None
    n_total: int
    base: dict
    candidate: dict
    metrics: list[dict] = field(default_factory=list)
    slices: list[dict] = field(default_factory=list)
    flags: list[dict] = field(default_factory=list)
    settings: dict = field(default_factory=dict)

    def regressions(self) -> list[dict]:
        return [r for r in (*self.metrics, *self.slices) if r.get("verdict", r.get("status")) == "regressed"]

    def new_flags(self) -> list[dict]:
        return [f for f in self.flags if f["delta"] > 0]

    def to_json(self) -> str:
        return json.dumps(self.__dict__, indent=2, ensure_ascii=False) + "\n"


def flagged(answers: DataFrame, task: str) -> DataFrame | None:
    """Answers that may have flags: received, with a reference, and prose."""
    if task == "classification":
        return None
    ok = answers.filter("status = 'ok' and reference is not null")
    return fl.flag_answers(ok, "answer", "reference")


def check_same(dataset_sha256: str, task: str, manifest: dict, name: str) -> None:
    if manifest.get("dataset_sha256") != dataset_sha256 or manifest.get("task") != task:
        raise ConfigError(f"{name} was not produced from this dataset and task.", "Run it again on the same file.")


def compare(
    examples: DataFrame,
    base: DataFrame,
    candidate: DataFrame,
    task: str = "generation",
    names: list[str] | None = None,
    fields: list[str] | None = None,
    primary: str | None = None,
    draws: int = 1000,
    seed: int = 0,
    least: int = paired.MIN_SLICE,
) -> Comparison:
    """Scores both runs on the examples and compares them."""
    names = list(names or m.TASK_DEFAULTS[task])
    fields = list(fields if fields is not None else paired.BUILTIN_FIELDS)
    scored = {k: scoring.score_run(examples, r, task, names) for k, r in (("base", base), ("candidate", candidate))}
    info, flag_counts = {}, {}
    for k, s in scored.items():
        counts = scoring.run_counts(s["answers"]).first()
        own = flagged(s["answers"], task)
        info[k] = {"n_failed": counts.n_failed, "n_missing": counts.n_missing, "n_flagged": own.filter(F.size("flags") > 0).count() if own is not None else 0}
        flag_counts[k] = fl.flag_counts(own) if own is not None else None
    summaries = {k: {(r.metric, r.view): r for r in s["summary"].collect()} for k, s in scored.items()}  # a row for each metric and view
    order = [(n, v) for v in scoring.VIEWS for n in names]
    tested, stats = [], {}
    if scored["base"]["values"] is not None:
        p = paired.pairs(scored["base"]["values"], scored["candidate"]["values"]).cache()
        by = ["metric", "view"]
        better = {n: scoring.higher_is_better(n) for n in names}
        sign = F.when(F.create_map(*(F.lit(x) for kv in better.items() for x in kv))[F.col("metric")], 1.0).otherwise(-1.0)
        out = paired.outcomes(p, by, sign).join(paired.bootstrap(p, by, draws, seed).select(*by, "low", "high", F.col("delta").alias("mean_delta")), by)
        exact = p.groupBy(*by).agg(m.exact_mean(F.col("base")).alias("bm"), m.exact_mean(F.col("candidate")).alias("cm"))
        stats = {(r.metric, r.view): r for r in out.join(exact, by).collect()}
        tested = [k for k in order if k in stats]
    metrics = []
    for name, view in order:
        b, c, s = summaries["base"].get((name, view)), summaries["candidate"].get((name, view)), stats.get((name, view))
        if b is None or c is None:
            continue
        higher = scoring.higher_is_better(name)
        row = {"key": f"{name}@{view}", "name": name, "view": view, "higher_is_better": higher, "n": s.n if s else 0}
        row |= {"base_mean": s.bm, "candidate_mean": s.cm, "delta": s.mean_delta, "low": s.low, "high": s.high} if s else dict.fromkeys(("base_mean", "candidate_mean", "delta", "low", "high"))
        row["verdict"] = verdict(s.low, s.high, higher) if s else "pooled only"
        row |= {"wins": s.wins, "ties": s.ties, "losses": s.losses} if s else {"wins": 0, "ties": 0, "losses": 0}
        row |= {"base_corpus": b.corpus, "candidate_corpus": c.corpus, "mcnemar": None}
        if s and s.base_only is not None:
            row["mcnemar"] = {"base_only": s.base_only, "candidate_only": s.candidate_only, "p_value": paired.mcnemar_p(s.base_only, s.candidate_only)}
        metrics.append(row)
    keys = [f"{n}@{v}" for n, v in tested]
    if primary is not None and primary not in keys:
        raise ConfigError(f"Primary metric {primary!r} has no per-example values.", f"Choose one of: {', '.join(keys) or '(none)'}.")
    chosen = primary or next((k for k in keys if k.endswith("@tone_aware")), keys[0] if keys else None)
    slices = []
    if chosen is not None:
        name, view = chosen.split("@")
        higher = scoring.higher_is_better(name)
        rows = paired.slices(paired.sliced(p.filter((F.col("metric") == name) & (F.col("view") == view)), examples, fields), higher, least, draws, seed)
        own = {f: [] for f in fields}
        for r in sorted(rows.collect(), key=lambda r: (r.delta is None, (1 if higher else -1) * (r.delta or 0.0), r.first_pos)):
            own[r.field].append({"field": r.field, "value": r.bucket, "n": r.n, "base_mean": r.base_mean, "candidate_mean": r.candidate_mean, "delta": r.delta, "low": r.low, "high": r.high, "status": r.status})
        slices = [r for f in fields for r in own[f]]
        p.unpersist()
    flags = []
    if flag_counts["base"] is not None:
        found = {r.name: r for r in paired.flag_changes(flag_counts["base"], flag_counts["candidate"]).collect()}  # a row a flag
        flags = [{"name": f, "base": found[f].base, "candidate": found[f].candidate, "delta": found[f].delta} for f in fl.FLAGS if f in found]
    settings = {"n_boot": draws, "seed": seed, "confidence": 0.95, "min_slice_n": least, "slice_fields": fields}
    return Comparison(task, chosen, examples.count(), info["base"], info["candidate"], metrics, slices, flags, settings)


def verdict(low: float, high: float, higher: bool) -> str:
    if low > 0:
        return "improved" if higher else "regressed"
    if high < 0:
        return "regressed" if higher else "improved"
    return "no clear change"
