"""The engine by files: evaluate a backend, score or compare finished runs, check a dataset, write reports."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.flags import flag_counts
from .operators import alignment, runs, scoring
from .operators import validation as va
from .plans import report
from .plans.comparison import Comparison, check_same, compare, flagged
from .sources import jsonl

RESULTS, MANIFEST = "results", "run.json"


def with_meta(examples: DataFrame, fields: list[str]) -> DataFrame:
    """Examples with columns of their free-form fields."""
    return examples.withColumns({f: jsonl.meta_field(F.col("meta"), f) for f in fields if f not in ("lang", "length", "has_number")})


def evaluate(spark: SparkSession, dataset: str, task: str, out: str, factory: Callable[[], runs.Backend], model: str = "", limit: int = runs.BREAKER) -> dict:
    """Answers what has no answer yet, appends the records, and scores the run. Finished examples are not
    asked again; a run of another dataset is refused."""
    sha = jsonl.fingerprint(spark, dataset)
    manifest = {"dataset_sha256": sha, "task": task, "model": model, "started_at": datetime.now(UTC).isoformat(timespec="seconds")}
    path = Path(out) / MANIFEST
    if path.exists():
        check_same(sha, task, jsonl.read_manifest(spark, str(path)), out)
    else:
        path.parent.mkdir(parents=True, exist_ok=True)
        draft = path.with_suffix(".part")
        draft.write_text(json.dumps(manifest, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")
        draft.replace(path)
    examples = jsonl.load_dataset(spark, dataset, task)
    before = jsonl.read_results(spark, f"{out}/{RESULTS}")
    jsonl.write_results(runs.predict(runs.pending(examples, before), factory, limit), f"{out}/{RESULTS}")
    return score_finished_run(spark, dataset, task, out)


def score_finished_run(spark: SparkSession, dataset: str, task: str, out: str, names: list[str] | None = None) -> dict:
    """Aggregates of a run: counts, summary, latency, flags, and word errors of speech."""
    examples = jsonl.load_dataset(spark, dataset, task)
    scored = scoring.score_run(examples, jsonl.read_results(spark, f"{out}/{RESULTS}"), task, names)
    own = flagged(scored["answers"], task)
    asr = None
    if task == "asr":
        views = scoring.views(scored["answers"]).filter("view = 'tone_aware'")
        asr = alignment.totals(alignment.operations(alignment.aligned(views))).first().asDict()
    return {
        "task": task,
        "counts": scoring.run_counts(scored["answers"]).first().asDict(),
        "latency": scoring.latency(scored["answers"]).first().asDict(),
        "metrics": [r.asDict() for r in scored["summary"].orderBy("view", "position").drop("position").collect()],
        "flags": {r.name: r.n for r in flag_counts(own).collect()} if own is not None else {},
        "asr": asr,
    }


def write_reports(found: dict, folder: str, formats: tuple[str, ...] = report.FORMATS, manifest: dict | None = None) -> list[str]:
    md = report.run_markdown(found["metrics"], found["counts"], found["latency"], found["flags"], found["task"], manifest, found["asr"])
    return report.write(folder, "report", md, found, formats)


def compare_runs(spark: SparkSession, dataset: str, task: str, base: str, candidate: str, names: list[str] | None = None, fields: list[str] | None = None, **settings) -> Comparison:
    """Compares two run folders that were made from this dataset."""
    sha = jsonl.fingerprint(spark, dataset)
    for folder in (base, candidate):
        check_same(sha, task, jsonl.read_manifest(spark, f"{folder}/{MANIFEST}"), folder)
    examples = jsonl.load_dataset(spark, dataset, task)
    if fields:
        examples = with_meta(examples, fields)
    results = [jsonl.read_results(spark, f"{f}/{RESULTS}") for f in (base, candidate)]
    return compare(examples, *results, task=task, names=names, fields=fields, **settings)


def write_comparison(found: Comparison, folder: str, formats: tuple[str, ...] = report.FORMATS) -> list[str]:
    return report.write(folder, "comparison", report.comparison_markdown(found), found.to_json(), formats, report.bars(found))


def validate_dataset(spark: SparkSession, path: str, task: str, against: str | None = None) -> list[dict]:
    """Issues of a dataset: severity, code, count, and the line or the first ids."""
    good, bad = jsonl.parse_dataset(spark, path, task)
    good = good.cache()
    issues = [{"severity": "error", "code": "line-error", "line": r.line, "message": r.message, "count": 1} for r in bad.orderBy("line").limit(va.MOST_LINES).collect()]
    more = bad.count() - len(issues)
    if more > 0:
        issues.append({"severity": "error", "code": "line-error", "message": f"and {more} more line errors", "count": more})
    if good.isEmpty():
        issues.append({"severity": "error", "code": "no-examples", "message": "No valid examples.", "count": 0})

    def add(severity: str, code: str, rows: DataFrame) -> None:
        for r in va.first_ids(rows.select("id", "pos", F.lit(1).alias("_all")), "_all").collect():
            issues.append({"severity": severity, "code": code, "count": r.n, "ids": r.ids, "message": f"{r.n} example(s): {', '.join(r.ids)}"})

    strict = "error" if task in ("classification", "asr") else "warning"
    found = va.problem_rows(good, task)
    for problem, severity in (("replacement", "warning"), ("controls", "warning"), ("non_nfc", "warning"), ("padded", "info"), ("empty_inputs", "warning"), ("empty_refs", strict)):
        add(severity, problem, found.filter(F.col("problem") == problem))
    k = va.keyed(good)
    if task != "asr":
        add("warning", "duplicate-content", va.duplicates(k))
        add("warning", "conflicting-references", va.conflicts(k))
    for r in va.diacritics_missing(va.diacritics(good)).collect():
        issues.append({"severity": "warning", "code": "diacritics-missing", "count": r.texts, "message": f"None of {r.texts} '{r.lang}' texts has any ({r.field})."})
    if task == "classification":
        b = va.label_balance(va.labels(k)).first()
        if b.issue:
            issues.append({"severity": "warning", "code": "single-class" if b.issue == "single-class" else "class-imbalance", "count": b.total, "message": f"{b.issue}: most are {b.top_label!r} ({b.top_n} of {b.total}), least {b.low_label!r} ({b.low_n})."})
    if against is not None:
        if task == "asr":
            issues.append({"severity": "info", "code": "leakage-skipped", "message": "Not for speech.", "count": 0})
        else:
            other, wrong = jsonl.parse_dataset(spark, against, task)
            if n := wrong.count():
                issues.append({"severity": "warning", "code": "against-parse-errors", "message": f"{n} line(s) were skipped.", "count": n})
            add("error", "train-test-leakage", va.leakage(k, va.keyed(other)))
    good.unpersist()
    return issues


