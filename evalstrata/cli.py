"""Command line: score, compare, validate, windows, bench, demo, card. Exit codes: 0 fine, 1 failed, 2 misused."""

from __future__ import annotations

import argparse
import json
import sys

from . import api
from .errors import FAILED, OK, StrataError
from .functions.formatting import redact
from .session import session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="evalstrata")
    p.add_argument("--master", help="Spark master, if not that of the environment")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("report", "compare", "validate"):
        c = sub.add_parser(name)
        c.add_argument("dataset")
        c.add_argument("--task", default="generation")
        if name == "report":
            c.add_argument("run")
        if name == "compare":
            c.add_argument("base")
            c.add_argument("candidate")
            c.add_argument("--slice", action="append", default=[])
            c.add_argument("--primary")
            c.add_argument("--seed", type=int, default=0)
            c.add_argument("--n-boot", type=int, default=1000)
        if name == "validate":
            c.add_argument("--against")
        else:
            c.add_argument("--metric", action="append")
            c.add_argument("--out", default=".")
            c.add_argument("--format", action="append")
    c = sub.add_parser("bench", help="read a harness result file")
    c.add_argument("results")
    c = sub.add_parser("demo", help="compare the two made-up runs")
    c.add_argument("--out", default="demo")
    c = sub.add_parser("card", help="write a model card")
    for name in ("name", "base_model"):
        c.add_argument(name)
    c.add_argument("--description", default="")
    c.add_argument("--training-data", default="")
    c.add_argument("--lang", action="append", default=[])
    c.add_argument("--comparison")
    c.add_argument("--out", default="README.md")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return run(a)
    except StrataError as e:
        print(redact(str(e)), file=sys.stderr)
        return e.exit_code


def run(a: argparse.Namespace) -> int:
    from .plans import report

    if a.command == "card":
        found = json.loads(open(a.comparison, encoding="utf-8").read()) if a.comparison else None
        text, problems = report.card(a.name, a.description, a.base_model, a.lang, a.training_data, found)
        with open(a.out, "w", encoding="utf-8") as f:
            f.write(text)
        print("\n".join(problems))
        return OK
    spark = session(a.master)
    if a.command == "validate":
        issues = api.validate_dataset(spark, a.dataset, a.task, a.against)
        for i in issues:
            print(f"{i['severity']}: {i['code']}: {i['message']}")
        return FAILED if any(i["severity"] == "error" for i in issues) else OK
    if a.command == "bench":
        from .sources import benchmarks as b

        for r in b.headlines(b.read_results(spark, a.results)).orderBy("task").collect():
            print(f"{r.task}\t{r.metric}\t{b.shown(r.metric, r.value)}")
        return OK
    formats = tuple(getattr(a, "format", None) or report.FORMATS)
    if a.command == "report":
        made = api.write_reports(api.score_finished_run(spark, a.dataset, a.task, a.run, a.metric), a.out, formats)
    elif a.command == "compare":
        fields = ["lang", "length", "has_number", *a.slice]
        found = api.compare_runs(spark, a.dataset, a.task, a.base, a.candidate, a.metric, fields, primary=a.primary, seed=a.seed, draws=a.n_boot)
        made = api.write_comparison(found, a.out, formats)
    else:
        from .plans.comparison import compare
        from .sources.demo import demo

        made = api.write_comparison(compare(*demo(spark), fields=["lang", "length", "has_number", "domain"]), a.out)
    print("\n".join(made))
    return OK


if __name__ == "__main__":
    sys.exit(main())
