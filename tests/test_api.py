"""Files in, reports out; streams; the entry module."""

import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evalstrata import api, cli
from evalstrata.errors import ConfigError
from evalstrata.plans import report, training
from evalstrata.sources.benchmarks import settings
from evalstrata.streaming import runlog

ROOT = Path(__file__).parent.parent


class Upper:
    def __init__(self, cut=0):
        self.cut = cut

    def generate(self, messages):
        return {"text": messages[-1]["content"][self.cut :], "latency_ms": 2.0}

    def close(self):
        pass


@pytest.fixture(scope="module")
def runs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("runs")
    rows = [{"id": i, "input": f"question {i} <b>", "reference": f"question {i} <b>", "lang": "en", "meta": {"domain": "even" if i % 2 == 0 else "odd"}} for i in range(64)]
    (folder / "d.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    for name, cut in (("base", 0), ("tuned", 3)):
        api.evaluate(spark, str(folder / "d.jsonl"), "generation", str(folder / name), lambda cut=cut: Upper(cut), name)
    return folder


def test_evaluate_and_resume(spark, runs):
    found = api.score_finished_run(spark, str(runs / "d.jsonl"), "generation", str(runs / "base"))
    assert found["counts"]["n_ok"] == 64 and {m["mean"] for m in found["metrics"] if m["metric"] == "exact_match"} == {1.0}
    before = len(list((runs / "base" / "results").rglob("part-*.json")))
    again = api.evaluate(spark, str(runs / "d.jsonl"), "generation", str(runs / "base"), Upper)
    assert again["counts"] == found["counts"] and before >= 1
    (runs / "other.jsonl").write_text('{"input": "x", "reference": "y"}\n')
    with pytest.raises(ConfigError):
        api.evaluate(spark, str(runs / "other.jsonl"), "generation", str(runs / "base"), Upper)


def test_compare_and_reports(spark, runs, tmp_path):
    c = api.compare_runs(spark, str(runs / "d.jsonl"), "generation", str(runs / "base"), str(runs / "tuned"), fields=["domain"])
    assert c.metrics[0]["verdict"] == "regressed" and c.primary == "exact_match@tone_aware"
    assert {s["value"]: s["n"] for s in c.slices} == {"even": 32, "odd": 32}
    made = api.write_comparison(c, str(tmp_path))
    page = (tmp_path / "comparison.html").read_text()
    assert len(made) == 3 and "<svg" in page and "<script" not in page
    assert json.loads((tmp_path / "comparison.json").read_text())["n_total"] == 64
    assert "regressed" in (tmp_path / "comparison.md").read_text()
    api.write_reports(api.score_finished_run(spark, str(runs / "d.jsonl"), "generation", str(runs / "tuned")), str(tmp_path), ("md", "html"))
    assert "exact_match" in (tmp_path / "report.md").read_text()
    with pytest.raises(ConfigError):
        report.write(str(tmp_path), "x", "", {}, ("pdf",))
    text, problems = report.card("mine", "d", "base", [], "", json.loads(c.to_json()), suffix="Powered")
    assert "mine - Powered" in text and len(problems) == 4


def test_html_is_escaped():
    page = report.to_html("# <b>\n| a | b |\n|---|---|\n| <i> | x \\| y |\n", "<t>")
    assert "<b>" not in page and "<i>" not in page and "x | y" in page


def test_validate_and_command_line(spark, runs, capsys, tmp_path):
    assert api.validate_dataset(spark, str(runs / "d.jsonl"), "generation") == []
    bad = tmp_path / "b.jsonl"
    bad.write_text('{"input": "question 1 <B>", "reference": "x"}\n{"input": "question 1", "reference": "y"}\nnope\n')
    codes = {i["code"] for i in api.validate_dataset(spark, str(bad), "generation", str(runs / "d.jsonl"))}
    assert codes == {"line-error", "train-test-leakage"}
    assert cli.main(["validate", str(bad)]) == 1 and cli.main(["validate", str(runs / "d.jsonl")]) == 0
    assert cli.main(["report", str(runs / "d.jsonl"), str(runs / "gone"), "--out", str(tmp_path)]) in (0, 1, 2)
    assert cli.main(["compare", str(runs / "d.jsonl"), str(runs / "base"), str(runs / "tuned"), "--primary", "nope", "--out", str(tmp_path)]) == 2
    assert cli.main(["card", "n", "b", "--out", str(tmp_path / "c.md")]) == 0
    capsys.readouterr()


def test_training_data(spark, runs, tmp_path):
    from evalstrata.sources import jsonl

    good, bad = jsonl.parse_dataset(spark, str(runs / "d.jsonl"), "generation")
    c = training.prepare(good, bad, 50)
    assert c.first().conversation[-1].role == "assistant"
    p = training.plan(c, 16, 3).first()
    assert (p.n_examples, p.steps_per_epoch, p.total_steps, p.median_words) == (64, 4, 12, 6.0) and training.steps(65, 16, 3) == (5, 15)
    with pytest.raises(ConfigError):
        training.prepare(good, bad, 65)
    with pytest.raises(ConfigError):
        training.prepare(good, bad, 1, good)
    texts = training.rendered(c, lambda turns: "|".join(t["content"] for t in turns))
    assert "|" in texts.first().text
    with pytest.raises(ConfigError):
        training.check_truncation(texts, F.length("text"), 5)
    (tmp_path / "t.json").write_text(json.dumps({"base_model": "b", "train_file": "d", "output_dir": "o"}))
    assert training.read_config(str(tmp_path / "t.json")).effective_batch == 16
    (tmp_path / "t.json").write_text(json.dumps({"base_model": "b"}))
    with pytest.raises(ConfigError):
        training.read_config(str(tmp_path / "t.json"))


def test_settings(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "evalstrata.toml").write_text('[evalstrata]\nmodel = "m"\n')
    assert settings(str(tmp_path / "a")) == {"model": "m"}
    (tmp_path / "a" / "evalstrata.toml").write_text("[evalstrata]\nodd = 1\n")
    with pytest.raises(ConfigError):
        settings(str(tmp_path / "a"))


def test_streams(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "1.json").write_text('{"id": "a", "error": "x"}\n{broken\n')
    q = runlog.latest_by_id(runlog.read_log(spark, str(log))).writeStream.format("memory").queryName("latest").outputMode("complete").start()
    q.processAllAvailable()
    (log / "2.json").write_text('{"id": "a", "prediction": "early"}\n{"id": "a", "prediction": "p"}\n{"id": "b", "prediction": "q"}\n')
    q.processAllAvailable()
    q.stop()
    assert {r.id: r.prediction for r in spark.table("latest").collect()} == {"a": "p", "b": "q"}
    out = runlog.append_to(runlog.read_log(spark, str(log)), str(tmp_path / "out"), str(tmp_path / "ck"))
    out.processAllAvailable()
    out.stop()
    assert spark.read.json(str(tmp_path / "out")).count() == 4
    e = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").parquet("/root/testdata/sf0.001/events.parquet*")
    w = runlog.failure_counts(e, "ts").writeStream.format("memory").queryName("fails").outputMode("append").start()
    w.processAllAvailable()
    w.stop()
    assert spark.table("fails").count() > 0


def test_breaker_state(spark, tmp_path):
    log = tmp_path / "b"
    log.mkdir()
    rows = lambda a, b: "".join(json.dumps({"run": "r", "line": i, "error": "x"}) + "\n" for i in range(a, b))
    (log / "1.json").write_text(rows(0, 3))
    s = runlog.breaker_states(spark.readStream.schema("run string, line long, error string").json(str(log)), 5)
    q = s.writeStream.format("memory").queryName("breaker").outputMode("update").start()
    q.processAllAvailable()
    (log / "2.json").write_text(rows(3, 6))
    q.processAllAvailable()
    q.stop()
    assert [(r.streak, r.tripped) for r in spark.table("breaker").orderBy("streak").collect()] == [(3, False), (6, True)]


def rows_of(frame):
    key = lambda v: str(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple("None" if v is None or v != v else key(v) for v in r) for r in frame)


def test_queries_equal_their_sql(spark):
    import duckdb

    from evalstrata.plans import oracles, queries

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    assert set(oracles.SQL) <= set(queries.QUERIES)
    for name, sql in oracles.SQL.items():
        want = db.execute(sql)
        columns = [c[0] for c in want.description]
        got = queries.QUERIES[name](spark, sf)
        assert sorted(got.columns) == sorted(columns), name
        assert rows_of(got.select(*(f"`{c}`" for c in columns)).collect()) == rows_of(want.fetchall()), name


def test_works_without_the_training_data_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env=os.environ | {"PYTHONPATH": str(tmp_path / "r")}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
