"""Pairing, slices, validation, alignment, audio, run logs and sources."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalstrata.errors import AudioError, BackendError, ConfigError, DatasetError, RunAborted, RunError
from evalstrata.functions.text import normalized_columns
from evalstrata.operators import alignment, audio, paired, runs, scoring
from evalstrata.operators import validation as va
from evalstrata.sources import benchmarks, jsonl


def pairs(spark, rows):
    return spark.createDataFrame([(i, b, c, "g") for i, (b, c) in enumerate(rows)], "pos long, base double, candidate double, k string")


def test_bootstrap_of_equal_runs_has_no_width(spark):
    r = paired.bootstrap(pairs(spark, [(1.0, 1.0), (0.0, 0.0)]), ["k"], draws=50).first()
    assert (r.delta, r.low, r.high, r.n) == (0, 0, 0, 2)


def test_scalable_bootstrap_is_near_the_exact_one(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), float(b)) for a, b in rng.integers(0, 2, (400, 2))]
    exact = paired.bootstrap(pairs(spark, rows), ["k"]).first()
    loose = paired.poisson_bootstrap(pairs(spark, rows), ["k"]).first()
    assert loose.n == 400 and loose.delta == pytest.approx(exact.delta)
    assert (loose.low, loose.high) == pytest.approx((exact.low, exact.high), abs=0.02)


def test_mcnemar():
    assert paired.mcnemar_p(0, 10) == 2 / 1024 and paired.mcnemar_p(0, 0) == 1.0 and paired.mcnemar_p(5, 5) == 1.0


def test_outcomes(spark):
    r = paired.outcomes(pairs(spark, [(0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 1.0)]), ["k"]).first()
    assert (r.wins, r.ties, r.losses, r.base_only, r.candidate_only) == (2, 1, 1, 1, 2)
    assert paired.outcomes(pairs(spark, [(0.5, 1.0)]), ["k"]).first().base_only is None


@pytest.mark.parametrize("low,high,higher,want", [(0.0, 0.5, True, "no clear change"), (0.1, 0.5, True, "improved"), (-0.5, -0.1, True, "regressed"), (0.1, 0.5, False, "regressed"), (-1.0, -0.1, False, "improved")])
def test_verdict(spark, low, high, higher, want):
    assert spark.range(1).select(paired.verdict(F.lit(low), F.lit(high), higher)).first()[0] == want


def test_slices_need_thirty(spark):
    for n, status in ((29, "insufficient data"), (30, "improved")):
        ex = spark.createDataFrame([(i, i, "ref", "en", "d") for i in range(n)], "id long, pos long, reference string, lang string, domain string")
        p = spark.createDataFrame([(i, i, 0.0, 1.0) for i in range(n)], "id long, pos long, base double, candidate double")
        r = paired.slices(paired.sliced(p, ex, ["domain"])).first()
        assert (r.n, r.status) == (n, status)


def test_slice_values(spark):
    df = spark.createDataFrame([("one two", None), ("a b c d e f 7", "x"), (None, None)], "reference string, domain string").withColumn("lang", F.lit(None).cast("string"))
    got = df.select(*(paired.slice_value(f) for f in ("lang", "length", "has_number", "domain"))).collect()
    assert [tuple(r) for r in got] == [("(none)", "short (<=5 words)", "no", "(missing)"), ("(none)", "medium (6-15 words)", "yes", "x"), ("(none)", "short (<=5 words)", "no", "(missing)")]


def examples(spark, rows, lang=None):
    own = [(f"e{i}", i, [("user", a)], b, lang) for i, (a, b) in enumerate(rows)]
    return spark.createDataFrame(own, "id string, pos long, messages array<struct<role:string,content:string>>, reference string, lang string")


def test_duplicates_and_conflicts(spark):
    k = va.keyed(examples(spark, [("Ina kwana?", "Lafiya"), ("ina kwana", "lafiya!"), ("q", "yes"), ("Q!", "no"), ("q", None)]))
    assert [r.id for r in va.duplicates(k).collect()] == ["e1"]
    assert sorted(r.id for r in va.conflicts(k).collect()) == ["e2", "e3"]


def test_leakage(spark):
    a, b = examples(spark, [("INA KWANA", "x"), ("same", "x"), ("new", "x")]), examples(spark, [("Ina kwana?", "y"), ("same", "y")])
    got = va.leakage(va.keyed(a), va.keyed(b))
    assert {(r.id, r.identical) for r in got.collect()} == {("e0", False), ("e1", True)}


def test_text_health(spark):
    rows = [("a�", "x"), ("b\x07", "x"), ("é", "x"), (" pad", "x"), ("?!", "x"), ("ok", "...")]
    got = {(r.id, r.problem) for r in va.problem_rows(examples(spark, rows)).collect()}
    assert got == {("e0", "replacement"), ("e1", "controls"), ("e2", "non_nfc"), ("e3", "padded"), ("e4", "empty_inputs"), ("e5", "empty_refs")}
    first = va.first_ids(va.problem_rows(examples(spark, [(" p", "x")] * 7)), "problem").first()
    assert (first.n, first.ids) == (7, ["e0", "e1", "e2", "e3", "e4"])


def test_diacritics(spark):
    plain = va.diacritics(examples(spark, [("ka bo", None)] * 25, "yo"))
    assert {r.field for r in va.diacritics_missing(plain).collect()} == {"tone_rate", "underdot_rate"}
    assert va.diacritics_missing(va.diacritics(examples(spark, [("ka", None)] * 5, "yo"))).isEmpty()
    r = va.diacritics(examples(spark, [("Ẹ ṣé", None), ("é", None), ("ka", None), ("ɓ", None)], "ha")).first()
    assert (r.tone_rate, r.underdot_rate, r.hooked_rate) == (0.5, 0.25, 0.25)


@pytest.mark.parametrize("counts,want", [({"a": 90, "b": 10}, ("majority", "a", "b")), ({"a": 48, "b": 47, "c": 5}, ("minority", "a", "c")), ({"a": 3}, ("single-class", "a", "a")), ({"a": 5, "b": 5}, (None, "a", "b"))])
def test_label_balance(spark, counts, want):
    rows = [("q", k) for k, n in counts.items() for _ in range(n)]
    r = va.label_balance(va.labels(va.keyed(examples(spark, rows)))).first()
    assert (r.issue, r.top_label, r.low_label) == want


def test_statistics(spark):
    got = {r.field: r for r in va.statistics(examples(spark, [("a b", "c"), ("a", None), ("a b c", "d e")])).collect()}
    assert (got["input_words"].min, got["input_words"].median, got["input_words"].max) == (1, 2.0, 3)
    assert (got["reference_words"].n_texts, got["reference_words"].median) == (2, 1.5)


def test_alignment(spark):
    df = spark.createDataFrame([("u1", 1, "ina kwana", "kwana"), ("u2", 2, "ina kwana", "ina kwana sosai"), ("u3", 3, "Ẹ ṣé", "E ṣe"), ("u4", 4, "", "x")], "id string, pos long, r string, p string")
    ops = alignment.operations(alignment.aligned(df))
    t = alignment.totals(ops).first()
    assert (t.substitutions, t.deletions, t.insertions, t.tone_only_substitutions, t.hits) == (2, 1, 1, 1, 3)
    top = alignment.top_errors(ops, "delete").first()
    assert (top.ref, top.hyp, top.n, top.examples) == ("ina", None, 1, ["u1"])


def test_alignment_is_shortest():
    import random

    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(7))] for _ in range(2))
        ops = alignment.align(a, b)
        assert [r for _, r, _ in ops if r is not None] == a and [h for *_, h in ops if h is not None] == b
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
        assert sum(o != "equal" for o, *_ in ops) == row[-1]


def test_wer_by_length(spark):
    from evalstrata.functions import metrics as m

    df = spark.createDataFrame([("a b c d e", "a b c d e"), ("x", "y")], "p string, r string")
    r = alignment.wer_by_length(df, m.word_edits(F.col("p"), F.col("r")), F.size(F.split("r", " "))).first()
    assert (r.bucket, r.n, r.wer) == ("1-5", 2, pytest.approx(1 / 6))


def test_windows(spark):
    got = spark.createDataFrame([(60 * 16000,), (10,), (28 * 16000,), (28 * 16000 + 1,)], "n long").select(audio.windows(F.col("n"))).collect()
    seconds = [[(w.start / 16000, w.end / 16000) for w in r[0]] for r in got]
    assert seconds[0] == [(0, 28), (26, 54), (52, 60)]
    assert [len(s) for s in seconds] == [3, 1, 1, 2]
    for n in range(1, 4000, 37):
        grid = audio.plain_windows(n, 10, 28, 2)
        assert grid[0][0] == 0 and grid[-1][1] == n and all(a[1] - b[0] == 20 for a, b in zip(grid, grid[1:]))
    with pytest.raises(ConfigError):
        audio.windows(F.lit(1), window_s=31)
    with pytest.raises(ConfigError):
        audio.windows(F.lit(1), overlap_s=28)


def test_levels_and_quiet_windows(spark):
    x = (np.sin(np.arange(60 * 16000) / 5) * 20000).astype("<i2")
    x[int(27.5 * 16000) : int(27.6 * 16000)] = 0
    own = audio.quiet_windows(x.tobytes())
    assert 27.5 <= own[0][1] / 16000 <= 27.6 and len(own) == 3 and own[1][0] == own[0][1] - 2 * 16000
    assert all(b - a <= 30 * 16000 for a, b in own)
    assert audio.levels(b"\0" * 640).tolist() == [-120.0] and len(audio.levels(b"\0" * 639)) == 0
    df = spark.createDataFrame([("c", bytearray(x.tobytes()))], "path string, pcm binary")
    rows = audio.window_rows(df, silence_aware=True).orderBy("window").collect()
    assert [len(r.pcm) // 2 for r in rows] == [b - a for a, b in own]
    assert df.select(audio.seconds(F.col("pcm"))).first()[0] == 60.0


@pytest.mark.parametrize("parts,want", [(["ina kwana lafiya", "kwana lafiya yau"], "ina kwana lafiya yau"), (["a b", "b c"], "a b b c"), (["", "x"], "x"), (["Ó dàbọ̀ o", "o dabọ, o ní"], "Ó dàbọ̀ o ní")])
def test_merging(parts, want):
    assert audio.merge(parts) == want


def test_transcripts(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(audio.to_wav(b"\1\0" * 100))
    (tmp_path / "b.wav").write_bytes(b"junk")
    rows = {r.path.rpartition("/")[2]: r for r in audio.read_audio(spark, str(tmp_path)).collect()}
    assert bytes(rows["a.wav"].pcm) == b"\1\0" * 100 and rows["b.wav"].error
    df = spark.createDataFrame([("c", 1, "kwana lafiya yau", 5.0), ("c", 0, "ina kwana lafiya", 7.0)], "path string, window int, text string, latency_ms double")
    r = audio.merged_transcripts(df).first()
    assert (r.text, r.latency_ms) == ("ina kwana lafiya yau", 12.0)
    with pytest.raises(AudioError):
        audio.decode(b"")


def write(tmp_path, name, lines, raw=None):
    p = tmp_path / name
    p.write_bytes(raw if raw is not None else "\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in lines).encode())
    return str(p)


def test_dataset_lines(spark, tmp_path):
    rows = ["﻿" + json.dumps({"id": 1, "input": "a", "reference": "r", "lang": "Hausa", "meta": {"k": True, "n": 1.5}}), "", "not json", "[1]", {"input": "b", "odd": 1}, {"id": "1", "input": "c"}, {"input": " "}, {"messages": [{"role": "user", "content": "x y"}]}, {"input": "a", "messages": []}, {"id": True, "input": "a"}, {"input": "a", "lang": "fr"}, "   "]
    good, bad = jsonl.parse_dataset(spark, write(tmp_path, "d.jsonl", rows), "generation")
    g = {r.line: r for r in good.collect()}
    assert set(g) == {1, 8} and g[1].id == "1" and g[1].lang == "ha" and len(g[8].id) == 12
    b = {r.line: r.message for r in bad.collect()}
    assert set(b) == {3, 4, 5, 6, 7, 9, 10, 11} and "unknown field(s): odd" in b[5] and "line 1" in b[6]
    assert good.filter("line = 1").select(jsonl.meta_field(F.col("meta"), "k"), jsonl.meta_field(F.col("meta"), "n"), jsonl.meta_field(F.col("meta"), "z")).first()[:] == ("True", "1.5", None)
    with pytest.raises(DatasetError, match="line 3"):
        jsonl.load_dataset(spark, str(tmp_path / "d.jsonl"), "generation")
    with pytest.raises(ConfigError):
        jsonl.parse_dataset(spark, str(tmp_path / "d.jsonl"), "poetry")
    with pytest.raises(DatasetError, match="byte 2"):
        jsonl.lines(spark, write(tmp_path, "bad.jsonl", [], raw=b"{}\xff\n"))
    assert jsonl.load_dataset(spark, write(tmp_path, "crlf.jsonl", [], raw=b'{"input": "a"}\r\n{"input": "b"}\r\n'), "generation").count() == 2


def test_large_files_keep_line_numbers(spark, tmp_path):
    """Files of any number of splits are read alike: numbers, byte order mark, errors."""
    rows = [json.dumps({"input": f"q{i} \ufeff"}) if i % 3 else "" for i in range(1000)]
    path = write(tmp_path, "l.jsonl", ["\ufeff" + json.dumps({"input": "q"}), *rows])
    broken = write(tmp_path, "b.jsonl", [], raw=b"\n".join([b"{}"] * 800 + [b"{}\xff"] + [b"{}"] * 300))
    found = []
    for size in ("134217728", "900"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            found.append({(r.line, r.value) for r in jsonl.lines(spark, path).collect()})
            with pytest.raises(DatasetError, match="line 801, byte 2"):
                jsonl.lines(spark, broken)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1] == {(1, json.dumps({"input": "q"})), *((i + 2, r) for i, r in enumerate(rows) if r)}
    with pytest.raises(DatasetError):
        jsonl.lines(spark, str(tmp_path / "nothing.jsonl"))


def test_resumed_log(spark, tmp_path):
    """What a later session appended stands, though its files are shorter."""
    log, answer = str(tmp_path / "log"), lambda *rows: spark.createDataFrame([(i, p, 1.0, e, None) for i, p, e in rows], runs.ANSWER).coalesce(1)
    jsonl.write_results(answer(("a", "x", None), ("b", "y", None), ("c", None, "timeout")), log)
    jsonl.write_results(answer(("c", "good", None)), log)
    got = {r.id: (r.prediction, r.error) for r in jsonl.read_results(spark, log).collect()}
    assert got == {"a": ("x", None), "b": ("y", None), "c": ("good", None)}
    second = next((tmp_path / "log" / "run-000002").glob("part-*"))
    for crc in second.parent.glob(".*.crc"):
        crc.unlink()
    second.write_text('{"id": "c", "prediction": "good"}\n{"id": "a", "pred')
    assert {r.id: r.prediction for r in jsonl.read_results(spark, log).collect()} == {"a": "x", "b": "y", "c": "good"}


def test_speech_and_classification_rules(spark, tmp_path):
    path = write(tmp_path, "s.jsonl", [{"audio": "a.wav", "reference": "x"}, {"input": "a", "audio": "a.wav", "reference": "x"}, {"audio": "a.wav"}])
    good, bad = jsonl.parse_dataset(spark, path, "asr")
    assert good.count() == 1 and bad.count() == 2


def test_run_log(spark, tmp_path):
    ok, failed = {"id": "a", "prediction": "x", "latency_ms": 5}, {"id": "a", "error": "boom"}
    got = jsonl.read_results(spark, write(tmp_path, "r.jsonl", [failed, {"id": "b", "prediction": None}, ok, '{"id": "c", "pred'])).collect()
    assert {r.id: r.prediction for r in got} == {"a": "x", "b": None}
    with pytest.raises(RunError, match="line 1"):
        jsonl.read_results(spark, write(tmp_path, "q.jsonl", ["{garbage", ok]))
    assert jsonl.read_results(spark, str(tmp_path / "none.jsonl")).count() == 0
    with pytest.raises(RunError):
        jsonl.read_manifest(spark, str(tmp_path / "run.json"))
    write(tmp_path, "run.json", [{"task": "asr"}])
    assert jsonl.read_manifest(spark, str(tmp_path / "run.json")) == {"task": "asr"}
    jsonl.write_results(spark.createDataFrame([("z", "p", 1.0, None, None)], runs.ANSWER), str(tmp_path / "out"))
    assert jsonl.read_results(spark, str(tmp_path / "out")).first().id == "z"
    assert len(jsonl.fingerprint(spark, str(tmp_path / "run.json"))) == 64


class Echo:
    def generate(self, messages):
        text = messages[-1]["content"]
        if text.startswith("bad"):
            raise BackendError("refused")
        if text.startswith("odd"):
            raise KeyError("secret")
        return {"text": text.upper(), "latency_ms": 1.0}

    def close(self):
        pass


def test_predictions_and_resume(spark):
    ex = examples(spark, [("a", "A"), ("bad", "x"), ("odd", "x"), ("b", "B")])
    got = {r.id: r for r in runs.predict(ex.coalesce(1), Echo).collect()}
    assert got["e0"].prediction == "A" and got["e1"].error == "refused" and got["e2"].error == "unexpected error: KeyError"
    done = spark.createDataFrame([(r.id, r.prediction, r.latency_ms, r.error) for r in got.values()], "id string, prediction string, latency_ms double, error string")
    assert sorted(r.id for r in runs.pending(ex, done).collect()) == ["e1", "e2"]
    assert runs.pending(ex, done, retry_failed=False).isEmpty()
    s = runs.run_summary(ex, done.limit(0), done).first()
    assert (s.total, s.skipped, s.ok, s.failed) == (4, 0, 2, 2)
    assert runs.predict(examples(spark, [("bad", "x")] * 30).coalesce(1), Echo, limit=5).count() == 5
    scored = scoring.score_run(ex, done, "generation", ["exact_match"])
    assert {r.mean for r in scored["summary"].collect()} == {0.5}


def test_breaker(spark):
    log = spark.createDataFrame([(i, "x" if 3 <= i < 8 else None) for i in range(20)], "line long, error string")
    runs.check_breaker(log, 6)
    runs.check_breaker(log, 0)
    with pytest.raises(RunAborted):
        runs.check_breaker(log, 5)


def test_retries():
    calls, slept = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            e = BackendError("busy")
            e.status = 503
            raise e
        return {"text": "x"}

    assert runs.with_retries(call, sleep=slept.append) == {"text": "x"} and len(slept) == 2
    assert runs.wait(10) == 8.0 and runs.wait(0, 99) == 30.0 and math.isclose(runs.wait(0), 0.5)
    with pytest.raises(ConfigError):
        runs.make_backend("none such")


def test_custom_metrics(spark):
    name = scoring.register_metric(lambda p, r, e: float(len(p)), "size_py", python=True)
    other = scoring.register_metric(lambda p, r, e: F.length(p).cast("double"), "size_col", higher_is_better=False)
    ex = examples(spark, [("a", "xyz")])
    res = spark.createDataFrame([("e0", "Ab!", 1.0, None)], "id string, prediction string, latency_ms double, error string")
    got = {(r.metric, r.mean) for r in scoring.score_run(ex, res, "generation", [name, other])["summary"].collect()}
    assert got == {("size_py", 2.0), ("size_col", 2.0)} and not scoring.higher_is_better("size_col")
    for bad in (["accuracy"], ["nope"], ["wer", "wer"]):
        with pytest.raises(ConfigError):
            scoring.check_metrics("generation", bad)
    with pytest.raises(ConfigError):
        scoring.register_metric(lambda p, r, e: p, "wer")


def test_benchmark_results(spark, tmp_path):
    own = {"results": {"afrixnli_yo": {"acc,none": 0.31, "alias": "x", "flag": True, "n": 5}, "odd": {"zeta": 2, "beta": 1}, "none": {"alias": "y"}}}
    path = write(tmp_path, "results_1.json", [own])
    got = benchmarks.read_results(spark, path)
    assert {(r.task, r.metric, r.value) for r in got.collect()} == {("afrixnli_yo", "acc,none", 0.31), ("afrixnli_yo", "n", 5.0), ("odd", "zeta", 2.0), ("odd", "beta", 1.0)}
    assert {r.task: r.metric for r in benchmarks.headlines(got).collect()} == {"afrixnli_yo": "acc,none", "odd": "beta"}
    tasks = got.select("task")
    assert [r.task for r in benchmarks.in_families(tasks).collect()] == ["afrixnli_yo"]
    assert benchmarks.missing_families(tasks)[0] == "belebele" and "afrixnli" not in benchmarks.missing_families(tasks)
    assert benchmarks.latest_results(spark, str(tmp_path)).endswith("results_1.json")
    assert benchmarks.shown("acc,none", 0.5) == "50.00" and benchmarks.shown("chrf", 38.2) == "38.20"
    with pytest.raises(ConfigError):
        benchmarks.read_results(spark, write(tmp_path, "x.json", [{"a": 1}]))


def test_keys_use_the_language(spark):
    df = spark.createDataFrame([("'yar", "ha"), ("'yar", "yo")], "t string, lang string")
    assert {r.lang: r.n for r in normalized_columns(df, {"n": ("t", "keep")}, "lang").collect()} == {"ha": "'yar", "yo": "yar"}


def test_top_substitutions_of_all_rows(spark, monkeypatch):
    from evalstrata.plans import inputs, queries

    rows = [(k, k, "one two three", "en", "d") for k in range(8)]
    monkeypatch.setattr(inputs, "examples", lambda *_: spark.createDataFrame(rows, "id long, pos long, reference string, lang string, domain string"))
    monkeypatch.setattr(inputs, "results", lambda *_: spark.createDataFrame([(k, "one x three", 1.0, None) for k in range(8)], "id long, prediction string, latency_ms double, error string"))
    assert [(r.ref, r.hyp, r.n) for r in queries.top_substitutions(spark, "").collect()] == [("two", "x", 8)]
