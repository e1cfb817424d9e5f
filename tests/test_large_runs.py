"""Whole comparisons of large runs: each answer is looked at once, and what grows with a row's length stays small."""

import random
import time
import tracemalloc
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from evalstrata.functions import flags as fl
from evalstrata.functions import metrics as m
from evalstrata.functions import rows
from evalstrata.functions.text import normalized_columns
from evalstrata.operators import alignment, paired, scoring

SMALL = "/root/testdata/sf0.001"
ODD = [
    ("a", "Ẹ ṣé púpọ̀, it's 'so'.", "Ẹ ṣe pupọ it's so!", "yo"), ("b", "", "", "en"), ("c", "x", "", None), ("d", "", "x y", "en"),
    ("e", "'yar gida ' ta", "'Yar gida ta", "ha"), ("f", "one two three", "one 2 three four", "en"), ("g", "a b c a b c a b d", "a b c a b d", "en"),
]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def odd(spark):
    return spark.createDataFrame([(i, k, a, r, lang, "ok") for k, (i, r, a, lang) in enumerate(ODD)], "id string, pos long, answer string, reference string, lang string, status string")


def pairs(spark):
    rng = random.Random(4)
    rows = [(k, "abc"[k % 3], rng.choice((0.0, 1.0)), rng.choice((0.0, 1.0))) for k in range(200)]
    return spark.createDataFrame(rows, "pos long, k string, base double, candidate double")


def test_compare_runs_makes_the_pairs_once(spark):
    """F1."""
    df = __spark_entry__.queries()["compare_runs"](spark, SMALL)
    assert plan(df).count("Relation [") == 4  # examples and a log for each run
    p = pairs(spark)
    found = {r.k: r for r in paired.tested(p, ["k"]).collect()}
    for r in paired.outcomes(p, ["k"]).collect():
        own = found[r.k]
        assert all(own[c] == pytest.approx(r[c], abs=1e-12) for c in r.asDict() if c != "k")


def test_measures_are_those_of_the_normal_forms(spark):
    """without making the forms columns."""
    names = ["exact_match", "wer", "cer", "chrf", "chrf++"]
    want = scoring.values(scoring.with_statistics(scoring.views(odd(spark)), names), names).select("id", "view", *(f"`{n}`" for n in names))
    got = scoring.values(scoring.measured(odd(spark), names), names).select("id", "view", *(f"`{n}`" for n in names))
    assert sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize("name", ["wer_pooled", "compare_outcomes", "paired_bootstrap_ci"])
def test_no_interpreted_functions_of_words(spark, name):
    """F12, F7, F10."""
    shown = plan(__spark_entry__.queries()[name](spark, SMALL))
    assert "levenshtein" not in shown and "lambdafunction" not in shown


def test_summary_reads_the_runs_once(spark):
    """F2."""
    shown = plan(__spark_entry__.queries()["score_summary"](spark, SMALL))
    assert shown.count("Relation [") == 2
    x = [1 / 3, 2 / 7, 0.0, 1.0, 100.0, 5 / 19999, 1e-9] * 30
    df = spark.createDataFrame([(v,) for v in x], "x double").repartition(5)
    one = df.agg(scoring.exact_sum(F.col("x")).alias("s"), F.count("x").alias("n")).select(scoring.mean_of(F.col("s"), F.col("n"))).first()[0]
    assert one == df.agg(m.exact_mean(F.col("x"))).first()[0]


def test_substitutions_in_one_pass(spark):
    """F3."""
    assert plan(__spark_entry__.queries()["top_substitutions"](spark, SMALL)).count("Relation [") == 2
    whole = alignment.operations(alignment.aligned(scoring.views(odd(spark)).filter("view = 'tone_aware'"))).filter("op != 'equal'")
    assert sorted(map(repr, alignment.operations(alignment.errors(odd(spark))).collect())) == sorted(map(repr, whole.collect()))


def test_alignment_of_long_texts_is_small():
    """a table of 2,500 x 2,500 numbers would be 50 MB."""
    rng = random.Random(1)
    a, b = ([str(rng.randrange(2000)) for _ in range(2500)] for _ in range(2))
    tracemalloc.start()
    ops = alignment.align(a, b)
    assert tracemalloc.get_traced_memory()[1] < 10_000_000
    tracemalloc.stop()
    assert [r for _, r, _ in ops if r is not None] == a and [h for *_, h in ops if h is not None] == b


def test_mcnemar_of_many_pairs():
    """F5."""
    began = time.time()
    assert 0 < paired.mcnemar_p(199_000, 201_000) < 0.01 and paired.mcnemar_p(10**6, 10**6) == 1.0 and time.time() - began < 5
    for n, k in ((1001, 480), (1500, 3), (3000, 1400)):
        exact = 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n
        assert paired.mcnemar_p(k, n - k) == pytest.approx(exact, rel=1e-11)


def test_slices_are_judged_in_one_pass(spark):
    """F6."""
    assert plan(__spark_entry__.queries()["slice_verdicts"](spark, SMALL)).count("Relation [") == 5


def test_scalable_bootstrap_makes_the_pairs_once(spark):
    """F8."""
    p = pairs(spark)
    out = paired.poisson_bootstrap(p, ["k"])
    assert plan(out).count("LogicalRDD") == 1
    want = {r.k: r.delta for r in paired.outcomes(p, ["k"]).collect()}
    assert {r.k: r.delta for r in out.collect()} == pytest.approx(want)


def test_draws_of_whole_numbers_are_the_same(spark):
    """fewer bytes, equal means."""
    d = np.random.default_rng(0).integers(-1, 2, 500).astype(float)
    means = d[np.random.default_rng(3).integers(0, 500, size=(100, 500))].mean(axis=1)
    assert paired.draw(d, 100, 3, 0.95) == (d.mean(), *np.quantile(means, [(1 - 0.95) / 2, (1 + 0.95) / 2]))


@pytest.mark.parametrize("name,reads", [("flag_counts", 2), ("flag_comparison", 4)])
def test_flags_without_interpreted_functions(spark, name, reads):
    """F9, F11."""
    shown = plan(__spark_entry__.queries()[name](spark, SMALL))
    assert "lambdafunction" not in shown and shown.count("Relation [") == reads
    rng = random.Random(7)
    text = lambda: "".join(rng.choice(["NECO ", "Abuja. ", "Kano ", "1,000 ", "2.5", "the ", "A", "é", ". ", "it's ", "…", "x y z w "]) for _ in range(30))
    df = spark.createDataFrame([(k, text(), text()) for k in range(150)], "k long, p string, r string")
    a = F.col("a")
    want = normalized_columns(df, {"a": ("p", "strip")}).select(
        "k", fl.repeats(a).alias("repeated_output"), fl.truncated(F.col("r"), F.col("p"), a).alias("truncated_output"),
        (F.size(fl.missing_terms(fl.required(F.col("r")), a)) > 0).alias("missing_required_terms"),
        (fl.numbers(F.col("r")) != fl.numbers(F.col("p"))).alias("number_mismatch"),
    )
    got = {r.k: [*r.flags] for r in fl.flag_answers(df, "p", "r").collect()}
    assert {r.k: [c for c in want.columns[1:] if r[c]] for r in want.collect()} == {k: [f for f in v if f != "script_mismatch"] for k, v in got.items()}


def final_plan(spark, name):
    df = __spark_entry__.queries()[name](spark, SMALL)
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]


def test_summary_deals_the_texts_once(spark):
    """one exchange of texts, and only sums leave Python."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shown = final_plan(spark, "score_summary")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shown.count("Scan parquet") == 1 and "ReusedExchange" in shown and "_chrf" not in shown


def test_sums_are_those_of_the_rows(spark):
    """exact means, pooled forms and empty runs."""
    names = ["exact_match", "chrf", "chrf++", "wer", "cer"]
    one = scoring.values(scoring.measured(odd(spark), names), names)
    want = scoring.long_values(one, names).groupBy("view", "metric").agg(m.exact_mean(F.col("value")).alias("mean"))
    order = spark.createDataFrame([(k, n, True) for k, n in enumerate(names)], "position int, metric string, higher_is_better boolean")
    got = {(r.view, r.metric): r for r in scoring.summed(odd(spark), names, order).collect()}
    assert {k: (r.mean, r.n) for k, r in got.items()} == {(r.view, r.metric): (r["mean"], len(ODD)) for r in want.collect()}
    corpus = {(r.view, r.metric): r.corpus for r in scoring.pooled(one, names).collect()}
    assert {k: r.corpus for k, r in got.items() if k[1] != "exact_match"} == pytest.approx(corpus, abs=1e-12)
    assert not scoring.summed(odd(spark).limit(0), names, order).collect()


def test_ends_are_counted_as_their_forms():
    """without making them; letters, marks and apostrophes side by side."""
    rng = random.Random(2)
    bits = ["the", "É", "ẹ̀", "'", "’", "`", "-", "\n", "\xa0", "\x1c", "İ", "Σ", "ª", "²", "ß", "ǖ", "중", " ", " "]
    for _ in range(3000):
        text = "".join(rng.choice(bits[: rng.choice((8, len(bits)))]) for _ in range(rng.randrange(12)))
        for orphans in (True, False):
            found = rows.counted(text, orphans)
            for tones in ("keep", "strip"):
                of = rows.form(text, tones, orphans)
                assert found in (None, (len(of.split()), len(of.replace(" ", "")))), text
    assert rows.counted("It's Émile’s 'own', so.", False) == (4, 16)


def test_outcomes_deal_the_texts_once_and_join_once_for_all_metrics(spark):
    """rows are stacked after the join of both runs."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shown = final_plan(spark, "compare_outcomes")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shown.count("Scan parquet") == 1 and shown.count("Generate explode") == 1


def test_wide_pairs_are_those_of_long_values(spark):
    """with missing values, ids that only one run has, and repeated ids."""
    kinds = "id string, pos long, view string, wer double, `chrf++` double"
    base = spark.createDataFrame([("a", 0, "v", 0.5, None), ("b", 1, "v", 1.0, 2.0), ("b", 2, "w", 0.0, 3.0), ("c", 3, "v", 1.0, 1.0), ("d", 4, "v", 1.0, 1.0), ("d", 4, "v", 2.0, 1.0)], kinds)
    candidate = spark.createDataFrame([("a", 0, "v", 0.25, 9.0), ("b", 1, "v", None, 4.0), ("b", 2, "w", 0.5, 5.0), ("x", 9, "v", 1.0, 1.0), ("d", 4, "v", 3.0, 1.0), ("d", 4, "v", 4.0, 1.0)], kinds)
    names = ["wer", "chrf++"]
    want = paired.pairs(*(scoring.long_values(df, names) for df in (base, candidate)))
    got = paired.wide_pairs(base, candidate, names)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())


def test_flags_deal_the_texts_once(spark):
    """both runs and both sides of their joins read one exchange."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shown = final_plan(spark, "flag_comparison")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shown.count("Scan parquet") == 1 and shown.count("ArrowEvalPython") == 2  # the rules once for each run


def test_flags_look_at_what_differs():
    """of texts with long common ends; a mark that joins with a name's last letter still counts."""
    text = "Wani garin Kano da Abuja, 12 ne. " * 40
    both = text + "Birnin Zaria da 7 ne."
    assert not {"missing_required_terms", "number_mismatch"} & {*fl.raised(both, both, None, None, False)}
    found = fl.raised(text + "Birnin x da 8 ne.", both, None, None, False)
    assert "missing_required_terms" in found and "number_mismatch" in found
    assert "number_mismatch" not in fl.raised(text + "Birnin Zaria da 12 7 ne.", both, None, None, False)
    assert "missing_required_terms" in fl.raised("a Abḍ b", "a Abḍ b", None, None, False)
    assert fl.names_in("Ina Kano. Abuja ta Zaria", 10) == {"Zaria"}


def test_repeats_of_long_texts():
    """the same as counting every phrase."""
    rng = random.Random(3)
    for _ in range(400):
        ws = [str(rng.randrange(rng.choice((2, 30, 300)))) for _ in range(rng.randrange(30, 200))]
        n = len(ws)
        many = lambda items: max(items.count(x) for x in {*items})
        assert fl.repeated(ws) == (many(ws) * 2 >= n or many([*zip(ws, ws[1:], ws[2:], ws[3:], strict=False)]) >= 3)
    assert fl.repeated(["a"] * 50 + [str(k) for k in range(50)]) and not fl.repeated([str(k) for k in range(100)])
