"""The made-up dataset of 92 items: figures that an independent computation has given."""

import pytest

from evalstrata.plans.comparison import compare
from evalstrata.sources.demo import demo


@pytest.fixture(scope="module")
def report(spark):
    examples, base, tuned = demo(spark)
    return compare(examples, base, tuned, fields=["lang", "length", "has_number", "domain"])


def by_key(report):
    return {m["key"]: m for m in report.metrics}


def test_counts(report):
    assert report.n_total == 92 and report.primary == "exact_match@tone_aware"
    assert (report.base["n_failed"], report.candidate["n_failed"]) == (2, 0)
    assert (report.base["n_flagged"], report.candidate["n_flagged"]) == (6, 14)


def test_exact_match(report):
    m = by_key(report)["exact_match@tone_aware"]
    assert m["n"] == 92
    assert m["base_mean"] == pytest.approx(0.6195652173913043, abs=1e-12)
    assert m["candidate_mean"] == pytest.approx(0.7934782608695652, abs=1e-12)
    assert (m["low"], m["high"]) == pytest.approx((0.03260869565217391, 0.31521739130434784), abs=1e-12)
    assert (m["wins"], m["ties"], m["losses"], m["verdict"]) == (31, 46, 15, "improved")
    assert m["mcnemar"]["p_value"] == pytest.approx(0.02589608179323477, abs=1e-12)


def test_chrf(report):
    m = by_key(report)
    assert m["chrf@tone_aware"]["base_mean"] == pytest.approx(67.18290887324983, abs=1e-9)
    assert m["chrf@tone_aware"]["candidate_mean"] == pytest.approx(84.46495335396553, abs=1e-9)
    assert (m["chrf@tone_aware"]["low"], m["chrf@tone_aware"]["high"]) == pytest.approx((5.434673311635793, 29.451704451208936), abs=1e-9)
    assert m["chrf@tone_insensitive"]["base_mean"] == pytest.approx(77.40682504276317, abs=1e-9)
    assert m["chrf@tone_insensitive"]["candidate_mean"] == pytest.approx(85.8996822726848, abs=1e-9)
    for view, pair in (("tone_aware", (54.0336, 90.7469)), ("tone_insensitive", (70.4955, 92.4520))):
        assert (m[f"chrf@{view}"]["base_corpus"], m[f"chrf@{view}"]["candidate_corpus"]) == pytest.approx(pair, abs=1e-3)


def test_hidden_regression(report):
    s = {(x["field"], x["value"]): x for x in report.slices}
    assert s["domain", "numeracy"]["status"] == "regressed"
    assert s["domain", "agri"]["status"] == "improved"
    assert s["domain", "greetings"]["status"] == "insufficient data"
    assert s["domain", "greetings"]["n"] == 12
