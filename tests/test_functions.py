"""Normalisation, metrics and flags by hand-computed values."""

import itertools
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from evalstrata.errors import ConfigError
from evalstrata.functions import flags as fl
from evalstrata.functions import formatting, metrics as m
from evalstrata.functions.text import BARE, MARKED, NormalizeConfig, language, normalize_text, normalized_columns

SAMPLES = ["Don’t stop", "Ẹ káàárọ̀, ó dàbọ̀!", "'yar 'uwa", "a,b  c d", "İstanbul K Å", "ṣé ọ'dun ''x'' o'", "50% off — now", " x\x1cy", "ÑANDÚ ß", "ẹ́ ́"]


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def table(spark, pairs):
    return spark.createDataFrame(pairs, "p string, r string")


@pytest.mark.parametrize("text,want", [("a,b", "a b"), ("well-known!", "well known"), ("  a \t b\n", "a b"), ("50% off", "50 off"), ("Don’t stop", "don't stop")])
def test_normal_forms(text, want):
    assert normalize_text(text) == want


def test_native_path_equals_the_plain_one(spark):
    rng = random.Random(1)
    signs = "aáàạẹ́ọ̀ŋɓ'’ʼ.,!-_ 1٣ \ṭ́ÀẸ漢ßİ"
    texts = [*SAMPLES, *("".join(rng.choice(signs) for _ in range(rng.randrange(25))) for _ in range(400))]
    rows = [(i, t, lang) for i, (t, lang) in enumerate(itertools.product(texts, ["ha", "yo", None]))]
    df = spark.createDataFrame(rows, "id long, t string, lang string")
    out = normalized_columns(df, {"keep": ("t", "keep"), "strip": ("t", "strip")}, "lang").collect()
    assert len(out) == len(rows)
    for r in out:
        for tones in ("keep", "strip"):
            want = normalize_text(r.t, NormalizeConfig(r.lang, tones))
            assert r[tones] == want, (r.t, r.lang, tones)
            assert normalize_text(want, NormalizeConfig(r.lang, tones)) == want


def test_null_stays_null(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert normalized_columns(df, {"n": ("t", "keep")}).first().n is None


def test_tone_table():
    assert len(MARKED) == len(BARE) > 300
    assert all(unicodedata.normalize("NFC", c) == c for c in BARE)
    assert normalize_text("wà ṣe", NormalizeConfig(tones="strip")) == "wa ṣe"


def test_languages(spark):
    got = spark.createDataFrame([(" Hausa ",), ("YO",), ("eng",), ("fr",)], "x string").select(language(F.col("x"))).collect()
    assert [r[0] for r in got] == ["ha", "yo", "en", None]
    with pytest.raises(ConfigError):
        NormalizeConfig(lang="fr")


def test_error_rates(spark):
    df = table(spark, [("a b d", "a b c"), ("", ""), ("", "x"), ("a b c", ""), ("b a", "a b c d")])
    got = [r[0] for r in df.select(m.wer(F.col("p"), F.col("r"))).collect()]
    assert got == [pytest.approx(1 / 3), 0.0, 1.0, 1.0, 0.75]
    assert table(spark, [("abd", "abc")]).select(m.cer(F.col("p"), F.col("r"))).first()[0] == pytest.approx(1 / 3)
    pooled = lambda rows: table(spark, rows).agg(m.pooled_rate(m.word_edits(F.col("p"), F.col("r")), F.size(F.filter(F.split("r", " "), lambda w: w != "")))).first()[0]
    assert pooled([("a b", "a b"), ("c", "d e")]) == 0.5
    assert pooled([("x", "y"), ("a b c d e f g h i j", "a b c d e f g h i j")]) == pytest.approx(1 / 11)
    assert pooled([("x", "")]) is None


def test_word_distance_against_the_table(spark):
    rng = random.Random(3)
    words = ["ọdun", "odun", "a", "b", "ẹ", "漢"]
    pairs = [tuple(" ".join(rng.choice(words) for _ in range(rng.randrange(8))) for _ in range(2)) for _ in range(300)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    for r in table(spark, pairs).select("p", "r", m.word_edits(F.col("p"), F.col("r")).alias("d")).collect():
        assert r.d == distance(r.p.split(), r.r.split())


def test_chrf(spark):
    df = table(spark, [("", ""), ("", "x"), ("x", ""), ("abc def", "abc def"), ("abc", "xyz")])
    for order in (0, 2):
        s = df.withColumn("s", m.chrf_statistics(F.col("p"), F.col("r"), order))
        assert [r[0] for r in s.select(m.chrf(F.col("p"), F.col("r"), F.col("s"))).collect()] == [100.0, 0.0, 0.0, pytest.approx(100.0), 0.0]


@pytest.mark.parametrize("text,labels,strict,want", [
    ("very positive indeed", ["positive", "negative", "very positive"], False, "very positive"),
    ("negative not positive", ["positive", "negative"], False, "negative"),
    ("not positive", ["positive"], True, None),
    (" positive ", ["positive"], True, "positive"),
    ("positively", ["positive", ""], False, None),
])
def test_labels(spark, text, labels, strict, want):
    assert one(spark, text, lambda c: m.extract_label(c, labels, strict)) == want


@pytest.mark.parametrize("rows,want", [([("a", "a"), ("b", "a"), ("b", "b"), ("b", "b")], (2 / 3 + 4 / 5) / 2), ([(None, "a"), ("b", "b")], 0.5), ([("c", "a")], 0.0)])
def test_macro_f1(spark, rows, want):
    df = spark.createDataFrame(rows, "label string, ref string").withColumn("v", F.lit("x"))
    assert m.macro_f1(df, ["v"], "label", "ref").first().macro_f1 == pytest.approx(want)


def test_mean_is_exactly_rounded(spark):
    for order in itertools.permutations([1.0, 1e16, 1e-16]):
        df = spark.createDataFrame([(x,) for x in order], "x double")
        import math

        assert df.agg(m.exact_mean(F.col("x"))).first()[0] == math.fsum(order) / 3


def flags(spark, prediction, reference, **more):
    df = spark.createDataFrame([(prediction, reference, more.get("format"), more.get("require"))], "prediction string, reference string, format string, require array<string>")
    return fl.flag_answers(df, wanted="format", terms="require").first().flags


@pytest.mark.parametrize("prediction,reference,more,want", [
    ("  ", "x", {}, ["empty_output"]),
    ("yes " * 8, "yes", {}, ["repeated_output"]),
    ("a b c d e a b c d f a b c d g", "x", {}, ["repeated_output"]),
    ("1,000", "1000", {}, []),
    ("1.0", "1", {}, ["number_mismatch"]),
    ("Это ответ на вопрос", "x", {}, ["script_mismatch"]),
    ("abuja.", "The capital of Nigeria is Abuja.", {}, ["missing_required_terms"]),
    ("it is in nigeria abuja", "The capital of Nigeria is Abuja.", {}, ["truncated_output"]),
    ("neco", "NECO was founded", {}, []),
    ("none", "NECO was founded", {}, ["missing_required_terms"]),
    ("{\"a\": 1}", "[1]", {}, []),
    ("not json", "{\"a\": 1}", {}, ["format_noncompliant", "number_mismatch"]),
    ("12.", "12", {"format": "number"}, []),
    ("twelve 12", "12", {"format": "number"}, ["format_noncompliant"]),
    ("x", "x", {"format": "poem"}, []),
    ("the Ṣé term", "x", {"require": ["ṣe", "gone"]}, ["missing_required_terms"]),
    (None, "x", {}, []),
    ("x", None, {}, []),
])
def test_flags(spark, prediction, reference, more, want):
    assert flags(spark, prediction, reference, **more) == want


def test_formatting():
    assert formatting.value("wer", 0.5) == "50.0%" and formatting.value("chrf", 38.25) == "38.2" and formatting.value("wer", None) == "-"
    assert formatting.difference("wer", -0.125) == "-12.5 pts" and formatting.mask("short") == "****"
    assert formatting.mask("sk-1234567890") == "sk-…7890"
    assert "abcdef" not in formatting.redact("token hf_abcdefgh")
