"""The driver's queries over its tables: one for each operator, and whole plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import flags as fl
from ..functions import metrics as m
from ..functions.text import normalized_columns, words
from ..operators import alignment as al
from ..operators import audio, paired, runs, scoring
from ..operators import validation as va
from . import inputs, training

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SLICED = ["lang", "length", "has_number", "domain"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def answers(spark: SparkSession, sf_dir: str, run: str) -> DataFrame:
    ex = inputs.examples(spark, sf_dir)
    return scoring.answered(ex, inputs.results(ex, run))


def text_answers(spark: SparkSession, sf_dir: str, run: str) -> DataFrame:
    """The same without other columns of the examples, for what looks at the texts."""
    ex = inputs.dealt(inputs.examples(spark, sf_dir))
    return scoring.answered(ex, inputs.results(ex, run))


def both_views(spark: SparkSession, sf_dir: str, run: str = "base") -> DataFrame:
    return scoring.views(answers(spark, sf_dir, run))


def both_runs(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    base, candidate = (scoring.values(scoring.measured(text_answers(spark, sf_dir, run), names), names) for run in ("base", "candidate"))
    return paired.wide_pairs(base, candidate, names)


@query
def normalize_tone_aware(spark, sf_dir):
    d = inputs.table(spark, sf_dir, "documents")
    return normalized_columns(d, {"norm": ("text", "keep")}, "lang").select("doc_id", "norm")


@query
def normalize_tone_insensitive(spark, sf_dir):
    d = inputs.table(spark, sf_dir, "documents")
    return normalized_columns(d, {"norm": ("text", "strip")}, "lang").select("doc_id", "norm")


@query
def exact_match_by_lang(spark, sf_dir):
    v = both_views(spark, sf_dir)
    return v.groupBy("lang", "view").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(m.exact_match(F.col("p"), F.col("r"))), 6).alias("exact_match"))


@query
def score_counts(spark, sf_dir):
    return scoring.run_counts(answers(spark, sf_dir, "base"))


@query
def latency_stats(spark, sf_dir):
    out = scoring.latency(answers(spark, sf_dir, "base"))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query
def cer_pooled(spark, sf_dir):
    p, r = F.col("p"), F.col("r")
    v = both_views(spark, sf_dir)
    return v.groupBy("view").agg(F.round(m.pooled_rate(m.edits(p, r), F.length(r)), 6).alias("cer"), F.round(F.avg(m.cer(p, r)), 6).alias("mean_cer"))


@query
def wer_pooled(spark, sf_dir):
    v = scoring.values(scoring.measured(answers(spark, sf_dir, "base"), ["wer"]), ["wer"])
    return v.groupBy("view").agg(F.round(m.pooled_rate(F.col("_we"), F.col("_wn")), 6).alias("wer"), F.round(F.avg("wer"), 6).alias("mean_wer"))


@query
def wer_by_length_bucket(spark, sf_dir):
    v = both_views(spark, sf_dir, "candidate").filter("view = 'tone_aware'")
    out = al.wer_by_length(v, m.word_edits(F.col("p"), F.col("r")), F.size(words(F.col("r"))))
    return out.withColumn("wer", F.round("wer", 6))


@query
def chrf_corpus(spark, sf_dir):
    v = both_views(spark, sf_dir).withColumn("s", m.chrf_statistics(F.col("p"), F.col("r")))
    sums = v.groupBy("view").agg(m.pooled_statistics(F.col("s"), m.CHAR_ORDER).alias("s"))
    return sums.select("view", F.round(m.chrf_of(F.col("s")), 6).alias("chrf"))


@query
def chrf_sentence_mean(spark, sf_dir):
    v = both_views(spark, sf_dir).withColumn("s", m.chrf_statistics(F.col("p"), F.col("r")))
    return v.groupBy("view").agg(F.round(F.avg(m.chrf(F.col("p"), F.col("r"), F.col("s"))), 6).alias("chrf"))


def graded_views(spark, sf_dir):
    ex, res = inputs.graded(spark, sf_dir)
    viewed = scoring.views(scoring.answered(ex, res))
    return viewed, scoring.view_labels(viewed)


@query
def accuracy(spark, sf_dir):
    v, labels = graded_views(spark, sf_dir)
    return scoring.values(v, ["accuracy"], labels).groupBy("view").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("accuracy"), 6).alias("accuracy"))


@query
def accuracy_strict(spark, sf_dir):
    v, labels = graded_views(spark, sf_dir)
    return scoring.values(v, ["accuracy_strict"], labels).groupBy("view").agg(F.round(F.avg("accuracy_strict"), 6).alias("accuracy"))


@query
def macro_f1(spark, sf_dir):
    v, labels = graded_views(spark, sf_dir)
    out = scoring.pooled(v, ["macro_f1", "macro_f1_strict"], labels)
    return out.select("view", "metric", F.round("corpus", 6).alias("corpus"))


@query
def paired_wtl(spark, sf_dir):
    out = paired.outcomes(both_runs(spark, sf_dir, ["exact_match"]), ["view", "metric"])
    return out.select("view", "n", "wins", "ties", "losses", *(F.round(c, 6).alias(c) for c in ("base_mean", "candidate_mean", "delta")))


@query
def mcnemar(spark, sf_dir):
    out = paired.outcomes(both_runs(spark, sf_dir, ["exact_match"]), ["view", "metric"])
    p = paired.mcnemar_column(F.col("base_only"), F.col("candidate_only"))
    return out.select("view", "base_only", "candidate_only", F.round(p, 8).alias("p_value"))


@query
def paired_bootstrap_ci(spark, sf_dir):
    return paired.bootstrap(both_runs(spark, sf_dir, ["exact_match"]), ["view", "metric"])


@query
def poisson_bootstrap_ci(spark, sf_dir):
    return paired.poisson_bootstrap(both_runs(spark, sf_dir, ["exact_match"]), ["view", "metric"])


def cut(spark, sf_dir):
    p = both_runs(spark, sf_dir, ["exact_match"]).filter("view = 'tone_aware'")
    return paired.sliced(p, inputs.examples(spark, sf_dir), SLICED)


@query
def slice_means(spark, sf_dir):
    out = paired.outcomes(cut(spark, sf_dir), ["field", "bucket"])
    return out.select("field", "bucket", "n", F.round("base_mean", 6).alias("base_mean"), F.round("candidate_mean", 6).alias("candidate_mean"), (F.col("n") >= paired.MIN_SLICE).alias("judged"))


@query
def slice_verdicts(spark, sf_dir):
    return paired.slices(cut(spark, sf_dir)).drop("first_pos")


@query
def group_counts(spark, sf_dir):
    ex = inputs.examples(spark, sf_dir)
    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), paired.slice_value(f).alias("bucket")) for f in SLICED))).alias("x")
    return ex.select(rows).select("x.*").groupBy("field", "bucket").agg(F.count(F.lit(1)).alias("n"))


def flagged(spark, sf_dir, run):
    a = text_answers(spark, sf_dir, run).filter("status = 'ok'")
    return fl.flag_answers(a, "answer", "reference")


@query
def flag_counts(spark, sf_dir):
    return fl.flag_counts(flagged(spark, sf_dir, "base"))


@query
def flag_comparison(spark, sf_dir):
    return paired.flag_changes(fl.flag_counts(flagged(spark, sf_dir, "base")), fl.flag_counts(flagged(spark, sf_dir, "candidate")))


@query
def text_rules(spark, sf_dir):
    """The rules that look at one text, over whole documents."""
    d = inputs.table(spark, sf_dir, "documents")
    k = normalized_columns(d, {"a": ("text", "strip")})
    return k.select("doc_id", fl.repeats(F.col("a")).alias("repeated"), F.size(fl.numbers(F.col("text"))).cast("long").alias("n_numbers"))


@query
def flag_rules(spark, sf_dir):
    """The rules that hold an answer against its reference, each by itself."""
    a = normalized_columns(answers(spark, sf_dir, "candidate").filter("status = 'ok'"), {"a": ("answer", "strip")})
    p, r = F.col("answer"), F.col("reference")
    return a.select(
        "id",
        (fl.numbers(r) != fl.numbers(p)).alias("number_mismatch"),
        fl.truncated(r, p, F.col("a")).alias("truncated"),
        fl.repeats(F.col("a")).alias("repeated"),
        fl.non_latin(p).alias("non_latin"),
        (fl.stripped(p) == "").alias("blank"),
    )


@query
def duplicates(spark, sf_dir):
    return va.duplicates(va.keyed(inputs.examples(spark, sf_dir))).select("id", "first_pos")


@query
def conflicts(spark, sf_dir):
    """Inputs here are source and language, so that many examples share one."""
    ex = inputs.examples(spark, sf_dir)
    own = ex.withColumn("messages", F.array(F.struct(F.lit("user").alias("role"), F.concat_ws(" ", "domain", "lang").alias("content"))))
    return va.conflicts(va.keyed(own))


@query
def leakage(spark, sf_dir):
    """Documents of even ids against those of odd ids."""
    k = va.keyed(inputs.examples(spark, sf_dir))
    out = va.leakage(k.filter("id % 2 = 0"), k.filter("id % 2 = 1"))
    return out.groupBy("identical").agg(F.count(F.lit(1)).alias("n"))


@query
def text_health(spark, sf_dir):
    """Of examples into which what it looks for has been put."""
    return va.problem_rows(inputs.troubled(inputs.examples(spark, sf_dir))).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query
def diacritic_rates(spark, sf_dir):
    """Languages of the tables are renamed to those that have diacritics to expect."""
    ex = inputs.examples(spark, sf_dir)
    named = ex.withColumn("lang", F.when(F.col("lang") == "fr", "yo").when(F.col("lang") == "es", "ig").when(F.col("lang") == "de", "ha").otherwise("en"))
    out = va.diacritics(named)
    return out.select("lang", "texts", *(F.round(c, 6).alias(c) for c in ("tone_rate", "underdot_rate", "hooked_rate")))


@query
def label_balance(spark, sf_dir):
    ex, _ = inputs.graded(spark, sf_dir)
    k = normalized_columns(ex, {"ref_key": ("reference", "strip")}, "lang")
    return va.label_balance(va.labels(k))


@query
def dataset_stats(spark, sf_dir):
    out = va.statistics(inputs.examples(spark, sf_dir))
    return out.select("field", "n_texts", "min", F.col("median").cast("double").alias("median"), "max")


@query
def dataset_languages(spark, sf_dir):
    return va.languages(inputs.examples(spark, sf_dir))


@query
def latest_record_wins(spark, sf_dir):
    """The last event of each user as the record that stands."""
    e = inputs.table(spark, sf_dir, "events")
    best = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("r")
    return e.groupBy("user_id").agg(best).select("user_id", "r.event_id", "r.event_type")


@query
def failure_streak(spark, sf_dir):
    """The longest run of error events of each user, and how many runs there are."""
    e = inputs.table(spark, sf_dir, "events")
    s = runs.streaks(e, F.col("event_type") == "error", ["ts", "event_id"], ["user_id"])
    return s.groupBy("user_id").agg(F.max("streak").cast("long").alias("longest"), F.count_if(F.col("streak") == 1).alias("runs"))


@query
def resume_pending(spark, sf_dir):
    ex = inputs.examples(spark, sf_dir)
    return runs.pending(ex, inputs.results(ex, "base")).select("id")


@query
def run_summary(spark, sf_dir):
    ex = inputs.examples(spark, sf_dir)
    return runs.run_summary(ex, inputs.results(ex, "base"), inputs.results(ex, "candidate"))


@query
def conversation_examples(spark, sf_dir):
    c = inputs.conversations(spark, sf_dir)
    return c.select("conv_id", "turn", F.size("messages").cast("long").alias("n_messages"), F.length("reference").cast("long").alias("n_chars"))


@query
def training_plan(spark, sf_dir):
    c = training.with_answer(inputs.conversations(spark, sf_dir))
    out = training.plan(c, effective_batch=16, epochs=3)
    return out.withColumn("median_words", F.col("median_words").cast("double"))


@query
def asr_windows(spark, sf_dir):
    """Documents stand for clips of n_chars hundredths of a second."""
    d = inputs.table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * 160).alias("samples")).filter("samples > 0")
    rows = d.select("doc_id", F.posexplode(audio.windows(F.col("samples"))).alias("window", "at"))
    return rows.select("doc_id", F.col("window").cast("long").alias("window"), "at.start", "at.end")


@query
def alignment_errors(spark, sf_dir):
    """All errors of the base run by alignment, which equal its word edits."""
    found = al.errors(answers(spark, sf_dir, "base"))
    n = F.size("ops").cast("long")
    read = F.size(F.filter("ops", lambda o: o["op"] != "insert")).cast("long")
    zero = F.lit(0).cast("long")
    return found.agg(F.coalesce(F.sum(n), zero).alias("errors"), F.coalesce(F.sum(F.col("hits") + read), zero).alias("reference_words"))


@query
def top_substitutions(spark, sf_dir):
    """Of all answered rows of the base run."""
    found = al.errors(answers(spark, sf_dir, "base").filter("status = 'ok'"))
    top = al.top_errors(al.operations(found), "substitute", examples=False)
    return top.select("ref", "hyp", "n", "tone_only")


@query
def score_summary(spark, sf_dir):
    """Every metric of a generation run at once."""
    ex = inputs.dealt(inputs.examples(spark, sf_dir))
    s = scoring.score_run(ex, inputs.results(ex, "candidate"), "generation", ["exact_match", "chrf", "chrf++", "wer", "cer"])["summary"]
    return s.select("view", "metric", "n", "higher_is_better", F.round("mean", 6).alias("mean"), F.round("corpus", 6).alias("corpus"))


@query
def compare_runs(spark, sf_dir):
    """The flagship: both runs scored, paired and judged, for each metric and view."""
    names = ["exact_match", "wer"]
    p = both_runs(spark, sf_dir, names)
    out = paired.tested(p, ["metric", "view"]).drop("first_pos")
    higher = ~F.col("metric").isin(*m.LOWER_IS_BETTER)
    return out.withColumn("verdict", paired.verdict(F.col("low"), F.col("high"), higher))


@query
def compare_outcomes(spark, sf_dir):
    """The flagship without what is drawn at random."""
    names = ["exact_match", "wer", "cer"]
    out = paired.outcomes(both_runs(spark, sf_dir, names), ["metric", "view"])
    return out.select("metric", "view", "n", "wins", "ties", "losses", *(F.round(c, 6).alias(c) for c in ("base_mean", "candidate_mean", "delta")))


@query
def label_lookup(spark, sf_dir):
    """Which of a few words stands first in each document, as a label."""
    d = normalized_columns(inputs.table(spark, sf_dir, "documents"), {"p": ("text", "keep")})
    return d.select("doc_id", m.extract_label(F.col("p"), ["the", "der", "de", "la", "de la", "and"]).alias("label"))


@query
def events_per_window(spark, sf_dir):
    """Beyond the run log: failures in windows of five minutes."""
    e = inputs.table(spark, sf_dir, "events")
    w = e.groupBy(F.window("ts", "5 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return w.select(F.col("w.start").alias("start"), "n", "failed")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_runs(spark, sf_dir)


