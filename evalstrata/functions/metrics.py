"""Metrics as columns over normalised texts, and their pooled forms as sums.

Scales: exact match, accuracy, F1 and error rates are fractions, chrF is 0 to 100. A metric that has no
value is null, never zero.
"""

from __future__ import annotations

import string

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..errors import ConfigError
from .text import collapsed, words

CHAR_ORDER, BETA = 6, 2
LOWER_IS_BETTER = frozenset({"wer", "cer"})
CLASSIFICATION_ONLY = frozenset({"accuracy", "accuracy_strict", "macro_f1", "macro_f1_strict"})
#: Metrics with a value for each example, and all.
PER_EXAMPLE = ("exact_match", "chrf", "chrf++", "wer", "cer", "accuracy", "accuracy_strict")
KNOWN = (*PER_EXAMPLE, "macro_f1", "macro_f1_strict")
TASK_DEFAULTS = {
    "generation": ("exact_match", "chrf"),
    "classification": ("accuracy", "macro_f1"),
    "asr": ("wer", "cer"),
}
#: Labels are compared within each row; more than this are not a label set.
MOST_LABELS = 10_000


def exact_match(pred: Column, ref: Column) -> Column:
    return (pred == ref).cast("double")


def common_start(a: Column, b: Column) -> Column:
    """How many signs two texts have in common at their start (of the first two million): by halves."""
    same = lambda at, n: F.substring(a, at + 1, n) == F.substring(b, at + 1, n)
    found = F.aggregate(F.array(*(F.lit(1 << k) for k in range(20, -1, -1))), F.lit(0), lambda at, n: F.when(same(at, n), at + n).otherwise(at))
    return F.least(found, F.length(a), F.length(b))


def edits(pred: Column, ref: Column) -> Column:
    """Edit distance in signs, of what is left between the common start and the common end, which is the same
    as of the whole."""
    start = common_start(ref, pred)
    rest = F.struct(F.reverse(F.substr(ref, start + 1)).alias("r"), F.reverse(F.substr(pred, start + 1)).alias("p"))
    middle = F.transform(F.array(rest), lambda x: _distance(x["r"], x["p"]))[0]
    return F.when(pred == ref, 0).otherwise(middle)


def _distance(r: Column, p: Column) -> Column:
    end = common_start(r, p)
    return F.levenshtein(F.substr(r, end + 1), F.substr(p, end + 1))


def _without_start(r: Column, p: Column) -> Column:
    """Two texts of words with single blanks, reversed and without the words that both start with."""
    r, p = F.concat(r, F.lit(" ")), F.concat(p, F.lit(" "))
    both = F.substring(r, F.lit(1), common_start(r, p))
    cut = F.length(both) - F.length(F.substring_index(both, " ", -1)) + 1
    turned = lambda t: F.reverse(F.rtrim(F.substr(t, cut)))
    return F.struct(turned(r).alias("r"), turned(p).alias("p"))


def word_edits(pred: Column, ref: Column) -> Column:
    """Word-level edit distance of what is left between the words that both start and end with: each distinct
    word of the rest becomes one character beyond the basic plane (up to a million), and the built-in distance
    does the rest. White space is made single blanks first."""
    r, p = collapsed(ref), collapsed(pred)
    inner = F.transform(F.array(F.struct(r.alias("r"), p.alias("p"))), lambda x: _without_start(x["r"], x["p"]))
    inner = F.transform(inner, lambda x: _without_start(x["r"], x["p"]))
    split = lambda t: F.filter(F.split(t, " "), lambda w: w != "")
    lists = F.transform(inner, lambda x: F.struct(split(x["r"]).alias("r"), split(x["p"]).alias("p"), F.array_distinct(split(F.concat(x["r"], F.lit(" "), x["p"]))).alias("words")))
    sign = lambda w, known: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, w) + 0xFFFF), 8, "0")), "UTF-32")
    coded = lambda ws, known: F.array_join(F.transform(ws, lambda w: sign(w, known)), "")
    return F.transform(lists, lambda x: F.levenshtein(coded(x["r"], x["words"]), coded(x["p"], x["words"])))[0]


def rate(edits: Column, length: Column, pred: Column) -> Column:
    return rate_of(edits, length, F.length(pred) == 0)


def rate_of(edits: Column, length: Column, empty: Column) -> Column:
    """Edits over length; of an empty reference 0 if the answer is empty too, else 1."""
    return F.when(length > 0, edits / length).otherwise(F.when(empty, 0.0).otherwise(1.0))


def wer(pred: Column, ref: Column) -> Column:
    return rate(word_edits(pred, ref), F.size(words(ref)), pred)


def cer(pred: Column, ref: Column) -> Column:
    return rate(edits(pred, ref), F.length(ref), pred)


def pooled_rate(edits: Column, length: Column) -> Column:
    """Aggregate: all edits over all lengths, empty references left out; null if none is left."""
    total = F.sum(F.when(length > 0, length))
    return F.sum(F.when(length > 0, edits)) / F.when(total > 0, total)


def chrf_tokens(text: str) -> list[str]:
    """Words, of which one sign of punctuation is split off the end, or else off the start."""
    out = []
    for w in text.split():
        if len(w) > 1 and w[-1] in string.punctuation:
            out += [w[:-1], w[-1]]
        elif len(w) > 1 and w[0] in string.punctuation:
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out


def gram_counts(a: list | np.ndarray, b: list | np.ndarray, orders: int) -> list[int]:
    """For each order (in answer, in reference, in both) of n-grams of two sequences of items: n-grams are
    numbered from the numbers of those one shorter, so equal numbers are equal n-grams."""
    one = np.unique(np.concatenate([a, b]), return_inverse=True)[1].astype(np.int64)
    kinds, out = int(one.max(initial=0)) + 1, []
    first, second = one[: len(a)], one[len(a) :]
    x, y = first, second
    for n in range(1, orders + 1):
        if n > 1:
            x, y = x[:-1] * kinds + first[n - 1 :], y[:-1] * kinds + second[n - 1 :]
            number = np.unique(np.concatenate([x, y]), return_inverse=True)[1]
            x, y = number[: len(x)], number[len(x) :]
        size = max(int(x.max(initial=0)), int(y.max(initial=0))) + 1
        both = np.minimum(np.bincount(x, minlength=size), np.bincount(y, minlength=size)).sum()
        out += [len(x) if len(y) else 0, len(y), int(both)]
    return out


def chrf_pair(pred: str, ref: str, word_order: int) -> list[int]:
    """The statistics of one pair."""
    bare, words_too = ("".join(t.split()) for t in (pred, ref)), []
    if word_order:
        tokens = [chrf_tokens(t) for t in (pred, ref)]
        number = {w: i for i, w in enumerate(dict.fromkeys([*tokens[0], *tokens[1]]))}
        words_too = gram_counts(*(np.array([number[w] for w in own], np.int64) for own in tokens), word_order)
    return gram_counts(*(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in bare), CHAR_ORDER) + words_too


def chrf_statistics(pred: Column, ref: Column, word_order: int = 0) -> Column:
    """Array of (in answer, in reference, in both) for each n-gram order; the answer's n-grams don't count
    where the reference has none of the order. Counting within a row keeps
    n-grams out of the shuffle; Arrow carries the rows."""
    @F.pandas_udf(ArrayType(LongType()))
    def f(p: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([chrf_pair(a or "", b or "", word_order) for a, b in zip(p, r, strict=True)])

    return f(pred, ref)


def chrf_of(statistics: Column) -> Column:
    """chrF of statistics: precision and recall averaged over the orders that both sides have, F with beta 2."""
    orders = F.transform(F.sequence(F.lit(0), (F.size(statistics) / 3).cast("int") - 1), lambda i: F.slice(statistics, (i * 3 + 1).cast("int"), 3))
    used = F.filter(orders, lambda o: (o[0] > 0) & (o[1] > 0))
    total = lambda pick: F.aggregate(used, F.lit(0.0), lambda a, o: a + o[2] / pick(o))
    n = F.size(used)
    precision, recall = total(lambda o: o[0]) / n, total(lambda o: o[1]) / n
    weight = BETA * BETA
    return F.when((n > 0) & (precision + recall > 0), 100.0 * (1 + weight) * precision * recall / (weight * precision + recall)).otherwise(0.0)


def chrf(pred: Column, ref: Column, statistics: Column) -> Column:
    return chrf_where(F.length(pred) == 0, F.length(ref) == 0, statistics)


def chrf_where(no_answer: Column, no_reference: Column, statistics: Column) -> Column:
    """chrF of one pair: 100 if both are empty, 0 if one is."""
    return F.when(no_answer & no_reference, 100.0).when(no_answer | no_reference, 0.0).otherwise(chrf_of(statistics))


def chrf_value(answer: int, reference: int, statistics: list[int]) -> float:
    """`chrf_where` of one pair in Python, of so many signs; the same steps, so the same number."""
    if not answer or not reference:
        return 0.0 if answer or reference else 100.0
    precision = recall = 0.0
    n = 0
    for i in range(0, len(statistics), 3):  # not sum(), which makes up for what is rounded off
        a, b, both = statistics[i : i + 3]
        if a > 0 and b > 0:
            precision, recall, n = precision + both / a, recall + both / b, n + 1
    precision, recall = precision / (n or 1), recall / (n or 1)
    if precision + recall <= 0:
        return 0.0
    weight = BETA * BETA
    return 100.0 * (1 + weight) * precision * recall / (weight * precision + recall)


def pooled_statistics(statistics: Column, orders: int) -> Column:
    """Aggregate: statistics summed over rows."""
    return F.array(*(F.sum(statistics[i]) for i in range(3 * orders)))


def label_set(df: DataFrame, ref: str) -> list[str]:
    """The distinct references as labels; refused beyond MOST_LABELS."""
    rows = df.select(ref).filter(F.col(ref).isNotNull()).distinct().limit(MOST_LABELS + 1).collect()
    if len(rows) > MOST_LABELS:
        raise ConfigError(f"More than {MOST_LABELS} labels.", "Use exact_match or chrf instead.")
    return sorted(r[0] for r in rows)


def extract_label(pred: Column, labels: list[str], strict: bool = False) -> Column:
    """The label an answer names: the earliest as whole words, the longest of those, then the first in
    order. Strict: the whole answer is a label."""
    if not [x for x in labels if x]:
        return F.lit(None).cast("string")
    known = F.array(*(F.lit(x) for x in labels if x))
    if strict:
        answer = F.trim(pred)
        return F.when(F.array_contains(known, answer), answer)
    padded = F.concat(F.lit(" "), pred, F.lit(" "))
    places = F.transform(known, lambda x: F.struct(F.instr(padded, F.concat(F.lit(" "), x, F.lit(" "))).alias("at"), (-F.length(x)).alias("size"), x.alias("label")))
    return F.array_min(F.filter(places, lambda p: p["at"] > 0))["label"]


def macro_f1(df: DataFrame, by: list[str], label: str, ref: str) -> DataFrame:
    """Mean over the classes in `ref` of F1; an answer without a label is a miss of its class only."""
    refs = df.groupBy(*by, F.col(ref).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label).eqNullSafe(F.col(ref))).alias("tp"))
    preds = df.filter(F.col(label).isNotNull()).groupBy(*by, F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("p"))
    joined = refs.join(preds, [*by, "class"], "left")
    f1 = 2 * F.col("tp") / (F.col("n") + F.coalesce("p", F.lit(0)))
    return joined.groupBy(*by).agg(F.avg(f1).alias("macro_f1"))


def exact_mean(values: Column) -> Column:
    """Aggregate: the mean with an exactly rounded sum, whatever the order."""
    import math

    @F.pandas_udf("double")
    def f(x: pd.Series) -> float:
        x = x.dropna()
        return math.fsum(x) / len(x) if len(x) else None

    return f(values)
