"""Failure-mode flags of answers, as array columns in a fixed order.

`answer` below is the tone-insensitive normal form of the prediction. Each rule is a column of built-in
functions; `flag_answers` applies them together, as functions of one row's texts over Arrow, where whole
texts take a tenth of the time; only the script rule is a column there too. It counts letters
by script property, so letters of Latin script that aren't named LATIN (ª, º, modifier letters) count
as Latin.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import ROWS, form, is_latin, latin_words, parted_in_lower_case, small_batches
from .text import WORD, normalized

#: Flags in the order of reports, and what they mean.
FLAGS = {
    "empty_output": "the call succeeded but the answer was empty",
    "repeated_output": "a word or four-word phrase repeats until it fills the answer",
    "truncated_output": "a long answer stops where the reference ends in a full stop",
    "format_noncompliant": "the answer is not in the requested format",
    "missing_required_terms": "an entity or acronym from the reference is missing",
    "number_mismatch": "the answer's numbers differ from the reference's",
    "script_mismatch": "the answer is in a non-Latin script (script statistics, not language ID)",
}
FORMATS = ("json", "number")
ENDS, WORDS = frozenset(".!?…"), re.compile(r"\w+")
DOMINANT, PHRASE, REPEATS = 0.5, 4, 3
BLANK_ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, BLANK_ENDS, "")


def most_often(items: Column) -> Column:
    """How often the most frequent item of an array of strings occurs: the longest run once sorted."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(a: Column, x: Column) -> Column:
        run = F.when((a["run"] > 0) & (a["last"] == x), a["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(a["most"], run).alias("most"))

    return F.aggregate(F.array_sort(items), start, step, lambda a: a["most"])


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"{WORD}+"), F.lit(0))


def repeats(answer: Column) -> Column:
    """The words are bound once: an expression that a lambda names is worked out for each element."""

    def of(w: Column) -> Column:
        n = F.size(w)
        dominant = (n >= 8) & (most_often(w) >= n * DOMINANT)
        places = F.when(n >= PHRASE, F.sequence(F.lit(1), F.greatest(n - PHRASE + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        phrases = F.transform(places, lambda i: F.array_join(F.slice(w, i, PHRASE), " "))
        return dominant | ((n >= PHRASE * REPEATS) & (most_often(phrases) >= REPEATS))

    return F.transform(F.array(tokens(answer)), of)[0]


def truncated(reference: Column, prediction: Column, answer: Column) -> Column:
    end = r"[.!?…](?U)[\s\x1c-\x1f]*$"
    bare = stripped(F.regexp_replace(stripped(prediction), r"[\"'”’)\]}]+$", ""))
    return reference.rlike(end) & (bare != "") & ~bare.rlike(r"[.!?…]$") & (F.size(tokens(answer)) >= 5)


def required(reference: Column) -> Column:
    """Names and acronyms of a reference; capitalised first words of sentences are left out."""
    name = rf"(?<!{WORD})(?:[A-Z]{{2,}}|(?<!^)(?<![.!?]\s{{1,64}})[A-Z][a-z]{{2,}})(?!{WORD})"
    return F.array_distinct(F.regexp_extract_all(reference, F.lit(name), F.lit(0)))


def missing_terms(terms: Column, answer: Column) -> Column:
    """Those of the terms that the answer doesn't hold, as substrings."""
    return F.filter(terms, lambda t: ~F.contains(answer, normalized(t, "strip")))


def numbers(text: Column) -> Column:
    joined = F.regexp_replace(text, r"(?<=\p{Nd}),(?=\p{Nd})", "")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(joined, F.lit(r"\p{Nd}+(?:\.\p{Nd}+)?"), F.lit(0))))


def non_latin(text: Column) -> Column:
    letters = F.length(F.regexp_replace(text, r"\P{L}", ""))
    foreign = F.length(F.regexp_replace(text, r"\P{L}|\p{IsLatin}", ""))
    return (letters >= 10) & (foreign >= 0.2 * letters)


NAME = re.compile(r"(?<!\w)(?:[A-Z]{2,}|[A-Z][a-z]{2,})(?!\w)", re.ASCII)
NUMBER = re.compile(r"\d+(?:\.\d+)?")
ONE_NUMBER = re.compile(r"\d+(?:\.\d+)?(?:\r\n|[\n\r\x85\u2028\u2029])?")
ASCII_BLANK = " \t\n\x0b\f\r"
#: Texts of these characters have letters of Latin script only.
LATIN = "^[\\x00-\\xb4\\xb6-\\u02af]*$"
#: A sign that isn't among the first 256 of them; these are listed singly, as that is looked up in a table of bits.
BEYOND = "[^" + "".join(f"\\x{i:02x}" for i in range(256) if i != 0xB5) + "]"
#: Words from which on hash values are sorted before anything is counted, and the factor of those of a phrase.
MANY, FACTOR = 40, np.uint64(0x9E3779B97F4A7C15)


def is_json(text: str) -> bool:
    text = text.strip()
    if text[:1] not in ("{", "["):
        return False
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return False
    return True


def repeated(words: list) -> bool:
    """`repeats` of one text's words. Of longer texts hash values are sorted first: where none of them is as frequent
    as asked, no word or phrase is."""
    n = len(words)
    if n > MANY:
        own = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        phrases = own[: 1 - PHRASE].copy()
        for k in range(1, PHRASE):
            phrases = phrases * FACTOR + own[k : n - PHRASE + 1 + k]
        if not (frequent(own, ceil(n * DOMINANT)) or frequent(phrases, REPEATS)):
            return False
    if n >= 8 and max(Counter(words).values()) >= n * DOMINANT:
        return True
    return n >= PHRASE * REPEATS and max(Counter(zip(*(words[k:] for k in range(PHRASE)), strict=False)).values()) >= REPEATS


def frequent(items: np.ndarray, times: int) -> bool:
    """Whether any item occurs so often."""
    items = np.sort(items)
    return bool((items[times - 1 :] == items[: len(items) - times + 1]).any())


def names_in(reference: str, start: int = 0, stop: int | None = None) -> set[str]:
    """`required` of one text, or of a part of it that blanks or its ends bound."""
    found = set()
    for hit in NAME.finditer(reference, start, len(reference) if stop is None else stop):
        at, word = hit.start(), hit.group()
        # the signs beside a name are looked at beyond ASCII too
        if (at and is_word(reference[at - 1])) or is_word(reference[hit.end() : hit.end() + 1]):
            continue
        if not word[1].isupper():
            before = reference[max(at - 65, 0) : at]
            bare = before.rstrip(ASCII_BLANK)
            if not at or (len(bare) < len(before) and bare[-1:] in {".", "!", "?"}):
                continue
        found.add(word)
    return found


def is_word(sign: str) -> bool:
    return sign.isalnum() or sign == "_"


def numbers_in(text: str) -> set[str]:
    return {*NUMBER.findall(re.sub(r"(?<=\d),(?=\d)", "", text) if "," in text else text)}


def raised(p: str, r: str, wanted: str | None, terms: list | None, needs_terms: bool) -> list[str]:
    """The flags of one answer, but for the one on its script; none of an empty answer but that it is empty. Words that
    both texts start and end with hold the same names and numbers, so those are looked for in between: in texts in
    Latin-1, which have no marks that join with letters and as many signs in lower case."""
    bare = p.strip()
    if not bare:
        return ["empty_output"]
    words = latin_words(p)
    if words is None:
        a = form(p, "strip", False)
        words = WORDS.findall(a)
    else:
        a = b" ".join(words).decode("latin-1")
    start, stop, numbers = 0, len(r), p != r
    if is_latin(p) and is_latin(r):
        head, *middle, tail = parted_in_lower_case(p, r)
        start, stop = len(head), len(r) - len(tail)
        numbers = numbers and numbers_in(middle[0]) != numbers_in(middle[1])
    asked = wanted if wanted in FORMATS else "json" if is_json(r) else None
    end = bare.rstrip("\"'”’)]}").strip()
    wrong = asked == "json" and not is_json(p) or asked == "number" and not ONE_NUMBER.fullmatch(bare.rstrip("."))
    # terms that are given replace those of the reference
    needed = names_in(r, start, stop) if terms is None or not needs_terms else {t for t in terms if t is not None}
    rules = {
        "repeated_output": repeated(words),
        "truncated_output": r.rstrip()[-1:] in ENDS and bool(end) and end[-1] not in ENDS and len(words) >= 5,
        "format_noncompliant": wrong,
        "missing_required_terms": any(form(t, "strip", False) not in a for t in needed),
        "number_mismatch": numbers and numbers_in(r) != numbers_in(p),
    }
    return [name for name, rule in rules.items() if rule]


def flag_answers(df: DataFrame, prediction: str = "prediction", reference: str = "reference", wanted: str | None = None, terms: str | None = None) -> DataFrame:
    """`df` with `flags`, an array of names. `wanted` names a column that asks for a format, `terms` one
    of terms that replace those found in the reference. Rows with a null prediction or reference have
    no flags."""
    small_batches(df.sparkSession)

    @F.arrow_udf("array<string>")
    def rules(p: pa.Array, r: pa.Array, own: pa.Array, needed: pa.Array) -> pa.Array:
        out = []
        for k in range(0, len(p), ROWS):
            rows = zip(*(c.slice(k, ROWS).to_pylist() for c in (p, r, own, needed)), strict=True)
            out += [[] if a is None or b is None else raised(a, b, x, t, terms is not None) for a, b, x, t in rows]
        return pa.array(out, pa.list_(pa.string()))

    p = F.col(prediction)
    asked = F.col(wanted) if wanted else F.lit(None).cast("string")
    needed = F.col(terms) if terms else F.lit(None).cast("array<string>")
    foreign = F.when(p.isNull() | F.col(reference).isNull() | ~p.rlike(BEYOND), False).when((stripped(p) == "") | p.rlike(LATIN), False).otherwise(non_latin(p))
    script = F.when(F.col("_foreign"), F.array(F.lit("script_mismatch"))).otherwise(F.array().cast("array<string>"))
    own = df.withColumn("_foreign", foreign).withColumn("_rules", rules(p, F.col(reference), asked, needed))
    return own.withColumn("flags", F.concat("_rules", script)).drop("_foreign", "_rules")


def flag_counts(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, name, n) of the flags raised. From a plain explode a filter of empty arrays would be inferred, for which the
    rules would be worked out once more."""
    by = by or []
    return df.select(*by, F.explode_outer("flags").alias("name")).filter(F.col("name").isNotNull()).groupBy(*by, "name").agg(F.count(F.lit(1)).alias("n"))
