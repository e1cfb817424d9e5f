"""Text normalisation under a tone-aware and a tone-insensitive view.

Steps: lower case, Unicode NFC (without tone marks in the insensitive view), one kind of apostrophe,
punctuation and symbols to blanks, white space to single blanks. All but NFC are built-in functions.
Texts made of characters that NFC leaves alone take a path without Python; the others, told apart by
a filter, go through one Arrow function.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..errors import ConfigError

#: Languages and their other names.
LANGUAGES = ("ha", "yo", "ig", "en")
ALIASES = {"hausa": "ha", "yoruba": "yo", "igbo": "ig", "english": "en", "eng": "en"}

#: Grave, acute, circumflex, macron and caron.
TONE_MARKS = "̀́̂̄̌"
#: Look-alikes of the apostrophe.
APOSTROPHES = "‘’‛ʼʻʹ`´"

WORD = r"[\p{L}\p{N}_]"
VIEWS = {"tone_aware": "keep", "tone_insensitive": "strip"}

#: Texts of these characters are in NFC, and stay so in lower case.
STABLE = "^[\\x00-\\u012f\\u0131-\\u02ff\\u0400-\\u0482\\u1e00-\\u1eff\\u2002-\\u206f\\u20a0-\\u20bf\\u4e00-\\u9fff]*$"


def tone_table() -> tuple[str, str]:
    """Composed letters with a tone mark, and the same letters without it; made from the Unicode data."""
    marked, bare = [], []
    for cp in range(0xC0, 0x2000):
        c = chr(cp)
        if unicodedata.normalize("NFC", c) != c:
            continue
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and any(m in parts for m in TONE_MARKS):
            left = unicodedata.normalize("NFC", "".join(p for p in parts if p not in TONE_MARKS))
            if len(left) == 1:
                marked.append(c)
                bare.append(left)
    return "".join(marked), "".join(bare)


MARKED, BARE = tone_table()


#: What each setting may be.
SETTINGS = {"lang": (None, *LANGUAGES), "tones": ("keep", "strip"), "lowercase": (True, False), "punctuation": ("strip", "keep")}


@dataclass(frozen=True)
class NormalizeConfig:
    """Settings of normalize_text; each must be one of SETTINGS."""

    lang: str | None = None
    tones: str = "keep"
    lowercase: bool = True
    punctuation: str = "strip"

    def __post_init__(self) -> None:
        wrong = {name: value for name, value in vars(self).items() if value not in SETTINGS[name]}
        if wrong:
            name, value = next(iter(wrong.items()))
            raise ConfigError(f"{name}={value!r} is not a setting of text normalisation.", f"{name} may be: {', '.join(map(str, SETTINGS[name]))}.")


def language(name: Column) -> Column:
    """The language of a name or alias; null if unknown."""
    key = F.lower(F.trim(name))
    known = F.create_map(*(F.lit(x) for pair in {**{v: v for v in LANGUAGES}, **ALIASES}.items() for x in pair))
    return known[key]


#: A sign that may be white space other than blanks and line feeds, or is beyond Latin-1; the others are listed singly,
#: as that is looked up in a table of bits.
ODD_BLANK = "[^\n" + "".join(f"\\x{i:02x}" for i in range(256) if not chr(i).isspace() or i == 32) + "]"


def collapsed(text: Column) -> Column:
    """White space as single blanks, none at the ends. Most texts have blanks and line feeds only, which takes no
    pattern."""
    lines = F.replace(text, F.lit("\n"), F.lit(" "))
    plain = F.when(F.contains(lines, F.lit("  ")), F.regexp_replace(lines, "  +", " ")).otherwise(lines)
    return F.trim(F.when(text.rlike(ODD_BLANK), F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " ")).otherwise(plain))


def words(text: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(collapsed(text), " "), lambda w: w != "")


def without_tones(text: Column) -> Column:
    """NFC text without tone marks. Right where removing a mark leaves NFC text, as in STABLE texts."""
    return F.regexp_replace(F.translate(text, MARKED, BARE), f"[{TONE_MARKS}]", "")


def normalized(text: Column, tones: str = "keep", lang: Column | str | None = None, lowercase: bool = True, punctuation: str = "strip") -> Column:
    """Normal form of a text that is in NFC also in lower case; see `composed` for texts that may not be."""
    x = F.lower(text) if lowercase else text
    if tones == "strip":
        x = without_tones(x)
    if punctuation == "strip":
        x = F.translate(x, APOSTROPHES, "'" * len(APOSTROPHES))
        x = F.regexp_replace(x, r"[\p{P}\p{S}&&[^\x27]]", " ")
        edge = F.regexp_replace(x, f"(?<!{WORD})'|'(?!{WORD})", " ")
        orphan = F.regexp_replace(x, f"(?<!{WORD})'(?!{WORD})", " ")
        if isinstance(lang, str):
            x = orphan if lang == "ha" else edge
        elif lang is not None:
            x = F.when(lang == "ha", orphan).otherwise(edge)
        else:
            x = edge
    return collapsed(x)


def _udf(tones: str, lowercase: bool):
    @F.pandas_udf(StringType())
    def f(text: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            t = t.lower() if lowercase else t
            if tones == "strip":
                t = "".join(c for c in unicodedata.normalize("NFD", t) if c not in TONE_MARKS)
            return unicodedata.normalize("NFC", t)

        return text.map(one)

    return f


def normalized_columns(df: DataFrame, columns: dict[str, tuple[str, str]], lang: str | None = None) -> DataFrame:
    """`df` with normal forms: new column to (text column, tones). Rows whose texts NFC may change are
    told apart by a filter, so that only they pass through Python."""
    sources = sorted({c for c, _ in columns.values()})
    stable = None
    for c in sources:
        ok = F.coalesce(F.col(c).rlike(STABLE), F.lit(True))
        stable = ok if stable is None else stable & ok
    by = F.col(lang) if lang else None
    plain = df.filter(stable).withColumns({n: normalized(F.col(c), tones, by) for n, (c, tones) in columns.items()})
    other = df.filter(~stable)
    for n, (c, tones) in columns.items():
        other = other.withColumn(n, normalized(_udf(tones, True)(F.col(c)), "keep", by, lowercase=False))
    return plain.unionByName(other)


#: Step by step on the driver, by name.
STEPS = {
    "lower": str.lower,
    "decompose": lambda t: unicodedata.normalize("NFD", t),
    "drop tones": lambda t: t.translate(dict.fromkeys(map(ord, TONE_MARKS))),
    "compose": lambda t: unicodedata.normalize("NFC", t),
    "apostrophes": lambda t: t.translate(dict.fromkeys(map(ord, APOSTROPHES), "'")),
    "punctuation": lambda t: "".join([c if c == "'" or unicodedata.category(c)[0] not in "PS" else " " for c in t]),
    "lone apostrophes": lambda t: re.sub(r"(?<!\w)'(?!\w)", " ", t),
    "edge apostrophes": lambda t: re.sub(r"(?<!\w)'|'(?!\w)", " ", t),
}


def steps_of(config: NormalizeConfig) -> list[str]:
    """The names of the steps that a configuration asks for, in order."""
    chosen = ["lower"] * config.lowercase + ["decompose", "drop tones"] * (config.tones == "strip") + ["compose"]
    if config.punctuation == "strip":
        chosen += ["apostrophes", "punctuation", "lone apostrophes" if config.lang == "ha" else "edge apostrophes"]
    return chosen


def normalize_text(text: str, config: NormalizeConfig | None = None) -> str:
    """The normal form of one string, on the driver."""
    done = reduce(lambda t, step: STEPS[step](t), steps_of(config or NormalizeConfig()), text)
    return " ".join(done.split())
