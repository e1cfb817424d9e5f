"""Work on the words of a row in Python, over Arrow: normal forms, distances and n-gram counts.

Words that an answer and its reference both start and end with are set aside before anything is counted;
n-grams wholly within them are common to both, so only those that reach what lies between are looked at.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import cache, cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from .text import APOSTROPHES, STABLE, TONE_MARKS, VIEWS

#: Rows of a batch that are turned into strings at once, and bytes of an Arrow batch.
ROWS, BATCH_BYTES = 500, "4194304b"
DEFAULT_BATCH_BYTES = "67108864b"
#: Signs up to which n-grams are counted without arrays, and of the ends that are looked at beside the middle.
SHORT, NEAR = 300, 100


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes, where it has set no bound: texts may be long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == DEFAULT_BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def blank_or(sign: str) -> str:
    """What the steps on apostrophes and punctuation make of a sign."""
    if sign in APOSTROPHES:
        return "'"
    return " " if sign != "'" and unicodedata.category(sign)[0] in "PS" else sign


ASCII = {i: blank_or(chr(i)) for i in range(128)}
#: What becomes of other signs, once seen.
SEEN: dict[str, str] = {}


def form(text: str, tones: str, orphans: bool) -> str:
    """The normal form of a text, as `normalize_text` gives it, with each step over the whole text at once.
    `orphans`: only apostrophes that stand alone are dropped."""
    x = text.lower()
    if x.isascii():
        x = x.translate(ASCII)
    else:
        if tones == "strip":
            x = unicodedata.normalize("NFD", x)
            for mark in TONE_MARKS:
                x = x.replace(mark, "")
        x = unicodedata.normalize("NFC", x)
        for sign in set(x):
            other = SEEN.get(sign)
            if other is None:
                other = SEEN[sign] = blank_or(sign)
            if other != sign:
                x = x.replace(sign, other)
    if "'" in x:
        parts = x.split("'")
        word = lambda c: c.isalnum() or c == "_"
        out = [parts[0]]
        for left, right in pairwise(parts):
            beside = word(left[-1:]), word(right[:1])
            out += ["'" if (any(beside) if orphans else all(beside)) else " ", right]
        x = "".join(out)
    return " ".join(x.split())


def common_start(a: Sequence, b: Sequence) -> int:
    """How many items two sequences have in common at their start: by halves."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def common_ends(a: Sequence, b: Sequence) -> tuple[int, int]:
    """Items in common at the start, and then at the end of what is left."""
    head = common_start(a, b)
    return head, common_start(a[head:][::-1], b[head:][::-1])


def step(eq: int, pv: int, mv: int, full: int) -> tuple[int, int]:
    """The next column of a table of edit distances, as bits of the places where it rises and falls (Myers, Hyyrö)."""
    xv = eq | mv
    xh = ((((eq & pv) + pv) ^ pv) | eq) & full
    ph = (((full & ~(xh | pv)) | mv) << 1 | 1) & full
    mh = ((pv & xh) << 1) & full
    return mh | (full & ~(xv | ph)), ph & xv


def places(items: Sequence) -> dict:
    """The places of each distinct item as bits."""
    at: dict = {}
    for i, x in enumerate(items):
        at.setdefault(x, []).append(i)
    out = {}
    for x, own in at.items():
        bits = bytearray(own[-1] // 8 + 1)
        for i in own:
            bits[i >> 3] |= 1 << (i & 7)
        out[x] = int.from_bytes(bits, "little")
    return out


def distance(a: Sequence, b: Sequence) -> int:
    """Edit distance of two sequences: a column of bits at a time, so memory grows with their lengths only."""
    head, tail = common_ends(a, b)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        return len(a) + len(b)
    full, at = (1 << len(a)) - 1, places(a)
    pv, mv = full, 0
    for x in b:
        pv, mv = step(at.get(x, 0), pv, mv, full)
    return len(b) + pv.bit_count() - mv.bit_count()


def in_both(a: Sequence, b: Sequence, orders: int, counts: Callable) -> list[int]:
    """How many n-grams of each order two sequences have in common."""
    if len(a) + len(b) > SHORT:
        return counts(a, b)
    key = (lambda x: x) if isinstance(a, str) else tuple
    grams = lambda x, n: Counter([key(x[i : i + n]) for i in range(len(x) - n + 1)])
    return [(grams(a, n) & grams(b, n)).total() for n in range(1, orders + 1)]


def statistics(answer: int, reference: int, common: list[int]) -> list[int]:
    """(in answer, in reference, in both) for each order, of sequences of so many items."""
    out = []
    for n, both in enumerate(common):
        in_reference = max(reference - n, 0)
        out += [max(answer - n, 0) if in_reference else 0, in_reference, both]
    return out


@cache
def kinds() -> np.ndarray:
    """What the normal form makes of each sign up to the last of these: 0 blank, 1 letter or digit, 2 another sign,
    3 apostrophe, 4 told by the form only. The first three are one sign in both views, whatever stands beside."""
    found = np.full(0x20C1, 4, np.uint8)
    stable = re.compile(STABLE)
    for cp in range(len(found) - 1):
        low = chr(cp).lower()
        both = unicodedata.normalize("NFC", low), unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", low) if c not in TONE_MARKS))
        if not stable.match(chr(cp)) or any(len(x) != 1 for x in both):
            continue
        own = {0 if x.isspace() else 3 if x == "'" else 1 if x.isalnum() else 2 for x in map(blank_or, both)}
        if len(own) == 1:
            found[cp] = own.pop()
    return found


@cache
def latin_kinds() -> bytes:
    return kinds()[:256].tobytes()


@cache
def latin_forms() -> bytes:
    """Signs of Latin-1 in the normal form without tone marks, where they are blanks, letters or digits."""
    return bytes(ord(form(chr(i), "strip", False) or " ") if kind < 2 else i for i, kind in enumerate(latin_kinds()))


def latin_words(text: str) -> list[bytes] | None:
    """The words of the normal form without tone marks, in Latin-1; None of other texts, and of those with apostrophes
    or with signs that are no letters or digits."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    own = raw.translate(latin_kinds())
    return None if any(k in own for k in (b"\2", b"\3", b"\4")) else raw.translate(latin_forms()).split()


def is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def counted(text: str, orphans: bool) -> tuple[int, int] | None:
    """Words and signs (without blanks) of the normal form, in either view, sign by sign; None if only the form tells."""
    if not text:
        return 0, 0
    try:
        own = np.frombuffer(text.encode("latin-1").translate(latin_kinds()), np.uint8)
    except UnicodeEncodeError:
        of = kinds()
        own = of[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), len(of) - 1)]
    most = own.max()
    if most == 4:
        return None
    if most == 3:
        own = np.concatenate([[0], own, [0]])
        at = np.flatnonzero(own == 3)
        left, right = own[at - 1] == 1, own[at + 1] == 1
        own[at] = (left | right) if orphans else (left & right)
    there = own != 0
    return int(np.count_nonzero(there[1:] > there[:-1])) + int(there[0]), int(np.count_nonzero(there))


def n_words(form_: str) -> int:
    return form_.count(" ") + 1 if form_ else 0


def bare(text: str) -> str:
    return text.replace(" ", "")


class Pair:
    """An answer and its reference under a view: what both start with, what lies between, what both end with. Only the
    middle is made a normal form at once; the ends are counted, and their forms made where a method needs them."""

    def __init__(self, parts: tuple[str, str, str, str], tones: str, orphans: bool, counts: list[tuple[int, int] | None]) -> None:
        start, p, r, end = parts
        self.ends, self.form, self.orphans = (start, end), (lambda x: form(x, tones, orphans) if x else ""), orphans
        self.p, self.r = self.form(p), self.form(r)
        whole = lambda x: (n_words(x), len(bare(x)))
        self.counts = [whole(x) if c is None else c for x, c in zip((self.head, self.tail) if None in counts else self.ends, counts, strict=True)]

    @cached_property
    def head(self) -> str:
        return self.form(self.ends[0])

    @cached_property
    def tail(self) -> str:
        return self.form(self.ends[1])

    def same(self) -> bool:
        return self.p == self.r

    def whole(self, middle: str) -> str:
        return " ".join(filter(None, (self.head, middle, self.tail)))

    def size(self, middle: str) -> int:
        """Signs of the whole text."""
        ws = self.n_words(middle)
        return sum(signs for _, signs in self.counts) + len(middle) - max(n_words(middle) - 1, 0) + max(ws - 1, 0)

    def n_words(self, middle: str) -> int:
        return sum(ws for ws, _ in self.counts) + n_words(middle)

    def word_edits(self) -> int:
        return 0 if self.same() else distance(self.p.split(), self.r.split())

    def edits(self) -> int:
        if self.same():
            return 0
        head, tail = (ws for ws, _ in self.counts)
        before, after = (" ", "") if head else ("", " ") if tail else ("", "")
        put = lambda x: f"{before}{x}{after}" if x else ""
        return distance(put(self.p), put(self.r))

    def near(self, n: int) -> tuple[str, str]:
        """Forms of as much of the start's end and of the end's start as hold `n` signs, or of all; whole words."""
        start, end = self.ends
        cut = start.find(" ", max(len(start) - NEAR, 0)) if len(start) > NEAR else 0
        head = self.form(start[cut:]) if cut > 0 else ""
        stop = end.rfind(" ", 0, NEAR) if len(end) > NEAR else 0
        tail = self.form(end[:stop]) if stop > 0 else ""
        return head if len(bare(head)) >= n else self.head, tail if len(bare(tail)) >= n else self.tail

    def signs(self, orders: int, counts: Callable) -> list[int]:
        """Statistics of n-grams of signs, without blanks."""
        ends = sum(signs for _, signs in self.counts)
        p, r = bare(self.p), bare(self.r)
        if p == r:
            return statistics(ends + len(p), ends + len(r), [max(ends + len(r) - n, 0) for n in range(orders)])
        near = orders - 1
        head, tail = self.near(near)
        before, after = bare(head[-2 * near :])[-near:], bare(tail[: 2 * near])[:near]
        aside = ends - len(before) - len(after)
        common = in_both(before + p + after, before + r + after, orders, counts)
        return statistics(ends + len(p), ends + len(r), [aside + c for c in common])

    def tokens(self, orders: int, split: Callable, counts: Callable) -> list[int]:
        """Statistics of n-grams of words, of which `split` makes one or two tokens each."""
        # an apostrophe stands at the end of a word only where just lone ones are dropped
        many = lambda k: len(split(x)) if self.orphans and "'" in (x := (self.head, self.tail)[k]) else self.counts[k][0]
        ends = many(0) + many(1)
        p, r = split(self.p), split(self.r)
        if p == r:
            return statistics(ends + len(p), ends + len(r), [max(ends + len(r) - n, 0) for n in range(orders)])
        near = orders - 1
        head, tail = self.near(1)
        before, after = split(head[head.rfind(" ") + 1 :])[-near:], split(tail.partition(" ")[0])[:near]
        aside = ends - len(before) - len(after)
        common = in_both(before + p + after, before + r + after, orders, counts)
        return statistics(ends + len(p), ends + len(r), [aside + c for c in common])


def parted(answer: str, reference: str) -> tuple[str, str, str, str]:
    """What two texts both start with, what lies between in each, what both end with; cut at blanks only, as no
    step of a normal form looks beyond them."""
    if answer == reference:
        return reference, "", "", ""
    start = reference.rfind(" ", 0, common_start(answer, reference)) + 1
    p, r = answer[start:], reference[start:]
    both = common_start(p[::-1], r[::-1])
    at = r.find(" ", len(r) - both)
    size = len(r) - at if at >= 0 else 0
    return reference[:start], p[: len(p) - size], r[: len(r) - size], r[len(r) - size :]


def parted_in_lower_case(answer: str, reference: str) -> tuple[str, str, str, str]:
    """`parted`, and what lies between once more in lower case if it is long: no step looks at the case."""
    start, p, r, end = parted(answer, reference)
    if len(p) + len(r) > SHORT:
        more, p, r, less = parted(p.lower(), r.lower())
        start, end = start + more, less + end
    return start, p, r, end


def pairs_of(answer: str, reference: str, lang: str | None) -> dict[str, Pair]:
    """The pair under each view: the same where neither what is counted nor what is compared depends on the view, as
    texts without other signs than ASCII have no tone marks."""
    parts, orphans = parted_in_lower_case(answer, reference), lang == "ha"
    counts = [counted(x, orphans) for x in (parts[0], parts[3])]
    make = lambda tones: Pair(parts, tones, orphans, counts)
    first, *others = VIEWS
    pair = make(VIEWS[first])
    alike = parts[1].isascii() and parts[2].isascii() and (pair.same() and None not in counts or answer.isascii() and reference.isascii())
    return {first: pair} | {v: pair if alike else make(VIEWS[v]) for v in others}
