"""License scans by an exact set-similarity join between text blocks and license templates.

A block is a line of a text, lines over `block_words` words in overlapping windows of that length, or
a window over the words of the whole text, which finds notices that are wrapped over lines. These
windows have three times the words of the longest template and overlap by two thirds, so any run of
twice the longest template lies in one; those within one line that is a block are left out.
A template matches a block when the block has at least `threshold` of the template's distinct words.
All words of the templates are put in one global order, the rarest in the corpus first. Prefix
filter: a matching block has one of the first `n - need + 1` words of the template in that order.
Length filter: a block of fewer than `need` distinct words can't match. Positional filter: at the
first common word, the words of the template from there on must still be enough. Blocks that pass
are compared in full, so the join misses none and finds none too many.

Beside the join, phrases that name a license are found as runs of words.

Defined cases: null and empty texts have no words, no labels and the score 0. Labels are distinct and
sorted. Repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, two_columns, words

#: Phrases and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Short notices by which works state their license.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license, version 2.0",
    "apache-2.0-notice": "you may not use this file except in compliance with the license. you may obtain a copy of the license at",
    "bsd": "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "licensed under cc by 4.0",
    "cc-by-nc": "licensed under cc by-nc 4.0",
    "cc-by-sa": "licensed under cc by-sa 4.0",
    "gpl-3.0": "licensed under the gnu general public license, version 3",
    "lgpl": "licensed under the gnu lesser general public license",
    "mit": "released under the mit license",
    "mit-notice": "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license, v. 2.0",
    "public-domain": "this is free and unencumbered software released into the public domain",
    "reserved": "all rights reserved",
}

BLOCK_WORDS = 256


def longest(templates: dict[str, str]) -> int:
    """Words of the longest template."""
    return max((len(words(t)) for t in templates.values()), default=0)


LONGEST = longest(TEMPLATES)


def blocks(text: str | None, block_words: int = BLOCK_WORDS, step: int = LONGEST) -> list[list[bytes]]:
    """The blocks of a text, each a list of words: lines, of which windows overlap by half, then
    windows of 3 * `step` words over the whole text, which overlap by two thirds."""
    out, whole, starts = [], [], []
    for line in (text or "").split("\n"):
        w = words(line)
        if w:
            starts.append(len(whole))
            whole += w
        if len(w) <= block_words:
            if w:
                out.append(w)
        else:
            half = block_words // 2
            out += [w[i : i + block_words] for i in range(0, max(1, len(w) - half), half)]
    step = max(1, step)
    for i in range(0, max(1, len(whole) - 2 * step) if whole else 0, step):
        last = min(i + 3 * step, len(whole))
        line = bisect_right(starts, i)
        end = starts[line] if line < len(starts) else len(whole)
        if last > end or end - starts[line - 1] > block_words:
            out.append(whole[i:last])
    return out


class TemplateIndex:
    """The templates under a global order of words, with an inverted index of their prefixes."""

    def __init__(self, templates: dict[str, str], frequency: dict[bytes, int], threshold: float):
        rank = lambda w: (frequency.get(w, 0), w)
        self.index: dict[bytes, list[tuple[str, int, int, frozenset]]] = defaultdict(list)
        for label, text in templates.items():
            tokens = sorted(set(words(text)), key=rank)
            need = max(1, -(-len(tokens) * round(threshold * 1000) // 1000))
            for at, w in enumerate(tokens[: len(tokens) - need + 1]):
                self.index[w].append((label, at, need, frozenset(tokens)))
        self.keys = frozenset(self.index)

    def matches(self, block: set[bytes]) -> dict[str, float]:
        """Label to containment of every template that the block holds."""
        first: dict[str, tuple] = {}
        for w in self.keys & block:
            for entry in self.index[w]:
                if entry[0] not in first or entry[1] < first[entry[0]][1]:
                    first[entry[0]] = entry
        out: dict[str, float] = {}
        for label, at, need, tokens in first.values():
            if len(block) >= need and len(tokens) - at >= need and (common := len(tokens & block)) >= need:
                out[label] = common / len(tokens)
        return out


def find_phrases(w: list[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words stand consecutively."""
    out = []
    for phrase, label in phrases:
        at = -1
        if phrase[0] in w:
            while True:
                try:
                    at = w.index(phrase[0], at + 1)
                except ValueError:
                    break
                if w[at : at + len(phrase)] == phrase:
                    out.append((at, label))
    return out


def template_frequencies(documents: DataFrame, templates: dict[str, str], text: str = "text") -> dict[bytes, int]:
    """In how many documents each word of the templates occurs. The result has a row for each such word."""
    wanted = frozenset(w for t in templates.values() for w in words(t))

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for body in batch.column(0).to_pylist():
                counts.update(wanted.intersection(words(body)))
        yield pa.RecordBatch.from_arrays([pa.array([k.decode() for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    rows = documents.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word.encode(): r.n for r in rows.collect()}


def scan_licenses(
    documents: DataFrame,
    templates: dict[str, str] | None = None,
    phrases: dict[str, str] | None = None,
    threshold: float = 0.9,
    block_words: int = BLOCK_WORDS,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row a document: key, n_words, places (word, label of each phrase found), matches (block,
    label, containment of each template found). Templates and phrases are parameters held in memory,
    so what is sent to the executors doesn't grow with the documents."""
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    frequency = template_frequencies(documents, templates, text)
    step = longest(templates)
    runs = [(words(k), v) for k, v in phrases.items()]

    def make():
        index = TemplateIndex(templates, frequency, threshold)
        need = index.keys

        def work(keys, texts):
            out: dict[str, list] = {"key": keys, "n_words": [], "places": [], "matches": []}
            for body in texts:
                w = words(body)
                out["n_words"].append(len(w))
                out["places"].append([{"word": a, "label": b} for a, b in sorted(find_phrases(w, runs))])
                found = []
                if not need.isdisjoint(w):
                    for i, block in enumerate(blocks(body, block_words, step)):
                        for label, share in sorted(index.matches(set(block)).items()):
                            found.append({"block": i, "label": label, "containment": share})
                out["matches"].append(found)
            return out

        return work

    kind = dict(documents.dtypes)[key]
    schema = f"key {kind}, n_words long, places array<struct<word:long,label:string>>, matches array<struct<block:long,label:string,containment:double>>"
    return arrow_rows(two_columns(documents, key, text), make, schema)
