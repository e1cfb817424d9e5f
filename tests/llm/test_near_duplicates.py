"""Operator 4 against all pairs, and its parts."""

import random

import numpy as np
import pytest

from evalstrata.llm import common
from evalstrata.llm import near_duplicates as nd
from evalstrata.llm.common import words
from evalstrata.llm.components import components
from evalstrata.llm.near_duplicates import near_duplicates, word_hashes
from evalstrata.llm.order_minhash import apart, common_counts, distance_within, labelled, links_within, mixed, near, shingles, similarity, sketch


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_distance_is_that_of_the_full_table():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
        d = len(a) + len(b) - 2 * lcs(a, b)
        assert distance_within(a, b, 30) == d
        assert distance_within(a, b, d) == d
        if d:
            assert distance_within(a, b, d - 1) is None


def test_labels_tell_occurrences_apart():
    x = labelled(np.array([5, 7, 5, 5], np.uint64))
    assert len(set(x.tolist())) == 4
    assert labelled(np.array([7, 5], np.uint64))[1] == x[0]


def test_sketch_sees_order():
    rng = np.random.default_rng(3)
    w = rng.integers(0, 2**32, 200).astype(np.uint32)
    assert (sketch(w) == sketch(w)).all()
    swapped = np.concatenate([w[100:], w[:100]])
    assert (sketch(w) == sketch(swapped)).mean() < 0.5


def brute(rows):
    own = {i: shingles(word_hashes(words(t))) for i, t in rows if words(t)}
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(own)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (len(own[a]) == len(own[b]) and (own[a] == own[b]).all()) or similarity(own[a], own[b]) is not None:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def test_classes(spark):
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows, n = [], 0
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for group in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 260))]
        if group % 3 == 0:
            base[10:10] = passage  # a passage that documents share doesn't make them copies
        for copy in range(rng.choice([1, 2, 3, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5]) if copy else 0):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "one two"), (n + 3, "one two!"), (n + 4, "..."), (n + 5, rows[0][1].upper())]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, node int, sketch string")
    got = {r.key: r.class_key for r in near_duplicates(docs).collect()}
    assert got == brute(rows)
    sizes = {r.class_key: r.class_size for r in near_duplicates(docs).collect()}
    assert sum(sizes.values()) == len(rows)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_copies_of_copies(spark):
    """A text whose only near copies are neither leaders nor unlinked keeps its link. Of a tree of copies only
    parent and child align, and one table puts many of them in one bucket."""
    rng = random.Random(23)
    vocabulary = [f"w{k}" for k in range(5000)]
    texts = [[rng.choice(vocabulary) for _ in range(150)]]
    while len(texts) < 60:
        w = list(rng.choice(texts))
        for k in range(3):
            w[rng.randrange(k * 50, k * 50 + 50)] = rng.choice(vocabulary)
        texts.append(w)
    rows = [(k, " ".join(w)) for k, w in enumerate(texts)]
    buckets = {}
    for i, t in rows:
        buckets.setdefault(int(sketch(word_hashes(words(t)), 1, 1)[0]), []).append((i, t))
    want = {}
    for own in buckets.values():
        want |= brute(own)
    assert len(set(want.values())) < 60
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.key: r.class_key for r in near_duplicates(docs, tables=1, sample=1).collect()} == want


def test_near_is_the_similarity_without_its_value():
    rng = random.Random(4)
    for _ in range(400):
        a = [rng.randrange(12) for _ in range(rng.randrange(1, 40))]
        b = [rng.randrange(12) if rng.random() < 0.1 else x for x in a] if rng.random() < 0.7 else rng.sample(a, len(a))
        if rng.random() < 0.3:
            b = b[rng.randrange(len(b)) :]
        x, y = (mixed(np.array(v, np.uint64) + np.uint64(1)) for v in (a, b))
        assert near(x, y) == (similarity(x, y) is not None)
        assert near(x, y) == (len(a) + len(b) - 2 * lcs(a, b) <= apart(len(a) + len(b), 0.8))


def test_common_counts_over_parts_of_the_table(monkeypatch):
    from evalstrata.llm import order_minhash

    rng = np.random.default_rng(5)
    sets = [rng.choice(300, rng.integers(1, 90), replace=False).astype(np.uint64) for _ in range(9)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    for cells in (9, 100, 10**6):
        monkeypatch.setattr(order_minhash, "CELLS", cells)
        got = common_counts(sets)
        assert all(got[i, j] == want[i][j] for i in range(9) for j in range(9) if i != j)
    assert links_within([np.arange(30, dtype=np.uint32)] * 3)


def variants(n, changes, rng, length=120):
    """Texts with some words of one text changed, more or fewer, then chains of copies of copies that drift away:
    bridges between groups that have no copy in common."""
    vocabulary = [f"w{k}" for k in range(9000)]
    base = [rng.choice(vocabulary) for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(*changes)):
            w[rng.randrange(length)] = rng.choice(vocabulary)
        out.append(w)
    for start in rng.sample(out, 5):
        w = start
        for _ in range(12):
            w = list(w)
            for _ in range(2):
                w[rng.randrange(length)] = rng.choice(vocabulary)
            out.append(w)
    rng.shuffle(out)
    return [(k, " ".join(w)) for k, w in enumerate(out)]


@pytest.mark.parametrize(("n", "block", "few"), [(300, 16, 0), (300, 10**4, 10**5), (2000, 128, 10**5)])
def test_one_large_group_of_near_copies(spark, monkeypatch, n, block, few):
    """The same classes as all pairs, whether a bucket is settled whole or in blocks, and whether small frames
    are broadcast or shuffled."""
    monkeypatch.setattr(nd, "BLOCK", block)
    monkeypatch.setattr(common, "SENT", few)
    rows = variants(n, (0, 7), random.Random(n))
    own = [labelled(shingles(word_hashes(words(t)))) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    common_n, size = common_counts(own), np.array([len(x) for x in own])
    spare = (1 - 1.6 / 1.8) * (size[:, None] + size[None, :]) + 1e-9 - (size[:, None] + size[None, :] - 2 * common_n)
    for i, j in zip(*np.nonzero(np.triu(spare >= 0, 1)), strict=True):  # words are distinct, so order is kept
        x, y = top(i), top(j)
        up[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.key: r.class_key for r in nd.near_duplicates(docs).collect()}
    want = {i: top(i) for i, _ in rows}
    wrong = sum(got[i] != want[i] for i in want)
    assert len(set(want.values())) > 20
    assert wrong <= 0.002 * n


def test_repeated_and_null_keys(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(3, text), (3, text), (None, text), (9, text + " more")], "doc_id long, text string")
    rows = near_duplicates(docs).collect()
    assert len(rows) == 4 and {r.class_key for r in rows} == {3}


@pytest.mark.parametrize("links", [[], [(1, 2)], [(1, 2), (2, 3), (5, 4), (6, 6)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 50)]])
def test_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.label for r in components(df).collect()}
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    assert set(got) == set(up)
    for a in up:
        for b in up:
            assert (got[a] == got[b]) == (find(a) == find(b))
