"""Order MinHash sketches and the banded alignment that verifies candidates, on arrays of one or two texts."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np

SHINGLE, SAMPLE, TABLES, SIMILARITY = 5, 4, 24, 0.8
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(word: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of `size` words; a shorter text is one run."""
    word = word.astype(np.uint64)
    if len(word) < size:
        size = len(word)
    n = len(word) - size + 1
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = mixed(h * GOLDEN + word[k : k + n])
    return h


def labelled(h: np.ndarray) -> np.ndarray:
    """Shingles with the number of their occurrence, so that repeated ones differ."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    nth = np.arange(len(s)) - np.repeat(starts, np.diff(np.append(starts, len(s))))
    out = np.empty_like(h)
    out[order] = mixed(s + nth.astype(np.uint64) * GOLDEN)
    return out


def sketch(word: np.ndarray, tables: int = TABLES, sample: int = SAMPLE, size: int = SHINGLE) -> np.ndarray:
    """For each table a hash of the `sample` smallest labelled shingles in the order of the text."""
    x = labelled(shingles(word, size))
    rng = np.random.default_rng(20)
    factors = rng.integers(1, 2**63, tables, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty(tables, np.uint64)
    step = max(1, 2_000_000 // len(x))
    for a in range(0, tables, step):
        f = factors[a : a + step]
        v = x[None, :] * f[:, None]
        at = np.sort(np.argpartition(v, sample - 1, axis=1)[:, :sample], axis=1) if len(x) > sample else np.tile(np.arange(len(x)), (len(f), 1))
        key = f + np.uint64(a)
        for k in range(at.shape[1]):
            key = mixed(key * GOLDEN + x[at[:, k]])
        out[a : a + step] = key
    return out


def distance_within(a: list, b: list, most: int) -> int | None:
    """Insertions and deletions that turn one sequence into the other, or None beyond `most`: furthest
    reaching paths on the band of diagonals that is still open."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    reach = {1: 0}
    for d in range(most + 1):
        for k in range(-d, d + 1, 2):
            if not -m <= k <= n:
                continue
            x = reach.get(k + 1, -1) if k == -d or (k != d and reach.get(k - 1, -1) < reach.get(k + 1, -1)) else reach[k - 1] + 1
            y = x - k
            if x < 0 or y < 0:
                continue
            while x < n and y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            reach[k] = x
            if x >= n and y >= m:
                return d
    return None


def apart(total: int, least: float) -> int:
    """Shingles of two sequences, of `total` together, that may stay unaligned at the similarity `least`."""
    return int(total * (1 - 2 * least / (1 + least)) + 1e-9)


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float | None:
    """Of two sequences of shingles: the aligned over all, if that is at least `least`."""
    total = len(a) + len(b)
    d = distance_within(a.tolist(), b.tolist(), apart(total, least))
    return None if d is None else (total - d) / (total + d)


def near(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether `similarity` is at least `least`, without its value."""
    total = len(a) + len(b)
    most = apart(total, least)
    if abs(len(a) - len(b)) > most:
        return False
    if total - 2 * len(np.intersect1d(labelled(a), labelled(b), assume_unique=True)) > most:
        return False  # even out of order they have too little in common
    return aligns(a, b, most)


def aligns(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether an alignment leaves at most `most` shingles of both unaligned. Equal ends align. Between them
    a chain of shingles that occur equally often in both, on the band of diagonals that `most` leaves open,
    is an alignment; if it isn't good enough, the best one on that band decides."""
    short = min(len(a), len(b))
    differs = np.flatnonzero(a[:short] != b[:short])
    head = int(differs[0]) if len(differs) else short
    ra, rb = a[head:][::-1], b[head:][::-1]
    short = min(len(ra), len(rb))
    differs = np.flatnonzero(ra[:short] != rb[:short])
    tail = int(differs[0]) if len(differs) else short
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(a) + len(b) <= most:
        return True
    _, i, j = np.intersect1d(labelled(a), labelled(b), assume_unique=True, return_indices=True)
    close = np.abs(i - j) <= most
    i, j = i[close], j[close]
    ends: list[int] = []
    for y in j[np.argsort(i)].tolist():  # the longest rising chain
        at = bisect_left(ends, y)
        if at == len(ends):
            ends.append(y)
        else:
            ends[at] = y
    if len(a) + len(b) - 2 * len(ends) <= most:
        return True
    return distance_within(a.tolist(), b.tolist(), most) is not None


#: Cells of a table of members and shingles that is multiplied at once.
CELLS = 4_000_000


def common_counts(codes: list[np.ndarray]) -> np.ndarray:
    """For each two of some sets of labelled shingles the number of common ones."""
    n = len(codes)
    flat, owner = np.concatenate(codes), np.repeat(np.arange(n), [len(c) for c in codes])
    kind, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    use = shared[code]
    code, owner = number[code[use]], owner[use]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    out, several = np.zeros((n, n)), int(shared.sum())
    width = min(several, max(1, CELLS // n))
    for start in range(0, several, width or 1):
        a, b = np.searchsorted(code, [start, start + width])
        table = np.zeros((n, width), np.float32)
        table[owner[a:b], code[a:b] - start] = 1
        out += table @ table.T
    return out


def links_within(texts: list[np.ndarray], least: float = SIMILARITY, size: int = SHINGLE) -> list[tuple[int, int]]:
    """Links that join those of some texts (word hashes) which near copies join, a spanning forest: all
    pairs are held against the bound by common shingles, and what may reach `least` is aligned, unless
    the two are joined already."""
    own = [shingles(w, size) for w in texts]
    if len(own) == 2:
        return [(0, 1)] if near(*own, least) else []
    common = common_counts([labelled(x) for x in own])
    n = np.array([len(x) for x in own])
    total = n[:, None] + n[None, :]
    spare = np.floor(total * (1 - 2 * least / (1 + least)) + 1e-9) - (total - 2 * common)
    a, b = np.nonzero(np.triu(spare >= 0, 1))
    order = np.argsort(-spare[a, b] / total[a, b], kind="stable")
    up, out = list(range(len(own))), []

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
        x, y = top(i), top(j)
        if x != y and aligns(own[i], own[j], apart(len(own[i]) + len(own[j]), least)):
            up[max(x, y)] = min(x, y)
            out.append((i, j))
    return out
