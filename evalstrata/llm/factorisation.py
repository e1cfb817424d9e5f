"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairs are summed in linear time as
half of (sum_i v_i x_i)^2 - sum_i (v_i x_i)^2. Word counts are damped and scaled to unit length.

The model is fitted on the driver on at most `sample` labelled rows, those with the smallest hash of
their key; everything else covers all rows. Null labels are left out of the fit.

Defined cases: null and empty texts have no words and are scored by the bias and the statistics that
an empty text has. With no labelled rows of either class, the score is the share of class 1 (0.5 with
none). Repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import WORD_BYTES, sliced, small_batches

BUCKETS, FACTORS = 1 << 14, 8
#: Places of the structure statistics and the metadata behind the hashed words.
STATS = 12
SIZE = BUCKETS + STATS


def statistics(text: str, raw: bytes, own: list[bytes], distinct: int, declared: int | None) -> list[float]:
    """Structure statistics of a text, about 0 to 1 each, and its declared length as metadata."""
    n, w = max(1, len(text)), max(1, len(own))
    letters = sum(map(len, own)) or 1
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    marks = len(raw) - len(raw.translate(None, b"!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~"))
    lines = text.split("\n")
    return [
        1.0 if own else 0.0,
        min(1.0, len(own) / 1000),
        distinct / w,
        min(1.0, 4 * upper / letters),
        min(1.0, 10 * digits / n),
        min(1.0, 5 * marks / n),
        min(1.0, 10 * (raw.count(b".") + raw.count(b",")) / w),
        min(1.0, letters / w / 12),
        len(set(lines)) / len(lines),
        min(1.0, len(lines) * 20 / w) if own else 1.0,
        min(1.0, raw.count(b" ") / w),
        min(1.0, float(np.log1p(max(0, declared if declared is not None else len(text)))) / 12),
    ]


def features(text: str | None, declared: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of a whole text."""
    text = text or ""
    raw = text.encode()
    counts = Counter(raw.translate(WORD_BYTES).split())
    sums: Counter = Counter()
    for word, n in counts.items():
        sums[zlib.crc32(word) % BUCKETS] += n
    index = np.fromiter(sums.keys(), np.int32, len(sums))
    value = np.log1p(np.fromiter(sums.values(), np.float32, len(sums)))
    if len(value):
        value /= np.linalg.norm(value)
    stats = statistics(text, raw, list(counts.elements()), len(counts), declared)
    return np.concatenate([index, np.arange(BUCKETS, SIZE, dtype=np.int32)]), np.concatenate([value, np.asarray(stats, np.float32)])


class Machine:
    def __init__(self, bias: float, linear: np.ndarray, factors: np.ndarray):
        self.bias, self.linear, self.factors = bias, linear, factors

    def logit(self, index: np.ndarray, value: np.ndarray) -> float:
        vx = self.factors[index] * value[:, None]
        s = vx.sum(axis=0)
        return float(self.bias + self.linear[index] @ value + 0.5 * (s @ s - (vx * vx).sum()))

    def score(self, text: str | None, declared: int | None = None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(*features(text, declared)), -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 6, rate: float = 0.05, decay: float = 1e-5, batch: int = 64, seed: int = 7) -> Machine:
    """Logistic loss, classes weighted alike, Adagrad steps over small batches in a fixed random order."""
    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return Machine(float(np.log(share / (1 - share))), np.zeros(SIZE, np.float32), np.zeros((SIZE, FACTORS), np.float32))
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    rng = np.random.default_rng(seed)
    w, v, b = np.zeros(SIZE, np.float32), rng.normal(0, 0.01, (SIZE, FACTORS)).astype(np.float32), 0.0
    gw, gv, gb = np.full(SIZE, 1e-6, np.float32), np.full((SIZE, FACTORS), 1e-6, np.float32), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            index = np.concatenate([rows[i][0] for i in chosen])
            value = np.concatenate([rows[i][1] for i in chosen])
            which = np.repeat(np.arange(len(chosen)), [len(rows[i][0]) for i in chosen])
            starts = np.flatnonzero(np.diff(which, prepend=-1))
            vx = v[index] * value[:, None]
            s = np.add.reduceat(vx, starts, axis=0)
            z = b + np.add.reduceat(w[index] * value, starts) + 0.5 * ((s * s).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), starts))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[chosen]) * weight[chosen] / len(chosen)
            each = g[which] * value
            places, back = np.unique(index, return_inverse=True)
            dw = np.bincount(back, each, len(places)).astype(np.float32) + decay * w[places]
            pull = each[:, None] * (s[which] - vx)
            dv = np.stack([np.bincount(back, pull[:, k], len(places)) for k in range(FACTORS)], axis=1).astype(np.float32) + decay * v[places]
            gw[places] += dw * dw
            gv[places] += dv * dv
            w[places] -= rate * dw / np.sqrt(gw[places])
            v[places] -= rate * dv / np.sqrt(gv[places])
            db = float(g.sum())
            gb += db * db
            b -= rate * db / gb**0.5
    return Machine(b, w, v)


def train(documents: DataFrame, labels: DataFrame, sample: int = 4000, target: str = "quality", key: str = "doc_id", text: str = "text", length: str = "n_chars") -> Machine:
    """Fits on at most `sample` labelled rows outside the held-out fifth (crc32 of the key modulo 5)."""
    has = length in documents.columns
    known = labels.select(F.col(key).alias("k"), F.col(target).cast("int").alias("label")).filter("k is not null and label in (0, 1) and crc32(cast(k as string)) % 5 <> 0")
    chosen = known.orderBy(F.xxhash64("k"), "k", "label").limit(sample)
    chosen = documents.sparkSession.createDataFrame(chosen.collect(), known.schema)  # at most `sample` rows of two numbers
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t"), (F.col(length) if has else F.lit(None)).cast("long").alias("n"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = [features(t, n) for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array([i.tobytes() for i, _ in made], pa.binary()), pa.array([v.tobytes() for _, v in made], pa.binary())], ["k", "label", "i", "v"])

    kind = dict(rows.dtypes)["k"]
    # one row a key, so that repeated documents don't exceed the bound
    found = rows.join(F.broadcast(chosen), "k").select("k", "t", "n", "label").dropDuplicates(["k"])
    got = found.mapInArrow(run, StructType.fromDDL(f"k {kind}, label int, i binary, v binary")).collect()
    got.sort(key=lambda r: r.k)
    return fit([(np.frombuffer(r.i, np.int32), np.frombuffer(r.v, np.float32)) for r in got], np.array([r.label for r in got]))


def score_quality(documents: DataFrame, machine: Machine, column: str = "score", key: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """`documents` with a column of scores behind the others."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(documents.sparkSession)
    own = documents.sparkSession.sparkContext.broadcast((machine.bias, machine.linear, machine.factors))
    target = StructType([*documents.schema.fields, *StructType.fromDDL(f"`{column}` double").fields])
    arrow = to_arrow_schema(target)
    at, n_at = documents.columns.index(text), documents.columns.index(length) if length in documents.columns else None

    def run(batches):
        m = Machine(*own.value)
        for batch in sliced(batches):
            texts = batch.column(at).to_pylist()
            declared = batch.column(n_at).to_pylist() if n_at is not None else [None] * len(texts)
            scores = pa.array([m.score(t, n) for t, n in zip(texts, declared, strict=True)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], schema=arrow)

    return documents.mapInArrow(run, target)
