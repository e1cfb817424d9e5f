import random

import pytest

WORDS = "the of and erth onla tiou Réau schön 漢字 niño x1 42 be-low It's sher lando mire pola tuni garo".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", "\n"]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Null, empty, blank, odd and very long texts, ties and repeats."""
    rng = random.Random(11)
    out = [None, "", "   ", "\n\n", "x", "<|endoftext|> in text", "a@b.c", "▁ odd ▁▁ signs", "\x00\x01", "😀" * 50, "é" * 300]
    out += [sentence(rng, rng.randrange(1, 60)) for _ in range(60)]
    out += [sentence(rng, 20_000), "a" * 30_000, "9" * 20_000]
    return out + out[10:16]


@pytest.fixture(scope="session")
def documents(spark, texts):
    """Columns beyond the needed ones carry the names of results."""
    rows = [(i, t, "en", "src", None if t is None else len(t), 7, "x", None) for i, t in enumerate(texts)]
    rows.append((None, "a row without an id", "en", "src", 3, 7, "x", None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words long, spans string, score double").repartition(3)


@pytest.fixture(scope="session")
def none(documents):
    return documents.limit(0)


@pytest.fixture(scope="session")
def as_map():
    def f(df, key="key"):
        return {r[key]: r for r in df.collect()}

    return f
