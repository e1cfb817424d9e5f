"""Operators 6, 7 and 8, and the pipeline."""

import gzip
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalstrata.llm import common
from evalstrata.llm.factorisation import FACTORS, SIZE, Machine, features, fit, score_quality, train
from evalstrata.llm.pii import find_pii, instance_scores, listed, mask_pii, with_spans
from evalstrata.llm.warc import salvage
from evalstrata.llm.web_archives import archived_pages, read_warc, write_warc


@pytest.fixture(scope="module")
def pages(spark):
    page = "<html>" + "x" * 200 + "</html>"
    rows = [(5, "u5", page), (3, "u3", page), (9, "u9\r\nX: y", page), (1, None, "short"), (2, "u2", "short"), (4, "u4", None), (6, "u6", ""), (7, "u7", "WARC/1.1\r\n\r\n" + "é" * 90), (8, "u8", "other" * 40), (8, "u8", "other" * 40)]
    return spark.createDataFrame([(*r, "response", 1) for r in rows], "page_id long, url string, html string, record_type string, payload_bytes int")


def test_archives_round_trip(pages):
    rows = {}
    for r in archived_pages(pages).collect():
        rows.setdefault(int(r.page_id), []).append(r)
    for p in pages.collect():
        raw = (p.html or "").encode()
        for r in rows[p.page_id]:
            assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert {k: [r.record_type for r in v] for k, v in rows.items()} == {5: ["revisit"], 3: ["response"], 9: ["revisit"], 1: ["response"], 2: ["response"], 4: ["response"], 6: ["response"], 7: ["response"], 8: ["response"] * 2}
    assert rows[5][0].refers_to == rows[9][0].refers_to == "3"
    assert archived_pages(pages.limit(0)).count() == 0


def test_one_page_id_with_two_payloads(spark, tmp_path, monkeypatch):
    """Each revisit comes back with the payload it refers to, and archives stay below their bytes."""
    a, b = "a" * 200, "b" * 300
    rows = [(1, "u", a), (1, "u", b), (2, "u", a), (3, "u", b), (None, "u", a)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    for few in (0, 10**5):
        monkeypatch.setattr(common, "SENT", few)
        got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or "") for r in archived_pages(pages).collect())
        digest = {t: hashlib.sha256(t.encode()).hexdigest() for t in (a, b)}
        want = [("", 200, digest[a], "revisit", "1"), ("1", 200, digest[a], "response", ""), ("1", 300, digest[b], "response", ""), ("2", 200, digest[a], "revisit", "1"), ("3", 300, digest[b], "revisit", "1")]
        assert got == want
    write_warc(pages, str(tmp_path / "w"), file_bytes=10_000)
    assert len(list((tmp_path / "w").glob("part-*"))) == 3


def record(k: int, body: bytes) -> bytes:
    digest = hashlib.sha256(body).hexdigest().encode()
    return b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Block-Digest: sha256:%s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (k, digest, len(body), body)


@pytest.mark.parametrize("wrap", [bytes, gzip.compress])
def test_salvage_recovers_all_whole_records(wrap):
    rng = random.Random(4)
    for _ in range(60):
        parts = [wrap(record(k, bytes(rng.randrange(256) for _ in range(rng.randrange(300))))) for k in range(8)]
        starts = np.cumsum([0, *map(len, parts)])
        data = bytearray(b"".join(parts))
        hurt = set()
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(data))
            data[at] ^= 1 + rng.randrange(255)
            hurt.add(int(np.searchsorted(starts, at, "right")) - 1)
        cut = rng.choice([0, 0, 5])
        if cut:
            del data[-cut:]
            hurt.add(7)
        found = list(salvage(bytes(data)))
        assert b"".join(bytes(data)[a:b] for _, a, b, *_ in found) == bytes(data)
        good = {int(x[3]["warc-record-id"][10:-1]) for x in found if x[0] == "record" and x[3].get("warc-record-id", "").startswith("<urn:page:") and x[3]["warc-record-id"][10:-1].isdigit()}
        assert set(range(8)) - hurt <= good
        if not hurt:
            assert all(x[0] == "record" for x in found)
    assert list(salvage(b"")) == []
    assert [x[0] for x in salvage(b"junk")] == ["gap"]


def test_gaps_are_logged(spark, pages, tmp_path):
    write_warc(pages.coalesce(1), str(tmp_path / "w"))
    file = next((tmp_path / "w").glob("part-*"))
    (tmp_path / "w" / f".{file.name}.crc").unlink(missing_ok=True)
    data = file.read_bytes()
    at = data.index(b"WARC/1.1", 400)
    file.write_bytes(data[: at + 3] + b"?" + data[at + 4 :])
    rows = read_warc(spark, str(tmp_path / "w"))
    assert rows.filter("gap is not null").count() == 1
    assert rows.filter("gap is null").count() == pages.count() - 1


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind: str, v: str) -> bool:
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        s = sum(int(c) * (1 + k % 2) - 9 * (int(c) * (1 + k % 2) > 9) for k, c in enumerate(reversed(d)))
        return 16 <= len(d) <= 19 and s % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def plain(t) -> str:
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k in BASE for m in re.finditer(BASE[k], t or "") if good(k, m[0]))


def test_base_spans(spark, documents, none, texts):
    rng = random.Random(3)
    parts = ["1", "23", ".", "@", "a", "b-", "+", "(", ")", " ", "-", "é", "😀", "4539", "+1 (555) 555-1234", "a.b@c.de", "10.0.0.1", "4539578763621486", "4539 5787-6362 1486", "_", "%"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(800)]
    made += [*texts, "1.2.3.4.5.6.7.8", "a@b.c_d@e.f", "a@b.c.@d.e", "1 " * 3000, "00000255.0.0.1 256.1.1.1 1.1.1.300.4.4.4", "a" * 5000 + "@"]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3)
    for r in find_pii(df).select("key", listed(F.col("pii_base")).alias("b"), listed(F.col("pii")).alias("a")).collect():
        assert r.b == plain(made[r.key]), made[r.key]
        assert set(filter(None, r.b.split(","))) <= set(filter(None, r.a.split(",")))
    assert find_pii(documents).count() == len(texts) + 1
    assert find_pii(none).count() == 0


def test_bootstrap_finds_identifiers_by_their_context(spark):
    rows = [f"member card 45395787636214{n:02d} issued" for n in range(100)]
    rows = [r for r in rows if plain(r)][:9] + ["member card AB12-99-7731-XZ issued", "weight 12345678 grams here", "sold 23456789 grams there"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.key: r.a for r in find_pii(df).select("key", listed(F.col("pii")).alias("a")).collect()}
    assert got[9] == "id:12:27"
    assert got[10] == got[11] == ""
    found = with_spans(df.select("doc_id", "text"))
    assert found.count() == len(rows)
    assert instance_scores(spark.createDataFrame([], "value string, left string, lead string, right string, start double")).count() == 0


def test_scores_equal_a_plain_computation(spark):
    rng = random.Random(8)
    rows = [(f"v{rng.randrange(25)}", rng.choice("abc"), rng.choice("ab") + " = ", rng.choice(["", "x", "y"]), rng.choice([0.0, 0.0, 0.5, 1.0])) for _ in range(60)]
    edges, start = set(), {}
    for v, left, lead, right, s in rows:
        start[v] = max(start.get(v, 0), s)
        edges |= {(("left", left), v), (("lead", lead), v)} | ({(("right", right), v), (("both", left, right), v)} if right else set())
    score = dict(start)
    for _ in range(6):
        good = {p: [score[v] for q, v in edges if q == p] for p in {p for p, _ in edges}}
        sure = {p: sum(x) / (len(x) + 2) for p, x in good.items() if sum(x) >= 3}
        fresh = {}
        for v in score:
            rest = 1.0
            for p, w in edges:
                if w == v and p in sure:
                    rest *= 1 - sure[p]
            fresh[v] = max(start[v], 1 - rest)
        change = max(abs(fresh[v] - score[v]) for v in score)
        score = fresh
        if change < 0.01:
            break
    got = {r.value: r.score for r in instance_scores(spark.createDataFrame(rows, "value string, left string, lead string, right string, start double")).collect()}
    assert got == pytest.approx(score, abs=1e-9)


def test_recall_and_precision_on_planted_secrets(spark):
    """Of the secrets planted in the tables nearly all are found, and beside them only numbers like those of cards."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    wanted, found = set(), set()
    for r in find_pii(docs).filter("size(pii) > 0").join(docs.withColumnRenamed("doc_id", "key"), "key").select("key", "text", F.slice("pii", 1, F.size("pii")).alias("pii")).collect():
        found |= {(r.key, s["first"]) for s in r.pii if s["kind"] == 4 and not re.fullmatch("[0-9]{16}", r.text[s["first"] : s["last"]])}
    for r in docs.collect():
        wanted |= {(r.doc_id, m.start(1)) for m in re.finditer('(?i)token = "([0-9a-f]{40})"', r.text or "")}
    assert len(wanted) > 100
    assert len(wanted & found) >= 0.9 * len(wanted)
    assert len(wanted & found) >= 0.9 * len(found)


def test_many_matches_in_one_text(spark):
    text = "é " + " ".join(f"10.0.{k // 200}.{k % 200} a{k}@b.cd" for k in range(1500))
    row = find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(listed(F.col("pii_base")).alias("b")).first()
    assert row.b == plain(text)


def test_masking(spark):
    rows = [(1, "é mail a.b@c.de, 10.0.0.1 x", 2), (2, None, 3), (3, "", 4), (4, "+1 (555) 555-1234 or 4539 5787-6362 1486", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii int")
    got = {r.doc_id: r for r in mask_pii(df).collect()}
    assert got[1].text == "é mail [EMAIL], [IP] x" and got[1].pii == 2
    assert got[2].text is None and got[3].text == ""
    assert got[4].text == "[PHONE] or [CARD]" and mask_pii(df).columns == df.columns


def test_linear_time_equals_all_pairs():
    rng = np.random.default_rng(1)
    m = Machine(0.3, rng.normal(size=SIZE).astype(np.float32), rng.normal(size=(SIZE, FACTORS)).astype(np.float32))
    i, x = features("Some words, some MORE words 12.\nAnd a line", 5)
    pairs = sum(float(m.factors[i[a]] @ m.factors[i[b]]) * x[a] * x[b] for a in range(len(i)) for b in range(a + 1, len(i)))
    assert m.logit(i, x) == pytest.approx(m.bias + float(m.linear[i] @ x) + pairs, rel=1e-3)


def test_fit_needs_both_classes():
    assert fit([], np.array([])).score("x") == pytest.approx(0.5)
    assert fit([features("a"), features("b")], np.array([1, 1])).score("x") > 0.9


def test_quality(spark, documents, none):
    rng = random.Random(2)
    rows = []
    for k in range(400):
        w = [rng.choice("alpha beta gamma delta one two".split()) for _ in range(40)]
        rows.append((k, " ".join(w) if k % 4 else "".join(x.upper() + "!! " for x in w), k % 7))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 != 0).cast("int").alias("quality"))
    machine = train(docs, labels)
    out = score_quality(docs, machine, column="q").filter("crc32(cast(doc_id as string)) % 5 = 0")
    right = out.filter("(q >= 0.3) = (doc_id % 4 <> 0)").count()
    assert right >= 0.95 * out.count() > 0
    assert score_quality(documents, machine, column="q").filter("q is null or q < 0 or q > 1").count() == 0
    assert score_quality(none, machine, column="q").count() == 0
    assert train(docs.limit(0), labels.limit(0)).score(None) == pytest.approx(0.5)


def test_pipeline_stages(spark, documents, none):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    bench = p.table(spark, sf, "benchmark").first().text
    extra = spark.createDataFrame([(900, "Clean opening. " + bench + " and an end.", "en", "s", 9), (901, None, "en", "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = p.table(spark, sf, "documents").unionByName(extra)
    kept = docs
    for name, stage in p.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, sf)
        assert kept.columns == docs.columns, name
        assert kept.join(before, "doc_id", "left_anti").count() == 0
    assert kept.filter("doc_id = 900").count() == 0
    out = p.STAGES[-1][1](spark, kept, sf)
    assert out.count() == kept.count()
    for _, stage in p.STAGES:
        assert stage(spark, documents.limit(0), sf).count() == 0
