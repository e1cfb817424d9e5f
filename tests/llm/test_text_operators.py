"""Operators 1, 2, 3, 5, 9 and 10 against plain computations."""

import collections
import math
import random
import re

import pytest

from evalstrata.llm.avi import bit_by_bit, decode_frames, parse_jpeg, read_avi, shots, store, undo
from evalstrata.llm.backoff import score_documents
from evalstrata.llm.common import here
from evalstrata.llm.decontamination import find_contamination
from evalstrata.llm.license_scan import TEMPLATES, PHRASES, blocks, scan_licenses
from evalstrata.llm.media import clip_rows, media_clips, padded, read_back
from evalstrata.llm.piece_codec import encode_pieces
from evalstrata.llm.sentencepieces import CharsMap, encoder
from evalstrata.llm.token_counts import count_tokens

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_decontamination(spark, documents, texts, none, as_map):
    rng = random.Random(5)
    w = plain_words(texts[40])
    items = [(1, " ".join(w[3:16])), (2, "the of"), (3, None), (4, ""), (None, " ".join(w[5:9])), (10, "The OF!"), (5, "zzz yyy"), (1, " ".join(w[3:16]))]
    items += [(20 + k, " ".join(rng.choice(["the", "of", "and"]) for _ in range(11))) for k in range(5)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (200_000, 4):  # one block, and many
        got = as_map(find_contamination(documents, bench, block_windows=block))
        for i, t in enumerate(texts):
            own, hit, ids = plain_words(t), set(), set()
            for item, body in items:
                b = plain_words(body)
                for k in range(max(1, len(b) - 9) if b else 0):
                    win = b[k : k + 10]
                    for a in range(len(own) - len(win) + 1):
                        if own[a : a + len(win)] == win:
                            hit.update(range(a, a + len(win)))
                            ids |= {str(item)} - {"None"}
            r = got[i]
            assert r.n_words == len(own)
            assert {x for s in r.spans for x in range(s.first, s.last + 1)} == hit
            assert r.item_ids == sorted(ids)
        assert None in got
    assert find_contamination(none, bench).count() == 0
    assert find_contamination(documents, bench.limit(0)).filter("size(spans) > 0").count() == 0


def test_sentencepiece(documents, texts, none, as_map):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=here("piece_bpe_32k.model"))
    got = as_map(encode_pieces(documents))
    for i, t in enumerate(texts):
        ids = sp.encode(t or "") + [sp.eos_id()]
        r = got[i]
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), sp.decode(ids))
        raw = (t or "").encode()
        assert len(r.starts) == len(r.ends) == len(ids) - 1
        if ids[:-1]:
            assert r.starts[0] == 0 and r.ends[-1] == len(raw)
            assert all(a <= b for a, b in zip(r.starts, r.ends)) and r.starts[1:] == r.ends[:-1]
    assert encode_pieces(none).count() == 0


def test_pieces_against_the_library_on_random_texts():
    import sentencepiece

    path = here("piece_bpe_32k.model")
    sp, own, rng = sentencepiece.SentencePieceProcessor(model_file=path), encoder(path), random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choice("ab cthe.,\n▁é漢😀01</s><0x41>") for _ in range(rng.randrange(50)))
        parts = own.parts(t)
        assert own.ids(parts) == sp.encode(t)
        assert own.model.decode(own.ids(parts)) == sp.decode(sp.encode(t))


def darts(entries: dict[bytes, bytes]) -> bytes:
    """A compiled character map, built the simple way: each node's children go to a free stretch."""
    import struct

    strings, units, used = b"", {0: 0}, {0}
    trie: dict = {}
    for k, v in entries.items():
        node = trie
        for c in k:
            node = node.setdefault(c, {})
        node[-1] = len(strings)
        strings += v + b"\0"

    def place(at, node):
        offset = 1
        while any((at ^ offset ^ max(c, 0)) in used for c in node):
            offset += 1
        units[at] |= offset << 10 | (0x100 if -1 in node else 0)
        for c in node:
            used.add(at ^ offset ^ max(c, 0))
        for c, child in node.items():
            spot = at ^ offset ^ max(c, 0)
            if c == -1:
                units[spot] = 0x80000000 | child
            else:
                units[spot] = c
        for c, child in node.items():
            if c != -1:
                place(at ^ offset ^ c, child)

    place(0, trie)
    size = max(units) + 1
    table = struct.pack(f"<{size}I", *(units.get(i, 0) for i in range(size)))
    return struct.pack("<I", len(table)) + table + strings


def test_character_map_takes_the_longest_key_and_keeps_offsets():
    entries = {"ａ".encode(): b"a", "ａｂ".encode(): b"AB", "ﬁ".encode(): b"fi", b"\t": b" "}
    m = CharsMap(darts(entries))
    assert m.longest("ａｂc".encode(), 0) == (6, b"AB")
    assert m.longest("ａx".encode(), 0) == (3, b"a")
    assert m.longest(b"x", 0) is None
    own = encoder.__wrapped__(here("piece_bpe_32k.model"))
    model = type(own.model).__new__(type(own.model))
    model.__dict__ |= own.model.__dict__ | {"charsmap": m, "plain": False}
    out, source = model.normalise("xﬁ\tａｂ")
    assert out.decode() == "▁xfi▁AB"
    assert source == [0, 0, 0, 0, 1, 1, 4, 4, 4, 5, 5, 11]
    model.squeeze = True
    assert model.normalise("  a  b ")[0].decode() == "▁a▁b"


def test_token_counts(documents, texts, none, as_map):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(here("byte_bpe_50k.json"))
    for head in (150_000, 20):  # the second leaves most to the shuffle
        got = as_map(count_tokens(documents, head=head))
        for i, x in enumerate(texts):
            assert got[i].n_tokens == len(t.encode(x or "", add_special_tokens=False).ids), x and x[:50]
            assert got[i].n_bytes == len((x or "").encode())
    assert count_tokens(none).count() == 0


def test_pretoken_classes_agree_with_the_library():
    import regex
    from tokenizers import Tokenizer

    from evalstrata.llm.token_counts import ALIKE, PreTokens

    path = here("byte_bpe_50k.json")
    own, lib = PreTokens(path, ()), Tokenizer.from_file(path).pre_tokenizer
    alike = regex.compile(ALIKE)
    for cp in [*range(0x600), *range(0x3000, 0x3100), *range(0x4DF0, 0x4E10), *range(0x9FF0, 0xA000), *range(0xABF0, 0xAC10), *range(0xD790, 0xD800)]:
        s = f"a{chr(cp)}1{chr(cp)}! {chr(cp)}"
        if alike.fullmatch(s):
            assert own.cut(s) == [s[a:b] for _, (a, b) in lib.pre_tokenize_str(s)], hex(cp)


def test_license_scan(spark, documents, none, as_map):
    rows = [
        (1, "Some text.\nReleased under the MIT License.\nMore"),
        (2, "CC BY and cc-by, then ALL rights\nreserved"),
        (3, None),
        (4, ""),
        (5, "general public license general public license"),
        (6, ("filler " * 400) + "licensed under the apache license, version 2.0 " + ("filler " * 400)),
        (7, "released under the license"),
        (5, "general public license"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = scan_licenses(docs).collect()
    got = {r.key: r for r in found}
    labels = lambda r: {m.label for m in r.matches}
    assert labels(got[1]) == {"mit"} and got[1].places == []
    assert [p.label for p in got[2].places] == ["cc-by", "cc-by", "reserved"]
    assert got[3].n_words == 0 and got[4].matches == []
    assert sorted(len(r.places) for r in found if r.key == 5) == [1, 2]
    assert labels(got[6]) == {"apache-2.0"} and labels(got[7]) == set()
    # the join against all blocks and templates
    out = as_map(scan_licenses(documents, threshold=0.5, block_words=8, templates=TEMPLATES | {"made": "the of and erth onla"}))
    for r in documents.collect():
        want = set()
        for k, b in enumerate(blocks(r.text, 8)):
            for label, t in (TEMPLATES | {"made": "the of and erth onla"}).items():
                need = {w.encode() for w in plain_words(t)}
                share = len(need & set(b)) / len(need)
                if len(need & set(b)) >= math.ceil(len(need) * 0.5):
                    want.add((k, label, round(share, 9)))
        assert {(m.block, m.label, round(m.containment, 9)) for m in out[r.doc_id].matches} == want
    assert scan_licenses(none).count() == 0
    assert set(PHRASES.values()) == {"cc-by", "gpl", "reserved"}


def test_license_notices_over_lines(spark):
    """Every template wrapped at every place, with words before and after."""
    rows = []
    for label in ("mit-notice", "bsd", "apache-2.0-notice"):
        w = TEMPLATES[label].split()
        rows += [(label, "before\n" * before + " ".join(w[:k]) + "\n# " + " ".join(w[k:]) + "\nafter" * 70) for k in range(3, len(w) - 2) for before in (0, 50)]
    rows += [("long", "one two\n" * 100 + " ".join(f"t{k}" for k in range(300)).replace("t150", "t150\n") + "\nend")]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, label string, text string")
    long = TEMPLATES | {"long": " ".join(f"t{k}" for k in range(300))}
    for r in scan_licenses(docs.coalesce(1), templates=long).collect():
        assert rows[r.key][0] in {m.label for m in r.matches}, rows[r.key]
    for r in scan_licenses(docs.filter("label <> 'long'").coalesce(1)).collect():
        assert {m.label for m in r.matches} == {rows[r.key][0]}, rows[r.key]


def test_media_round_trip(documents, texts, none, as_map):
    import hashlib
    import zlib

    got = as_map(media_clips(documents, with_media=True))
    for i, t in enumerate(texts):
        raw, n = padded(t)
        r = got[i]
        assert len(raw) % 64 == 0 and len(raw) > 0
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
        assert r.media_bytes == len(r.media) and read_back(bytes(r.media))[0] == raw
        assert r.clips[0].start_ms == 0
    assert clip_rows(media_clips(documents)).filter("end_ms <= start_ms").count() == 0
    assert media_clips(none).count() == 0


def test_frames_bit_by_bit_and_without_index():
    import numpy as np

    data = bytes(range(256)) * 20
    film = store(data)
    frames = read_avi(film)["frames"]
    slow = np.stack([undo(bit_by_bit(p := parse_jpeg(f)).reshape(1, p["height"], p["width"]), p["predictor"])[0] for f in frames])
    assert (slow == decode_frames(frames)).all()
    cut = film[: film.rindex(b"idx1")]
    assert read_avi(cut)["frames"] == frames
    for predictor in range(2, 8):
        d = np.zeros((1, 4, 8), np.int64)
        assert (undo(d, predictor) == 128).all()


def test_shots():
    import numpy as np

    dark, light = np.zeros((10, 4, 8), np.uint8), np.full((10, 4, 8), 255, np.uint8)
    assert shots(np.concatenate([dark, light])) == [(0, 10), (10, 20)]
    assert shots(dark) == [(0, 10)]


def test_damaged_and_foreign_films():
    import struct

    from evalstrata.llm.avi import read_avi, store
    from evalstrata.llm.media import read_back

    payload = bytes(range(256)) * 20
    film = store(payload)
    assert read_back(film)[0] == payload
    for end in range(12, len(film), 97):  # whole frames of what is left, in order
        back, _ = read_back(film[:end])
        assert payload.startswith(back)
    with pytest.raises(ValueError):
        read_back(b"no film")
    movi, at = film.index(b"movi"), film.index(b"idx1") + 8
    moved = bytearray(film)  # offsets from the start of the file
    for k in range(at, len(film) - 15, 16):
        moved[k + 8 : k + 12] = struct.pack("<I", struct.unpack("<I", film[k + 8 : k + 12])[0] + movi)
    assert read_avi(bytes(moved)) == read_avi(film)


@pytest.mark.parametrize("order,chunk", [(2, 500_000), (2, 50), (3, 70)])
def test_backoff(documents, texts, none, as_map, order, chunk):
    got = as_map(score_documents(documents, order=order, chunk_words=chunk, part_grams=400))
    rows = [(r.doc_id, plain_words(r.text)) for r in documents.collect()]
    counts = [collections.Counter(tuple(w[i : i + n]) for _, w in rows for i in range(len(w) - n + 1)) for n in range(1, order + 1)]
    total = sum(len(w) for _, w in rows)
    for i, w in rows:
        if len(w) > 5000:
            continue
        own = [collections.Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) for n in range(1, order + 1)]
        c = lambda g: counts[len(g) - 1][g] - own[len(g) - 1][g]

        def s(context, word):
            if not context:
                return math.log(max(1, c((word,)))) - math.log(max(1, total - len(w)))
            if c((*context, word)) > 0:
                return math.log(c((*context, word))) - math.log(c(context))
            return math.log(0.4) + s(context[1:], word)

        want = sum(s(tuple(w[max(0, k - order + 1) : k]), x) for k, x in enumerate(w))
        assert got[i].n_words == len(w)
        assert got[i].log_score == pytest.approx(want, abs=1e-6)
    assert score_documents(none, order=order).count() == 0
