"""SentencePiece BPE: normalisation that keeps offsets, encoding and decoding.

Normaliser: at each place the longest key of the compiled character map (a double-array trie followed
by its replacement strings) is replaced, or else one character is kept; for every output byte the
place in the source is recorded, so pieces can be projected to byte spans of the original text.

Encoder: adjacent symbols whose union is a piece are merged, the best score first, the leftmost at a
tie; symbols that are no piece fall back to bytes. No piece has a blank behind another character, and
some characters follow a letter in no piece; the text is cut there, which changes no merge, and the
result of each cut is remembered in a table of bounded size.
"""

from __future__ import annotations

import heapq
import re
import struct
from functools import cached_property, lru_cache

BLANK = "▁"
NONE = float("-inf")
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"


class CharsMap:
    """A compiled character map: a double array of 32-bit units, then strings that end in zero."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = struct.unpack(f"<{size // 4}I", blob[4 : 4 + size]) if size else ()
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that starts at `at`, and its replacement."""
        if not self.units:
            return None
        found = None
        node = self._offset(self.units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units) or self.units[node] & 0x800000FF != data[i]:
                break
            unit = self.units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                value = self.units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.strings[value : self.strings.index(b"\0", value)])
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


class Model:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback and blanks before words are read")
        if any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("models with user-defined or unused pieces are not read")
        self.charsmap = CharsMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.plain = not self.charsmap.units and not self.squeeze and self.escape
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == 1}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.of_byte = {i: b for b, i in self.bytes.items()}
        self.end = proto.trainer_spec.eos_id
        joined = "\n".join(self.ids)
        if re.search(f"[^{BLANK}\n]{BLANK}", joined) or "\n" in "".join(self.ids):
            self.cut = re.compile(r".+", re.S)
        else:
            after = "".join(c for c in ".,!?;:#$%&*|\n" if not re.search(f"[{LETTERS}]{re.escape(c)}", joined) or c == "\n")
            self.cut = re.compile(f"{BLANK}*[{LETTERS}]+(?=[{re.escape(after)}])|[^{BLANK}\n]*\n+|{BLANK}*[^{BLANK}\n]+|{BLANK}+")

    # -- normalisation ---------------------------------------------------------------------------

    def normalise(self, text: str) -> tuple[bytes, list[int]]:
        """Normalised UTF-8 and, for each of its bytes and its end, the byte of the source it is from."""
        data, at, units = text.encode(), 0, []
        while at < len(data):
            if (hit := self.charsmap.longest(data, at)) is not None:
                size, into = hit
            else:
                size = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                into = data[at : at + size]
            units.append((at, into))
            at += size
        if self.squeeze:  # no blanks at either end, one between words
            kept, blank_before = [], True
            for start, into in units:
                for c in re.findall(rb" |[^ ]+", into):
                    if c != b" " or not blank_before:
                        kept.append((start, c))
                    blank_before = c == b" "
            units = kept[:-1] if kept and kept[-1][1] == b" " else kept
        blank = BLANK.encode() if self.escape else b" "
        out, source = bytearray(), []
        if self.dummy and units:
            out += blank
            source += [units[0][0]] * len(blank)
        for start, into in units:
            into = into.replace(b" ", blank)
            out += into
            source += [start] * len(into)
        return bytes(out), [*source, len(data)]

    # -- merges ----------------------------------------------------------------------------------

    def merges(self, text: str) -> list[str]:
        """The symbols of a text after all merges."""
        score = self.scores.get
        if len(text) <= 64:
            symbols = list(text)
            pairs = [score(a + b, NONE) for a, b in zip(text, text[1:])]
            while pairs and (best := max(pairs)) != NONE:
                at = pairs.index(best)
                made = symbols[at] + symbols[at + 1]
                symbols[at : at + 2] = [made]
                del pairs[at]
                if at:
                    pairs[at - 1] = score(symbols[at - 1] + made, NONE)
                if at < len(pairs):
                    pairs[at] = score(made + symbols[at + 1], NONE)
            return symbols
        n = len(text)
        symbols, left, right = list(text), list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (s := score(symbols[i] + symbols[j])) is not None:
                heapq.heappush(heap, (-s, i, j, symbols[i], symbols[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, a, b = heapq.heappop(heap)
            if symbols[i] != a or symbols[j] != b or right[i] != j:
                continue
            symbols[i], symbols[j] = a + b, ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [s for s in symbols if s]

    def encode_cut(self, cut: str) -> list[int]:
        """Ids of a cut. Of a character that falls back to bytes, each byte is a piece."""
        ids = []
        for symbol in self.merges(cut):
            if (i := self.ids.get(symbol)) is not None:
                ids.append(i)
            else:
                ids += [self.bytes[b] for b in symbol.encode()]
        return ids

    @cached_property
    def sizes(self):
        """For each id the bytes of its piece as normalised, and in the source if every blank is one byte there."""
        import numpy as np

        own = [1 if i in self.of_byte else len(p.encode()) for i, p in enumerate(self.pieces)]
        return np.array(own, "<i4"), np.array([n - 2 * p.count(BLANK) for n, p in zip(own, self.pieces, strict=True)], "<i4")

    def surface(self, ids: list[int]) -> bytes:
        """The bytes that ids stand for, blanks put back, control pieces left out."""
        out = []
        for i in ids:
            if (b := self.of_byte.get(i)) is not None:
                out.append(bytes([b]))
            elif self.kinds[i] == 2:
                out.append(" ⁇ ".encode())
            elif self.kinds[i] != 3:
                out.append(self.pieces[i].replace(BLANK, " ").encode())
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        return self.unprefixed(self.surface(ids))

    def unprefixed(self, surface: bytes) -> str:
        if self.dummy and surface.startswith(b" "):
            surface = surface.lstrip(b" ") if self.squeeze else surface[1:]
        return surface.decode("utf-8", "replace")


#: Longer cuts are rarely met again and aren't remembered, so that a remembered one has few bytes.
LONG = 128
#: Characters of a text that are cut at once, at least.
STRETCH = 1 << 16


class Encoder:
    """Encodes texts with a bounded memory of cuts, the recent ones in two generations. Results are lists of
    parts; a part is (number of ids, ids as text, surface, source bytes of each piece if every blank is one source
    byte)."""

    def __init__(self, path: str, memory: int = 120_000):
        self.model = load(path)
        self.memory = memory
        self.seen: dict[str, tuple] = {}
        self.before: dict[str, tuple] = {}

    def part(self, cut: str) -> tuple:
        made = self.before.get(cut)
        if made is None:
            ids = self.model.encode_cut(cut)
            made = (len(ids), " ".join(map(str, ids)).encode(), self.model.surface(ids), self.model.sizes[1][ids].tobytes())
        if len(cut) > LONG:
            return made
        if len(self.seen) >= self.memory:
            self.before, self.seen = self.seen, {}
        self.seen[cut] = made
        return made

    def parts(self, text: str) -> list[tuple]:
        model, seen = self.model, self.seen
        if not text:
            return []
        if model.plain:
            norm = (BLANK if model.dummy else "") + text.replace(" ", BLANK)
        else:
            norm = model.normalise(text)[0].decode("utf-8", "replace")
        out, at = [], 0
        while at < len(norm):
            # no cut goes on beyond a blank behind another character, so a very long text is cut in stretches
            end = at + STRETCH
            while 0 < (end := norm.find(BLANK, end)) and norm[end - 1] == BLANK:
                end += 1
            end = end if end > 0 else len(norm)
            for c in model.cut.findall(norm, at, end):
                if (made := seen.get(c)) is None:
                    made = self.part(c)
                    seen = self.seen
                out.append(made)
            at = end
        return out

    def ids(self, parts: list[tuple]) -> list[int]:
        return [int(i) for p in parts for i in p[1].split()]

    def spans(self, text: str, parts: list[tuple]) -> tuple[list[int], list[int]]:
        """(starts, ends) of the pieces in bytes of the original text. Pieces of one source character
        share its span."""
        import numpy as np

        model = self.model
        if model.plain and BLANK not in text:
            ends = np.cumsum(np.frombuffer(b"".join([p[3] for p in parts]), "<i4"))
            if model.dummy and len(ends):
                ends -= 1
            starts = np.concatenate([np.zeros(1, ends.dtype), ends[:-1]]) if len(ends) else ends
            return starts, ends
        source = np.array(model.normalise(text)[1])
        at = np.concatenate([np.zeros(1, np.int64), np.cumsum(model.sizes[0][self.ids(parts)], dtype=np.int64)])
        return source[at[:-1]], source[at[1:]]


@lru_cache(4)
def load(path: str) -> Model:
    return Model(path)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each worker process, so that what it remembers serves all its tasks."""
    return Encoder(path)
