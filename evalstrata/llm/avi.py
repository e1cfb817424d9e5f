"""AVI motion-JPEG: bytes as lossless intra frames, the RIFF index, and shots.

A frame is a JPEG of one 8-bit component. The writer uses the lossless process (SOF3, predictor 1)
with a Huffman table whose code for a difference of s bits has 9 - s bits, so that each sample takes
9 bits; such scans are read and written with array operations. Other lossless scans (any Huffman
table, predictors 1 to 7) are read bit by bit.

Shots: the L1 distance of neighbouring frames' 16-bin histograms is held against the mean plus
`factor` standard deviations of the distances in a window around it, and against a floor.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

WIDTH, HEIGHT, RATE = 64, 16, 25
BINS, WINDOW, FACTOR, FLOOR = 16, 9, 1.5, 0.25


def huffman(counts: list[int], symbols: list[int]) -> dict[tuple[int, int], int]:
    """(length, code) to symbol, by the counts of codes of each length."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


#: Symbol s (a difference of s bits, 0 to 8) has a code of 9 - s bits: s = 8 has 1 bit, s = 0 has 9.
COUNTS, SYMBOLS = [1] * 9 + [0] * 7, list(range(8, -1, -1))


@lru_cache(1)
def nine_bits() -> tuple[np.ndarray, np.ndarray]:
    """Difference + 255 to its 9 bits as a number, and the way back."""
    to, back = np.zeros(511, np.uint16), np.full(512, 0, np.int16)
    codes = {s: (length, code) for (length, code), s in huffman(COUNTS, SYMBOLS).items()}
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code = codes[s][1]
        value = (code << s) | (d if d > 0 else d + (1 << s) - 1 if d < 0 else 0)
        to[d + 255], back[value] = value, d
    return to, back


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(64)
def head(width: int, height: int) -> bytes:
    frame = struct.pack(">BHHB", 8, height, width, 1) + bytes([1, 0x11, 0])
    table = bytes([0, *COUNTS, *SYMBOLS])
    return b"\xff\xd8" + segment(0xC4, table) + segment(0xC3, frame) + segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """Frames (n, height, width) of bytes as lossless JPEGs. height * width is a multiple of 8."""
    n, height, width = samples.shape
    x = samples.astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    symbols = nine_bits()[0][d.reshape(n, -1) + 255]
    bits = np.empty((n, symbols.shape[1], 9), np.uint8)
    for k in range(9):
        bits[:, :, k] = (symbols >> (8 - k)) & 1
    packed = np.packbits(bits.reshape(n, -1), axis=1)
    start = head(width, height)
    return [start + row.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for row in packed]


def parse_jpeg(data: bytes) -> dict:
    """Width, height, Huffman table, predictor and entropy-coded bytes of a lossless JPEG frame."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, out = 2, {}
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            counts = list(body[1:17])
            out["counts"], out["symbols"] = counts, list(body[17 : 17 + sum(counts)])
        elif marker == 0xC3:
            precision, out["height"], out["width"], parts = struct.unpack(">BHHB", body[:6])
            if (precision, parts) != (8, 1):
                raise ValueError("only one component of 8 bits is read")
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError(f"frames of type {marker:#x} are not read")
        elif marker == 0xDA:
            out["predictor"] = body[1 + 2 * body[0]]
            end = data.rfind(b"\xff\xd9")
            out["scan"] = data[at : end if end >= at else len(data)].replace(b"\xff\x00", b"\xff")
            return out
    raise ValueError("a scan is missing")


def bit_by_bit(frame: dict) -> np.ndarray:
    """The differences of a scan with any Huffman table."""
    table, value, length = huffman(frame["counts"], frame["symbols"]), 0, 0
    bits = iter(np.unpackbits(np.frombuffer(frame["scan"], np.uint8)).tolist())
    out = np.zeros(frame["height"] * frame["width"], np.int64)
    for k in range(len(out)):
        value = length = 0
        while (length, value) not in table:
            value, length = value << 1 | next(bits), length + 1
        s, x = table[length, value], 0
        for _ in range(s):
            x = x << 1 | next(bits)
        out[k] = 0 if not s else x if x >> (s - 1) else x - (1 << s) + 1
    return out


def undo(d: np.ndarray, predictor: int) -> np.ndarray:
    """Differences (n, height, width) to samples."""
    if predictor == 1:
        d = d.astype(np.int32)
        d[:, 0, 0] += 128
        d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
        return np.cumsum(d, axis=2).astype(np.uint8)
    out = np.zeros(d.shape, np.int64)
    for f, y, x in np.ndindex(d.shape):
        a = int(out[f, y, x - 1]) if x else None
        b = int(out[f, y - 1, x]) if y else None
        if a is None or b is None:
            p = a if a is not None else b if b is not None else 128
        else:
            c = int(out[f, y - 1, x - 1])
            p = {2: b, 3: c, 4: a + b - c, 5: a + (b - c) // 2, 6: b + (a - c) // 2, 7: (a + b) // 2}[predictor]
        out[f, y, x] = (p + d[f, y, x]) & 0xFFFF
    return out.astype(np.uint8)


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """Intra frames of one size as (n, height, width) bytes; of no frames an array of none."""
    if not frames:
        return np.zeros((0, 0, 0), np.uint8)
    width, height = size_of(frames[0])
    own = head(width, height)
    if all(f.startswith(own) for f in frames):
        bare = [f[len(own) : -2].replace(b"\xff\x00", b"\xff") for f in frames]
        if {*map(len, bare)} == {9 * width * height // 8}:
            bits = np.unpackbits(np.frombuffer(b"".join(bare), np.uint8)).reshape(-1, 9)
            value = np.zeros(len(bits), np.uint16)
            for k in range(9):
                value = value << 1 | bits[:, k]
            return undo(nine_bits()[1][value].reshape(len(frames), height, width), 1)
    out = []
    for f in frames:
        parsed = parse_jpeg(f)
        out.append(undo(bit_by_bit(parsed).reshape(1, parsed["height"], parsed["width"]), parsed["predictor"])[0])
    return np.stack(out)


def size_of(frame: bytes) -> tuple[int, int]:
    parsed = parse_jpeg(frame)
    return parsed["width"], parsed["height"]


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], width: int, height: int, n_bytes: int, rate: int = RATE) -> bytes:
    """A RIFF AVI file with the frames as stream 00dc and their index. n_bytes is kept in INFO."""
    body, index, at = [b"movi"], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        body.append(made := chunk(b"00dc", f))
        at += len(made)
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // rate, most * rate, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, rate, 0, len(frames), most, 10_000, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    info = chunk(b"LIST", b"INFO" + chunk(b"ICMT", b"%d\0" % n_bytes))
    return chunk(b"RIFF", b"AVI " + hdrl + info + chunk(b"LIST", b"".join(body)) + chunk(b"idx1", b"".join(index)))


def read_avi(data: bytes) -> dict:
    """rate, n_bytes (None if not stated) and the frames, by the index, or by the chunks if it is missing. Offsets
    of the index count from the list of frames or from the file's start, whichever finds the first frame. Of a
    file that is cut short the frames that are whole are left; a file may have none."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not a RIFF AVI file")
    out: dict = {"rate": RATE, "n_bytes": None, "frames": []}
    index, movi, chunks = None, None, []

    def walk(at: int, end: int) -> None:
        nonlocal index, movi
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
            start = at + 8
            if name == b"LIST":
                if data[start : start + 4] == b"movi":
                    movi = start
                walk(start + 4, min(start + size, end))
            elif name == b"strh" and start + 28 <= end:
                scale, rate = struct.unpack("<II", data[start + 20 : start + 28])
                out["rate"] = rate / max(1, scale)
            elif name == b"ICMT" and (note := data[start : start + size].rstrip(b"\0")).isdigit():
                out["n_bytes"] = int(note)
            elif name == b"idx1":
                index = data[start : start + size]
            elif name[2:] in (b"dc", b"db"):
                chunks.append((start, size))
            at = start + size + size % 2

    walk(12, min(len(data), 8 + struct.unpack("<I", data[4:8])[0]))
    places = chunks
    if index is not None and movi is not None:
        entries = [(name, at, size) for name, _, at, size in struct.iter_unpack("<4sIII", index[: len(index) // 16 * 16]) if name[2:] in (b"dc", b"db")]
        bases = [base for base in (movi, 0) if entries and data[base + entries[0][1] :][:4] == entries[0][0]]
        if bases:
            places = [(bases[0] + at + 8, size) for _, at, size in entries]
    out["frames"] = [data[a : a + n] for a, n in places if n and a + n <= len(data)]
    return out


def store(payload: bytes, width: int = WIDTH, height: int = HEIGHT) -> bytes:
    """A payload (a positive multiple of `width` bytes) as an AVI file. The last frame ends in zeros."""
    rows = len(payload) // width
    height = min(height, rows)
    n = -(-rows // height)
    samples = np.zeros(n * height * width, np.uint8)
    samples[: len(payload)] = np.frombuffer(payload, np.uint8)
    return write_avi(encode_frames(samples.reshape(n, height, width)), width, height, len(payload))


def shots(frames: np.ndarray, factor: float = FACTOR, window: int = WINDOW, floor: float = FLOOR) -> list[tuple[int, int]]:
    """(first frame, end frame) of each shot."""
    n = len(frames)
    if n < 2:
        return [(0, n)] if n else []
    which = (frames.reshape(n, -1) >> 4).astype(np.int64) + np.arange(n)[:, None] * BINS
    h = np.bincount(which.ravel(), minlength=n * BINS).reshape(n, BINS) / frames[0].size
    d = np.abs(np.diff(h, axis=0)).sum(axis=1) / 2
    half = window // 2
    padded = np.pad(d, half, mode="reflect" if len(d) > half else "edge")
    view = np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1)
    cuts = np.flatnonzero((d > view.mean(axis=1) + factor * view.std(axis=1)) & (d > floor)) + 1
    edges = [0, *cuts.tolist(), n]
    return list(zip(edges[:-1], edges[1:], strict=True))
