"""Media columns: texts stored as AVI motion-JPEG, read back, and cut into timed clips.

Defined cases: null and empty texts are a payload of 64 zero bytes. Equal texts give equal files and
features. Repeated rows give a row each; other columns are ignored. A text is held in memory with its
file; nothing is gathered over several rows.
"""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .avi import decode_frames, read_avi, shots, store
from .common import arrow_rows, two_columns


def padded(text: str | None, unit: int = 64) -> tuple[bytes, int]:
    """The UTF-8 bytes with zeros up to a positive multiple of `unit`, and their number before."""
    raw = (text or "").encode()
    return raw + b"\0" * ((-len(raw)) % unit if raw else unit), len(raw)


def read_back(media: bytes) -> tuple[bytes, list[dict]]:
    """The payload and the clips of a stored file: no bytes and no clips if it has no whole frame. A file that is
    no RIFF AVI, or has frames of another kind of JPEG, is a ValueError."""
    film = read_avi(media)
    frames = decode_frames(film["frames"])
    payload = frames.tobytes()[: film["n_bytes"]]
    tick = 1000 / film["rate"]
    return payload, [{"start_ms": round(a * tick), "end_ms": round(b * tick)} for a, b in shots(frames)]


def media_clips(documents: DataFrame, key: str = "doc_id", text: str = "text", with_media: bool = False) -> DataFrame:
    """One row a document: key, n_bytes, payload digests of what was read back, the digest and size of
    the stored file, and its clips; with_media adds the file itself."""

    def make():
        def work(keys, texts):
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "clips", "media"]
            out = {n: [] for n in names}
            for t in texts:
                raw, n = padded(t)
                media = store(raw)
                back, clips = read_back(media)
                row = [n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), clips, media if with_media else None]
                for name, value in zip(names, row, strict=True):
                    out[name].append(value)
            return out | {"key": keys}

        return work

    kind = dict(documents.dtypes)[key]
    schema = f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, clips array<struct<start_ms:long,end_ms:long>>"
    return arrow_rows(two_columns(documents, key, text), make, schema + ", media binary" * with_media)


def clip_rows(media: DataFrame) -> DataFrame:
    """The result of media_clips as a row for each timed clip."""
    return media.select("key", F.posexplode("clips").alias("clip", "at")).select("key", "clip", "at.start_ms", "at.end_ms")
