r"""WARC archives: records written by Spark, and a reader that salvages what is left of damaged ones.

Reading a file of records, plain or one gzip member each: after a failed check (gzip stream or CRC,
version line, header, length, end of record, block digest) the reader looks for the next place where
a gzip member starts or a version line `WARC/1.` stands and a record passes all checks, goes on from
there, and logs the bytes between as a quarantined gap. Records that pass are never lost to one that
does not.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

FIRST_LINE = re.compile(rb"WARC/1\.[01]\r\n")
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


class Damaged(ValueError):
    pass


def record_at(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """(headers, block, end) of the record that starts at `at`; raises Damaged after a failed check."""
    if data[at : at + 3] == b"\x1f\x8b\x08":
        stream, inner, end_of_read = zlib.decompressobj(31), bytearray(), at
        try:
            while not stream.eof and end_of_read < len(data):
                inner += stream.decompress(data[end_of_read : end_of_read + 65536])
                end_of_read = min(len(data), end_of_read + 65536)
        except zlib.error as e:
            raise Damaged(f"gzip: {e}") from None
        if not stream.eof:
            raise Damaged("gzip: cut off")
        headers, block, end = plain_record(bytes(inner), 0)
        if end != len(inner):
            raise Damaged("bytes behind the record of a member")
        return headers, block, end_of_read - len(stream.unused_data)
    return plain_record(data, at)


def plain_record(data: bytes, at: int) -> tuple[dict, bytes, int]:
    if not FIRST_LINE.match(data, at):
        raise Damaged("version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Damaged("header")
    headers = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header")
        headers[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    if not headers.get("content-length", "").isdecimal() or "warc-type" not in headers:
        raise Damaged("header")
    start = stop + 4
    end = start + int(headers["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("length")
    block = data[start:end]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha256:") and digest[7:] != hashlib.sha256(block).hexdigest():
        raise Damaged("block digest")
    return headers, block, end + 4


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict | str, bytes]]:
    """("record", start, end, headers, block) and ("gap", start, end, reason, b"") in order; together
    they cover the file."""
    at, gap, reason = 0, None, ""
    while at < len(data):
        try:
            headers, block, end = record_at(data, at)
        except Damaged as e:
            if gap is None:
                gap, reason = at, str(e)
            hit = START.search(data, at + 1)
            at = hit.start() if hit else len(data)
            continue
        if gap is not None:
            yield "gap", gap, at, reason, b""
            gap = None
        yield "record", at, end, headers, block
        at = end
    if gap is not None:
        yield "gap", gap, len(data), reason, b""


def payload_of(headers: dict, block: bytes) -> bytes:
    """The payload: of HTTP messages what follows their headers."""
    if headers.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block
