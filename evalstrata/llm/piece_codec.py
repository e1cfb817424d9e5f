"""SentencePiece encoding and decoding of whole texts as a DataFrame operator.

Defined cases: null and empty texts have the end id only and decode to the empty text. Texts of any
length are encoded whole. Repeated rows give a row each; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame

from .common import arrow_rows, here, two_columns
from .sentencepieces import encoder

COLUMNS = {
    "n_tokens": "long",
    "ids": "array<int>",
    "starts": "array<int>",
    "ends": "array<int>",
    "decoded": "string",
    "ids_sha256": "string",
    "spans_sha256": "string",
    "decoded_sha256": "string",
}


def encode_pieces(
    documents: DataFrame,
    columns: tuple[str, ...] = ("n_tokens", "ids", "starts", "ends", "decoded"),
    model: str | None = None,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row a document: key and the columns asked for. ids end with the end id; starts and ends are
    the byte spans in the original text of all pieces but that. Digests are lowercase hex SHA-256: of
    decimal ids joined by a blank, of the ends as 32-bit little-endian numbers, of the decoded UTF-8."""
    path = model or here("piece_bpe_32k.model")

    def make():
        import numpy as np

        own = encoder(path)
        end = own.model.end
        last = b"%d" % end
        wanted = {c: [] for c in columns}

        def work(keys, texts):
            for c in wanted:
                wanted[c] = []
            for t in texts:
                t = t or ""
                parts = own.parts(t)
                for c, out in wanted.items():
                    if c == "n_tokens":
                        out.append(sum([p[0] for p in parts]) + 1)
                    elif c == "ids":
                        out.append([*own.ids(parts), end])
                    elif c == "ids_sha256":
                        out.append(hashlib.sha256(b" ".join([*[p[1] for p in parts], last])).hexdigest())
                    elif c in ("decoded", "decoded_sha256"):
                        d = own.model.unprefixed(b"".join([p[2] for p in parts]))
                        out.append(d if c == "decoded" else hashlib.sha256(d.encode()).hexdigest())
                    else:
                        starts, ends = own.spans(t, parts)
                        out.append(starts if c == "starts" else ends if c == "ends" else hashlib.sha256(np.asarray(ends, "<i4").tobytes()).hexdigest())
            return wanted | {"key": keys}

        return work

    kind = dict(documents.dtypes)[key]
    return arrow_rows(two_columns(documents, key, text), make, f"key {kind}, " + ", ".join(f"{c} {COLUMNS[c]}" for c in columns))
