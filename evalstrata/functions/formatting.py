"""Numbers and secrets for people to read."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CHRF = ("chrf", "chrf++")


def mask(secret: str | None) -> str:
    """The first three signs and the last four; short secrets not at all."""
    if not secret:
        return ""
    return "****" if len(secret) <= 8 else f"{secret[:3]}…{secret[-4:]}"


def redacted(text: Column) -> Column:
    """Text with access tokens masked."""
    return F.regexp_replace(text, r"\bhf_[A-Za-z0-9]{4,}", "hf_****")


def redact(text: str) -> str:
    return re.sub(r"\bhf_[A-Za-z0-9]{4,}", "hf_****", text)


def value(metric: str, x: float | None) -> str:
    """A metric's value: chrF as it is, fractions as per cent, nothing as a dash."""
    if x is None:
        return "-"
    return f"{x:.1f}" if metric in CHRF else f"{100 * x:.1f}%"


def difference(metric: str, x: float | None) -> str:
    if x is None:
        return "-"
    return f"{x:+.1f}" if metric in CHRF else f"{100 * x:+.1f} pts"
