"""Scalar functions of change feeds, partitions and run logs, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A time of day whose hours may exceed 23.
TIME = r"^[0-9]+:[0-5][0-9]:[0-5][0-9]$"


def row_key(columns: Sequence[Column]) -> Column:
    """Key columns joined by a bar; null counts as empty."""
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])


def md5_mod(column: Column, k: int) -> Column:
    """The 128-bit MD5 of the text, modulo ``k`` (below 2**31), without wide integers.

    Horner's rule over the digest's four 32-bit words stays within 63 bits.
    """
    if not 0 < k < 1 << 31:
        raise ValueError("k must be positive and below 2**31")
    digest = F.md5(column.cast("string").cast("binary"))
    out = F.lit(0).cast("long")
    for at in (1, 9, 17, 25):
        word = F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
        out = (out * F.lit(1 << 32) + word) % F.lit(k)
    return out.cast("int")


def seconds_of(time: Column) -> Column:
    """Seconds of ``H+:MM:SS``; null where the text is no such time."""
    part = F.split(time, ":")
    return F.when(time.rlike(TIME), part[0].cast("long") * 3600 + part[1].cast("long") * 60 + part[2].cast("long"))


def time_of(seconds: Column) -> Column:
    """``HH:MM:SS``, with more digits of hours where needed."""
    hours = F.floor(seconds / 3600).cast("long")
    return F.format_string("%02d:%02d:%02d", hours, F.floor(seconds / 60).cast("long") % 60, seconds.cast("long") % 60)


def shift_time(time: Column, by: Column | int) -> Column:
    """The time later by some seconds, not below zero; null where it is no time."""
    moved = seconds_of(F.trim(time)) + (F.lit(by) if isinstance(by, int) else by)
    return F.when(moved.isNotNull(), time_of(F.greatest(moved, F.lit(0))))


def fresh_key(key: Column, offset: Column | int, gap: int = 1_000_000) -> Column:
    """A new key: a number moved by ``gap`` and offset, any other text with a suffix."""
    offset = F.lit(offset) if isinstance(offset, int) else offset
    text = key.cast("string")
    number = F.when(text.rlike("^[0-9]{1,18}$"), F.try_to_number(text, F.lit("9" * 18)).cast("long"))
    return F.coalesce((number + gap + offset).cast("string"), F.concat(text, F.lit("_new"), offset.cast("string")))


def elapsed_seconds(text: Column) -> Column:
    """Seconds of ``m:ss.ff`` or ``h:mm:ss``."""
    part = F.split(text, ":")
    n = F.size(part)
    return F.when(n == 3, part[0].cast("double") * 3600 + part[1].cast("double") * 60 + F.get(part, F.lit(2)).cast("double")).when(
        n == 2, part[0].cast("double") * 60 + part[1].cast("double")
    )


def half_up(value: Column) -> Column:
    """The nearest whole number, halves upward."""
    return F.floor(value + 0.5).cast("long")


def kb_to_mb(kb: Column) -> Column:
    """Kibibytes as mebibytes."""
    return kb / 1024.0


def split_list(text: str) -> list[str]:
    """Comma-separated names, trimmed, empty ones left out."""
    return [p.strip() for p in text.split(",") if p.strip()]
