"""Instants are integer nanoseconds (or microseconds); text is RFC 3339 with Z and up to nine fraction digits."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?Z$"
#: Units of a duration in nanoseconds, and its clock form.
CLOCK = r"(\d+):([0-5]\d):([0-5]\d)(?:\.(\d{1,9}))?"
UNITS = {"ns": 1, "us": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9}


def bucket_floor(ts: Column, width: int) -> Column:
    """Start of the epoch-aligned bucket, also before the epoch."""
    return ts - F.pmod(ts, F.lit(width))


def parse_ns(text: Column) -> Column:
    """Nanoseconds of an RFC 3339 text; anything else raises."""
    seconds = F.unix_timestamp(F.to_timestamp(F.substring(text, 1, 19), "yyyy-MM-dd'T'HH:mm:ss"))
    fraction = F.rpad(F.regexp_extract(text, r"\.(\d+)Z$", 1), 9, "0").cast("long")
    return F.when(text.isNull(), F.lit(None).cast("long")).when(text.rlike(RFC3339), seconds * 1_000_000_000 + fraction).otherwise(F.raise_error(F.concat(F.lit("not an instant: "), text)).cast("long"))


def format_ns(ns: Column) -> Column:
    """RFC 3339 text without trailing zeros in the fraction."""
    head = F.date_format(F.timestamp_seconds(F.floor((ns - F.pmod(ns, F.lit(1_000_000_000))) / F.lit(1_000_000_000))), "yyyy-MM-dd'T'HH:mm:ss")
    tail = F.rtrim(F.lpad(F.pmod(ns, F.lit(1_000_000_000)).cast("string"), 9, "0"), F.lit("0"))
    return F.concat(head, F.when(tail == "", "").otherwise(F.concat(F.lit("."), tail)), F.lit("Z"))


def parse_duration(value: int | str) -> int:
    """Nanoseconds, above zero, of 300, '300', '5m', '100ms' or 'HH:MM:SS.f'; anything else is refused."""
    if isinstance(value, str):
        text = value.strip()
        number = text.rstrip("nusmhd")
        if ":" in text:
            clock = re.fullmatch(CLOCK, text)
            parts = clock.groups(default="") if clock else None
            found = sum(int(x) * 60**i for i, x in enumerate(reversed(parts[:3]))) * UNITS["s"] + int(parts[3].ljust(9, "0")) if parts else 0
        else:
            found = int(number) * UNITS.get(text[len(number) :] or "ns", 0) if number.isascii() and number.isdigit() else 0
    else:
        found = value if type(value) is int else 0
    if found <= 0:
        raise ValueError(f"not a duration: {value!r}")
    return found
