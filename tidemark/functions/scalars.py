"""Exact scalars: decimal text, rounding, equivalence, canonical text and digests, path encoding, partition keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .instants import bucket_floor

DAY_US = 86_400_000_000
#: Texts that count as a signal, and as none.
TRUE_WORDS = ("true", "yes", "1", "long", "short", "exit")
FALSE_WORDS = ("false", "no", "0", "flat", "none", "")


def day_start(ts_us: Column) -> Column:
    return bucket_floor(ts_us, DAY_US)


def next_midnight(ts_us: Column) -> Column:
    """The first midnight (UTC) after the instant."""
    return bucket_floor(ts_us, DAY_US) + DAY_US


def support(start: Column, end: Column, width: int) -> tuple[Column, Column]:
    """[start, end) widened to whole buckets; an empty interval stays empty."""
    return F.when(start >= end, start).otherwise(bucket_floor(start, width)), F.when(start >= end, start).otherwise(bucket_floor(end - 1, width) + width)


def decimal_text(text: Column) -> Column:
    """Unsigned decimal text without exponent, of any length, without needless zeros; anything else raises."""
    whole = F.regexp_replace(F.regexp_extract(text, r"^([0-9]+)", 1), r"^0+(?=[0-9])", "")
    part = F.rtrim(F.regexp_extract(text, r"\.([0-9]+)$", 1), F.lit("0"))
    plain = F.when(part == "", whole).otherwise(F.concat(whole, F.lit("."), part))
    return F.when(text.isNull(), F.lit(None).cast("string")).when(text.rlike(r"^[0-9]+(\.[0-9]+)?$"), plain).otherwise(F.raise_error(F.concat(F.lit("not a decimal: "), text)).cast("string"))


def ratio(x: Column, y: Column) -> Column:
    """x / y in doubles by IEEE 754: over zero it is infinite, or NaN for zero, instead of an error."""
    a, b = x.cast("double"), y.cast("double")
    over = F.when((a == 0) | F.isnan(a), float("nan")).otherwise(F.signum(a) * F.lit(float("inf")))
    return F.when(b == 0, over).otherwise(a / F.nullif(b, F.lit(0.0)))


def half_even(x: Column, quantum: Column) -> Column:
    """The nearest multiple of the quantum; of two the even one."""
    return F.bround(x / quantum, 0) * quantum


def matches(left: Column, right: Column, mode: str, absolute: float = 0.0, relative: float = 0.0, quantum: float = 1.0) -> Column:
    """EXACT, QUANTIZED (equal half-even multiples) or TOLERANT (difference within absolute + relative * larger magnitude)."""
    if mode == "EXACT":
        return left.eqNullSafe(right)
    if mode == "QUANTIZED":
        return half_even(left, F.lit(quantum)).eqNullSafe(half_even(right, F.lit(quantum)))
    if mode == "TOLERANT":
        return F.abs(left - right) <= absolute + relative * F.greatest(F.abs(left), F.abs(right))
    raise ValueError(f"unknown mode {mode!r}")


def truthy(text: Column) -> Column:
    """Whether a signal's text says yes; a text that says neither raises."""
    word = F.lower(F.trim(text))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False).otherwise(F.raise_error(F.concat(F.lit("no truth value: "), text)).cast("boolean"))


def path_encoded(text: Column) -> Column:
    """Bytes of UTF-8 other than letters, digits and ``._-`` as %XX: an injective path component."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), 1)
    char = lambda x: F.char(F.conv(x, 16, 10).cast("int"))
    return F.array_join(F.transform(pairs, lambda x: F.when(char(x).rlike("^[A-Za-z0-9._-]$"), char(x)).otherwise(F.concat(F.lit("%"), x))), "")


def root_path(layer: Column, kind: Column, venue: Column, instrument: Column, schema: Column, feature_set: Column | None = None, version: Column | None = None) -> Column:
    """A dataset's folder; features have their set and version in it."""
    own = [layer, kind, venue, path_encoded(instrument)]
    if feature_set is not None:
        own += [feature_set, F.concat(F.lit("v"), version.cast("string"))]
    return F.concat_ws("/", *own, schema)


def slice_key(ts_us: Column) -> Column:
    """``dt=<day>/seg=<HHMMSS.mmm>`` of a window's start; finer than milliseconds raises."""
    at = F.timestamp_micros(ts_us)
    text = F.concat(F.date_format(at, "'dt='yyyy-MM-dd'/seg='HHmmss."), F.lpad(F.floor(F.pmod(ts_us, F.lit(1_000_000)) / 1000).cast("string"), 3, "0"))
    return F.when(ts_us % 1000 == 0, text).otherwise(F.raise_error(F.lit("not a whole millisecond")).cast("string"))


def threshold_class(x: Column, thresholds: Sequence[float]) -> Column:
    """Number of thresholds at or below x: the right-open bin that x falls into."""
    return sum((F.when(x >= t, 1).otherwise(0) for t in thresholds), F.lit(0))


def canonical_line(names: Sequence[str]) -> Column:
    """JSON text of the columns in order of their names; nulls are written."""
    return F.to_json(F.struct(*[F.col(n) for n in sorted(names)]), {"ignoreNullFields": "false"})


def content_digest(rows: DataFrame, by: Sequence[str], order: Sequence[str], names: Sequence[str], chunk: int = 1024) -> DataFrame:
    """(by..., n, digest): SHA-256 over the digests of chunks of ``chunk`` rows in order, each over its rows' digests; so no task holds a group's rows.

    ``order`` must be a total order within ``by``; equal rows have equal digests."""
    w = Window.partitionBy(*by).orderBy(*order)
    own = rows.select(*by, F.sha2(canonical_line(names), 256).alias("d"), F.row_number().over(w).alias("n"))
    join = lambda d, n: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(n, d))), lambda x: x[d]), ""), 256)
    parts = own.groupBy(*by, F.floor((F.col("n") - 1) / chunk).alias("part")).agg(F.count("*").alias("rows"), join("d", "n").alias("digest"))
    return parts.groupBy(*by).agg(F.sum("rows").alias("n"), join("digest", "part").alias("digest"))
