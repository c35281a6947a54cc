"""Fail-closed checks: violations are rows that are counted, and raise before a result is released."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class ViolationError(ValueError):
    """Input that breaks a contract; nothing is dropped to get round it."""


def require_none(violations: DataFrame, what: str) -> None:
    found = violations.limit(3).collect()
    if found:
        raise ViolationError(f"{what}: {[r.asDict() for r in found]}")


def guarded(value: Column, condition: Column, message: str) -> Column:
    """``value``, or an error as soon as ``condition`` isn't true for a row."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)).cast("string").cast("double").cast("decimal(38,2)"))


def order_violations(df: DataFrame, partition: Sequence[str], position: str, key: Sequence[str]) -> DataFrame:
    """Rows whose key is not above that of the row before (by ``position``) in the same partition."""
    w = Window.partitionBy(*partition).orderBy(position)
    return df.withColumn("previous_key", F.lag(F.struct(*key)).over(w)).where(F.struct(*key) <= F.col("previous_key"))


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("copies")).where("copies > 1")


def sampled_violations(df: DataFrame, code: str, order: Sequence[str], most: int) -> DataFrame:
    """The first ``most`` rows of each code, with the number of all of them."""
    w = Window.partitionBy(code)
    return df.withColumns({"n": F.row_number().over(w.orderBy(*order)), "total": F.count("*").over(w)}).where(F.col("n") <= most)


def bounded(df: DataFrame, most: int) -> DataFrame:
    """``df`` if it has at most ``most`` rows; else an error, never a cut result."""
    if df.limit(most + 1).count() > most:
        raise ViolationError(f"the result has more than {most} rows")
    return df
