"""Algebra of half-open intervals (key..., start, end)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Unions of overlapping or touching intervals. Empty intervals (start = end) count for nothing."""
    rows = df.where("start < end")
    w = Window.partitionBy(*key).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("opens", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0))
    rows = rows.withColumn("island", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def gaps(covered: DataFrame, key: Sequence[str], within: DataFrame) -> DataFrame:
    """What ``within`` (key..., start, end: one interval a key) has that ``covered`` has not."""
    asked = within.select(*key, F.col("start").alias("lo"), F.col("end").alias("hi"))
    own = covered.join(asked, list(key)).where("start < hi and end > lo")
    own = own.select(*key, F.greatest("start", "lo").alias("start"), F.least("end", "hi").alias("end"))
    edges = own.unionByName(asked.select(*key, F.col("lo").alias("start"), F.col("lo").alias("end")))
    w = Window.partitionBy(*key).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, 0))
    nxt = F.lead("start").over(w)
    rows = edges.withColumns({"reach": reach, "nxt": nxt}).join(asked.drop("lo"), list(key))
    return rows.select(*key, F.col("reach").alias("start"), F.coalesce("nxt", "hi").alias("end")).where("start < end")


def overlapping(left: DataFrame, right: DataFrame, key: Sequence[str], cell: int) -> DataFrame:
    """Pairs of intervals of equal key that overlap: (key..., l_start, l_end, r_start, r_end).

    Both sides are dealt to cells of ``cell`` units that they touch, so the join is an equality of key and cell;
    a pair is reported in the first cell they share."""
    number = lambda c: F.floor((c - F.pmod(c, F.lit(cell))) / cell)

    def deal(d: DataFrame, p: str) -> DataFrame:
        cells = F.sequence(number(F.col("start")), number(F.col("end") - 1))
        return d.where("start < end").select(*key, F.col("start").alias(p + "_start"), F.col("end").alias(p + "_end"), F.explode(cells).alias("cell"))

    both = deal(left, "l").join(deal(right, "r"), [*key, "cell"]).where("l_start < r_end and r_start < l_end")
    first = F.greatest("l_start", "r_start")
    return both.where(F.col("cell") == number(first)).drop("cell")
