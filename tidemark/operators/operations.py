"""Analytics over operations and experiments: storage pressure, signal gaps, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pressure(rows: DataFrame, warn: float = 0.2, critical: float = 0.1, empty: float = 0.02, hours: float = 24.0) -> DataFrame:
    """State of each (name, total, free, rate: bytes an hour): by free share, or CRITICAL if it is full within ``hours``."""
    share = F.col("free") / F.col("total")
    left = F.when(F.col("rate") > 0, F.col("free") / F.col("rate"))
    state = F.when(share <= empty, "EXHAUSTED").when((share <= critical) | (left <= hours), "CRITICAL").when(share <= warn, "PRESSURE").otherwise("NORMAL")
    return rows.withColumns({"hours_left": left, "state": state})


def signal_gaps(signals: DataFrame) -> DataFrame:
    """Missing sequence numbers of each stream as closed ranges (stream, first_missing, last_missing)."""
    w = Window.partitionBy("stream").orderBy("seq")
    rows = signals.select("stream", "seq").distinct().withColumn("nxt", F.lead("seq").over(w))
    return rows.where("nxt > seq + 1").select("stream", (F.col("seq") + 1).alias("first_missing"), (F.col("nxt") - 1).alias("last_missing"))


def rank_runs(runs: DataFrame, by: list[str], metric: str, key: str, highest: bool = True) -> DataFrame:
    """Rank 1..n by metric, then key; runs without the metric are kept without a rank."""
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last(metric) if highest else F.asc_nulls_last(metric), key)
    return runs.withColumn("rank", F.when(F.col(metric).isNotNull(), F.row_number().over(w)))


def average_rank(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Rank 1 is the worst; equal values share the mean of their places."""
    w = Window.partitionBy(*by)
    places = rows.withColumn("place", F.row_number().over(w.orderBy(value)))
    return places.withColumn("rank", F.avg("place").over(Window.partitionBy(*by, value))).drop("place")
