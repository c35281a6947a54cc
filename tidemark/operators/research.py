"""Event detection, forward outcomes on an exact grid, study aggregates and sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = {">": "gt", ">=": "ge", "<": "lt", "<=": "le", "=": "eq", "!=": "ne"}


def threshold(value: Column, op: str, bound: Column, sign: str = "any") -> Column:
    """value op bound, and the sign that is asked for: any, +, -, >=0 or <=0."""
    compare = {">": value > bound, ">=": value >= bound, "<": value < bound, "<=": value <= bound, "=": value == bound, "!=": value != bound}[op]
    return compare & {"any": F.lit(True), "+": value > 0, "-": value < 0, ">=0": value >= 0, "<=0": value <= 0}[sign]


def outcomes(events: DataFrame, bars: DataFrame, period_us: int, horizons: list[int]) -> DataFrame:
    """For each event (instrument, event_us) and horizon (a number of bars) the outcome on the bars' grid.

    COMPLETE if bars exist at event + k * period for k = 0..n; else INSUFFICIENT_COVERAGE. Path figures are over the bars before
    the first that is missing, without the anchor, and null if there is none. Events and bars meet by equality of time: each event asks
    for its n + 1 grid times, so no range join is needed."""
    most = max(horizons)
    asked = events.select("instrument", "event_us", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("k")).withColumn("bucket_us", F.col("event_us") + F.col("k") * period_us)
    rows = asked.join(bars.select("instrument", "bucket_us", "high", "low", "close"), ["instrument", "bucket_us"], "left")
    path = rows.groupBy("instrument", "event_us").agg(F.array_sort(F.collect_list(F.struct("k", "close", "high", "low"))).alias("path"))
    grid = path.select("*", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon"))
    e = F.expr
    grid = grid.withColumn("path", e("filter(path, x -> x.k <= horizon)"))
    grid = grid.withColumn("valid", e("coalesce(array_min(transform(filter(path, x -> x.close is null), x -> x.k)), horizon + 1)"))
    grid = grid.withColumns({"anchor": e("cast(path[0].close as double)"), "walk": e("filter(path, x -> x.k >= 1 and x.k < valid)")})
    grid = grid.withColumn("returns", e("transform(walk, x -> cast(x.close as double) / anchor - 1)"))
    complete = F.col("valid") == F.col("horizon") + 1
    some = e("valid >= 1 and size(returns) > 0")
    return grid.select(
        "instrument",
        "event_us",
        "horizon",
        F.when(complete, "COMPLETE").otherwise("INSUFFICIENT_COVERAGE").alias("state"),
        F.when(complete, e("returns[horizon - 1]")).alias("forward_return"),
        F.when(complete, e("(cast(array_max(transform(walk, x -> x.high)) as double) - cast(array_min(transform(walk, x -> x.low)) as double)) / anchor")).alias("high_low_excursion"),
        F.when(complete, e("element_at(array_sort(transform(walk, x -> struct(-abs(cast(x.close as double) / anchor - 1) as a, x.k as k, cast(x.close as double) / anchor - 1 as r))), 1).r")).alias("extreme_return"),
        F.when(some, e("greatest(0D, array_max(returns))")).alias("mfe"),
        F.when(some, e("least(0D, array_min(returns))")).alias("mae"),
    )


def study(rows: DataFrame, by: list[str], value: str = "forward_return") -> DataFrame:
    """Counts by state, and over COMPLETE outcomes mean, midpoint median, population deviation, extremes and sign rates."""
    done = F.when(F.col("state") == "COMPLETE", F.col(value))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count(done).alias("n_complete"),
        F.avg(done).alias("mean"),
        F.percentile(done, 0.5).alias("median"),
        F.stddev_pop(done).alias("deviation"),
        F.min(done).alias("least"),
        F.max(done).alias("most"),
        (F.count_if(done > 0) / F.nullif(F.count(done), F.lit(0))).alias("positive_rate"),
        (F.count_if(done < 0) / F.nullif(F.count(done), F.lit(0))).alias("negative_rate"),
    )
