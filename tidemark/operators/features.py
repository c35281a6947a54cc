"""Features of bars and footprints, and window statistics over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def volume_ratio(own: Column, other: Column) -> Column:
    """own / other; an absent neighbour gives NaN, zero against something +inf, zero against zero 0."""
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    return F.when(other.isNull(), nan).when(other == 0, F.when(own > 0, inf).otherwise(0.0)).otherwise(own.cast("double") / other.cast("double"))


def diagonal_imbalance(cells: DataFrame, ratio: float) -> DataFrame:
    """Ask ratio buy[k] / sell[k-1] and bid ratio sell[k] / buy[k+1] of adjacent levels of a bar, and the side that hits."""
    w = Window.partitionBy("instrument", "bucket_us").orderBy("level")
    near = lambda c, f, step: F.when(f("level").over(w) == F.col("level") + step, f(c).over(w))
    rows = cells.where("level is not null").withColumns({
        "ask_ratio": volume_ratio(F.col("buy_volume"), near("sell_volume", F.lag, -1)),
        "bid_ratio": volume_ratio(F.col("sell_volume"), near("buy_volume", F.lead, 1)),
    })
    hit = lambda r, v: ~F.isnan(r) & (F.col(r) >= ratio) & (F.col(v) > 0)
    ask, bid = hit("ask_ratio", "buy_volume"), hit("bid_ratio", "sell_volume")
    side = F.when(ask & bid, F.when(F.col("ask_ratio") >= F.col("bid_ratio"), "ask").otherwise("bid")).when(ask, "ask").when(bid, "bid")
    return rows.withColumns({"side": side, "total": F.col("buy_volume") + F.col("sell_volume"), "delta": F.col("buy_volume") - F.col("sell_volume")})


def stacked_imbalance(sides: DataFrame, min_levels: int) -> DataFrame:
    """Runs of ``min_levels`` or more consecutive levels of one side; other rows have run length 0."""
    w = Window.partitionBy("instrument", "bucket_us").orderBy("level")
    go_on = F.col("side").isNotNull() & F.col("side").eqNullSafe(F.lag("side").over(w)) & F.col("level").eqNullSafe(F.lag("level").over(w) + 1)
    rows = sides.withColumn("run", F.sum(F.when(go_on, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.count("*").over(Window.partitionBy("instrument", "bucket_us", "run"))
    stacked = F.col("side").isNotNull() & (F.col("size") >= min_levels)
    return rows.withColumn("size", size).withColumns({"stacked": stacked, "run_length": F.when(stacked, F.col("size")).otherwise(0)}).drop("run", "size")


def failed_aggression(bars: DataFrame, theta: str = "0.3", wick: str = "0.5") -> DataFrame:
    """+1 where buyers pushed and failed, -1 where sellers did, else 0; products instead of quotients, so exact."""
    t, w = F.lit(theta).cast("decimal(4,2)"), F.lit(wick).cast("decimal(4,2)")
    total, delta = F.col("taker_buy_volume") + F.col("taker_sell_volume"), F.col("taker_buy_volume") - F.col("taker_sell_volume")
    floor_d, floor_w = t * total, w * (F.col("high") - F.col("low"))
    up = (delta >= floor_d) & (F.col("high") - F.greatest("open", "close") > floor_w) & (F.col("close") < F.col("open"))
    down = (-delta >= floor_d) & (F.least("open", "close") - F.col("low") > floor_w) & (F.col("close") > F.col("open"))
    return bars.withColumn("signal", F.when(up, 1).when(down, -1).otherwise(0))


def donchian_breakout(bars: DataFrame, length: int) -> DataFrame:
    """Close above the highest or below the lowest close of the ``length`` bars before; false without history."""
    w = Window.partitionBy("instrument").orderBy("bucket_us").rowsBetween(-length, -1)
    over = lambda c: F.coalesce(c, F.lit(False))
    return bars.withColumns({"breaks_up": over(F.col("close") > F.max("close").over(w)), "breaks_down": over(F.col("close") < F.min("close").over(w))})


def drawdown(equity: DataFrame) -> DataFrame:
    """Running peak and (peak - equity) / peak."""
    w = Window.partitionBy("instrument").orderBy("bucket_us").rowsBetween(Window.unboundedPreceding, 0)
    peak = F.max("equity").over(w)
    return equity.withColumn("peak", peak).withColumn("drawdown", F.when(F.col("peak") > 0, (F.col("peak") - F.col("equity")).cast("double") / F.col("peak").cast("double")))


def loss_streak(outcomes: DataFrame) -> DataFrame:
    """Losses since the last profit, through each row; a zero neither counts nor breaks."""
    w = Window.partitionBy("instrument").orderBy("bucket_us")
    rows = outcomes.withColumn("era", F.sum(F.when(F.col("pnl") > 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy("instrument", "era").orderBy("bucket_us").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("losses", F.sum(F.when(F.col("pnl") < 0, 1).otherwise(0)).over(own)).drop("era")
