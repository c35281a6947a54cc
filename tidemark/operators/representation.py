"""Candles, bar flow and footprints of trades (instrument, ts_us, trade_id, price, size, aggressor_side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import require_none
from ..functions.instants import bucket_floor

KEY = ("ts_us", "trade_id")


def _ohlcv() -> list[Column]:
    key = F.struct(*KEY)
    return [
        F.min_by("price", key).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", key).alias("close"),
        F.sum("size").alias("volume"),
        F.count("*").alias("trade_count"),
    ]


def candles(trades: DataFrame, width_us: int) -> DataFrame:
    """One row per instrument and bucket that has trades; the first and last trade by (time, id)."""
    rows = trades.withColumn("bucket_us", bucket_floor(F.col("ts_us"), width_us))
    return rows.groupBy("instrument", "bucket_us").agg(*_ohlcv())


def bar_flow(trades: DataFrame, width_us: int) -> DataFrame:
    """Candles with the volume of takers on each side; a side other than buy or sell raises."""
    side = F.when(F.col("aggressor_side").isin("buy", "sell"), F.col("aggressor_side")).otherwise(F.raise_error(F.concat(F.lit("unknown side: "), F.coalesce("aggressor_side", F.lit("null")))))
    rows = trades.withColumns({"bucket_us": bucket_floor(F.col("ts_us"), width_us), "side": side})
    part = lambda s: F.sum(F.when(F.col("side") == s, F.col("size")).otherwise(F.lit(0).cast("decimal(18,2)")))
    return rows.groupBy("instrument", "bucket_us").agg(*_ohlcv(), part("buy").alias("taker_buy_volume"), part("sell").alias("taker_sell_volume"))


def footprint(trades: DataFrame, width_us: int, tick: str) -> DataFrame:
    """Buy and sell volume per bucket and price level; a price that is no multiple of ``tick`` raises.

    Buckets without trades between an instrument's first and last stay, with a null level."""
    step = F.lit(tick).cast("decimal(18,2)")
    level = F.when(F.col("price") % step == 0, (F.col("price") / step).cast("long")).otherwise(F.raise_error(F.lit("price off the grid")).cast("string").cast("long"))
    rows = trades.withColumns({"bucket_us": bucket_floor(F.col("ts_us"), width_us), "level": level})
    zero = F.lit(0).cast("decimal(18,2)")
    cells = rows.groupBy("instrument", "bucket_us", "level").agg(
        F.sum(F.when(F.col("aggressor_side") == "buy", F.col("size")).otherwise(zero)).alias("buy_volume"),
        F.sum(F.when(F.col("aggressor_side") == "sell", F.col("size")).otherwise(zero)).alias("sell_volume"),
    )
    span = rows.groupBy("instrument").agg(F.min("bucket_us").alias("a"), F.max("bucket_us").alias("b"))
    spine = span.select("instrument", F.explode(F.sequence("a", "b", F.lit(width_us))).alias("bucket_us"))
    return spine.join(cells, ["instrument", "bucket_us"], "left")


def side_stats(trades: DataFrame) -> DataFrame:
    """Rows, sides, null ids, first and last instant of each instrument."""
    return trades.groupBy("instrument").agg(
        F.count("*").alias("trades"),
        F.count_if(F.col("aggressor_side") == "buy").alias("buys"),
        F.count_if(F.col("aggressor_side") == "sell").alias("sells"),
        F.count_if(F.col("trade_id").isNull()).alias("null_ids"),
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
    )


def require_within(trades: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """``trades`` if all lie in [start, end); else an error."""
    require_none(trades.where((F.col("ts_us") < start_us) | (F.col("ts_us") >= end_us)).select("trade_id", "ts_us"), "trades outside the support")
    return trades
