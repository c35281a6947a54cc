"""Costs of fills, sizing, and slices of a live stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fee(price: Column, quantity: Column, bps: Column) -> Column:
    return price * quantity * bps / 10000


def slipped(price: Column, side: Column, bps: Column) -> Column:
    """Buys pay more, sells get less."""
    return F.when(side == "buy", price * (10000 + bps) / 10000).otherwise(price * (10000 - bps) / 10000)


def unrealized(side: Column, mark: Column, quantity: Column, basis: Column) -> Column:
    return F.when(side == "long", mark * quantity - basis).otherwise(basis - mark * quantity)


def sized(target: Column, budget: Column, price: Column, most: Column, least: Column, lot: Column) -> Column:
    """min(target, budget / price, most) in whole lots; below ``least`` nothing."""
    lots = F.floor(F.least(F.abs(target), budget / price, most) / lot) * lot
    return F.when(lots < least, 0).otherwise(lots)


def slices(trades: DataFrame, most: int, seconds: int) -> DataFrame:
    """(instrument, trade_id, slice): greedy cuts by number of trades, time since the first, and UTC midnight; equal instants stay together.

    Trades stream through in order, so a task holds the state of one slice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, n, began, last, number = None, 0, 0, None, 0
        for b in batches:
            got = []
            for name, ts in zip(b.instrument, b.ts_us, strict=True):
                if name != who:
                    who, n, began, last, number = name, 0, ts, None, 0
                elif ts != last and (n >= most or ts - began >= seconds * 1_000_000 or ts // 86_400_000_000 != began // 86_400_000_000):
                    n, began, number = 0, ts, number + 1
                n, last = n + 1, ts
                got.append(number)
            yield pd.DataFrame({"instrument": b.instrument, "trade_id": b.trade_id, "slice": got})

    rows = trades.select("instrument", "ts_us", "trade_id").repartition("instrument").sortWithinPartitions("instrument", "ts_us", "trade_id")
    return rows.mapInPandas(run, "instrument string, trade_id string, slice int")
