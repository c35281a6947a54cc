"""Decisions as columns: signal combination, targets, capital risk, cooldown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def combined(signals: Sequence[Column], how: str) -> Column:
    """ALL or ANY of the signals; a missing one makes it false, also for ANY."""
    there = F.lit(True)
    for s in signals:
        there = there & s.isNotNull()
    found = signals[0]
    for s in signals[1:]:
        found = (found & s) if how == "ALL" else (found | s)
    return F.coalesce(there & found, F.lit(False))


def decision(exit_: Column, enter: Column, side: Column) -> Column:
    """FLAT on an exit, else the side on an entry, else NO_DECISION."""
    return F.when(exit_, "FLAT").when(enter, F.upper(side)).otherwise("NO_DECISION")


def capital_risk(rows: DataFrame, risk_per_trade: float, max_position: float, max_total: float, max_drawdown: float, stale_us: int) -> DataFrame:
    """``rows`` (target, price, equity, peak, exposure: gross, current: net of the instrument, now_us, snapshot_us) with budget and refusal.

    Missing, future or stale snapshots refuse. Reducing (flat, or the same sign and no more than now) passes with what it asks for. Else refused in this order: drawdown,
    position cap, total cap; the budget is the least of the three limits."""
    requested, held = F.abs("target") * F.col("price"), F.abs("current")
    other = F.abs("exposure") - held
    drawdown = (F.col("peak") - F.col("equity")) / F.col("peak")
    reducing = (F.col("target") == 0) | ((F.signum("target") == F.signum("current")) & (requested <= held))
    refusal = (
        F.when(F.col("snapshot_us").isNull(), "missing_snapshot")
        .when(F.col("snapshot_us") > F.col("now_us"), "future_snapshot")
        .when(F.col("now_us") - F.col("snapshot_us") > stale_us, "stale_snapshot")
        .when(reducing, F.lit(None).cast("string"))
        .when(drawdown >= max_drawdown, "max_drawdown")
        .when(requested > F.col("equity") * max_position, "max_position")
        .when(other + requested > F.col("equity") * max_total, "max_total")
    )
    limit = F.least(F.col("equity") * risk_per_trade, F.col("equity") * max_position, F.greatest(F.lit(0.0), F.col("equity") * max_total - other))
    out = rows.withColumn("refusal", refusal)
    return out.withColumn("budget", F.when(F.col("refusal").isNotNull(), 0.0).when(reducing, requested).otherwise(limit))


def cooldown(outcomes: DataFrame, key: Sequence[str], cap: int, loss_us: int, streak: int, streak_us: int, after_us: int) -> DataFrame:
    """For an entry asked ``after_us`` after each settled outcome (opened_us, settled_us, pnl): FREQUENCY_LIMITED, COOLING_DOWN or ALLOWED.

    Counted are outcomes opened on the UTC day of the entry. A loss cools down for ``loss_us``; a row of ``streak`` losses (zeros don't end it) for ``streak_us`` after its last."""
    w = Window.partitionBy(*key).orderBy("settled_us").rowsBetween(Window.unboundedPreceding, 0)
    day = lambda c: F.floor(c / DAY_US)
    asked = F.col("settled_us") + after_us
    rows = outcomes.withColumn("asked_us", asked).withColumn("era", F.sum(F.when(F.col("pnl") > 0, 1).otherwise(0)).over(w))
    rows = rows.withColumn("last_loss", F.max(F.when(F.col("pnl") < 0, F.col("settled_us"))).over(w))
    rows = rows.withColumn("losses", F.sum(F.when(F.col("pnl") < 0, 1).otherwise(0)).over(Window.partitionBy(*key, "era").orderBy("settled_us").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("today", F.count("*").over(Window.partitionBy(*key, day(F.col("opened_us"))).orderBy("settled_us").rowsBetween(Window.unboundedPreceding, 0)))
    today = F.when(day(F.col("opened_us")) == day(F.col("asked_us")), F.col("today")).otherwise(0)
    until = F.greatest(F.col("last_loss") + loss_us, F.when(F.col("losses") >= streak, F.col("last_loss") + streak_us))
    return rows.withColumn("status", F.when(today >= cap, "FREQUENCY_LIMITED").when(until > F.col("asked_us"), "COOLING_DOWN").otherwise("ALLOWED")).drop("era", "today")
