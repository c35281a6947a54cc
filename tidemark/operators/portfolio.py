"""Positions of independent sides at average cost, their ledger, equity, exit legs, triggers and order groups."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("run_id", "instrument", "side")
#: Which states may follow a state of an order.
ORDER_STATES = {
    "PENDING_NEW": ("NEW", "REJECTED"),
    "NEW": ("PARTIALLY_FILLED", "FILLED", "CANCELED", "EXPIRED"),
    "PARTIALLY_FILLED": ("PARTIALLY_FILLED", "FILLED", "CANCELED", "EXPIRED"),
}
#: Of triggers that one event fires, the first of these kinds wins its group.
PRIORITY = ("STOP", "ENTRY", "TAKE_PROFIT")


def hedged(fills: DataFrame) -> DataFrame:
    """After every fill of a (run_id, instrument, side): quantity, basis and realized, the side at average cost. Sides are independent.

    ``fills``: KEY, ts_us, fill_id, action (increase, decrease), price, quantity (decimals). A full close takes the whole rest of the basis, so
    rounding never leaks; a decrease beyond the open quantity, a null or a quantity not above zero raises. Fills stream through in order: a task holds one
    side's state. Results are decimal(38, 18)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, quantity, basis = None, Decimal(0), Decimal(0)
        for b in batches:
            d = b.to_pydict()
            out = []
            for *key, fill, action, price, size in zip(*[d[c] for c in (*KEY, "fill_id", "action", "price", "quantity")], strict=True):
                if key != who:
                    who, quantity, basis = key, Decimal(0), Decimal(0)
                if price is None or size is None or size <= 0 or action not in ("increase", "decrease"):
                    raise ValueError(f"not a fill: {fill}")
                realized = Decimal(0)
                if action == "increase":
                    quantity, basis = quantity + size, basis + price * size
                elif size > quantity:
                    raise ValueError(f"fill {fill} closes more than is open")
                else:
                    cost = basis if size == quantity else size * (basis / quantity)
                    realized = (price * size - cost) * (1 if key[2] == "long" else -1)
                    quantity, basis = quantity - size, basis - cost
                out.append((quantity, basis, realized))
            exact = lambda i, out=out: pa.array([x[i].quantize(Decimal(1).scaleb(-18)) for x in out], pa.decimal128(38, 18))
            yield pa.record_batch([*b.columns, exact(0), exact(1), exact(2)], [*b.schema.names, "open", "basis", "realized"])

    rows = fills.select(*KEY, "ts_us", "fill_id", "action", F.col("price").cast("decimal(38,18)").alias("price"), F.col("quantity").cast("decimal(38,18)").alias("quantity"))
    dealt = rows.repartition(*KEY).sortWithinPartitions(*KEY, "ts_us", "fill_id")
    return dealt.mapInArrow(run, f"{', '.join(k + ' string' for k in KEY)}, ts_us long, fill_id string, action string, price decimal(38,18), quantity decimal(38,18), open decimal(38,18), basis decimal(38,18), realized decimal(38,18)")


def marked(states: DataFrame, cash: float) -> DataFrame:
    """``states`` of hedged with equity at each fill's price: cash and what was realized so far, plus what is open unrealized (its value is basis + unrealized)."""
    w = Window.partitionBy(*KEY).orderBy("ts_us", "fill_id").rowsBetween(Window.unboundedPreceding, 0)
    x = lambda c: F.col(c).cast("double")
    unrealized = (x("price") * x("open") - x("basis")) * F.when(F.col("side") == "long", 1).otherwise(-1)
    return states.withColumn("unrealized", unrealized).withColumn("equity", cash + F.sum(x("realized")).over(w) + F.col("unrealized"))


def journal(states: DataFrame) -> DataFrame:
    """(KEY, fill_id, account, debit, credit): the balanced lines of every fill; cash against the position at cost, and what was realized. Lines of nothing are left out, but not cash, so a fill at price 0 is a transaction too."""
    x = lambda c: F.col(c).cast("decimal(28,10)")
    notional = (F.col("price") * F.col("quantity")).cast("decimal(28,10)")
    grows, gain = F.col("action") == "increase", x("realized")
    cost = F.when(F.col("side") == "long", notional - gain).otherwise(notional + gain)  # of what a decrease closes
    none = F.lit(0).cast("decimal(28,10)")
    line = lambda account, debit, credit: F.struct(F.lit(account).alias("account"), F.coalesce(debit, none).cast("decimal(28,10)").alias("debit"), F.coalesce(credit, none).cast("decimal(28,10)").alias("credit"))
    into = (F.col("side") == "long") == grows  # money goes into the position: a long that grows or a short that shrinks
    own = F.when(grows, notional).otherwise(cost)
    lines = F.array(line("cash", F.when(~into, notional), F.when(into, notional)), line("position", F.when(into, own), F.when(~into, own)), line("realized", F.when(gain < 0, -gain), F.when(gain > 0, gain)))
    return states.select(*KEY, "fill_id", F.explode(lines).alias("l")).select(*KEY, "fill_id", "l.*").where("account = 'cash' or debit <> 0 or credit <> 0")


def unbalanced(lines: DataFrame) -> DataFrame:
    """(KEY, fill_id, debit, credit, balanced) of every transaction."""
    sums = lines.groupBy(*KEY, "fill_id").agg(F.sum("debit").alias("debit"), F.sum("credit").alias("credit"))
    return sums.withColumn("balanced", F.col("debit") == F.col("credit"))


def leg_check(positions: DataFrame, legs: DataFrame, key: list[str]) -> DataFrame:
    """Per position its open quantity, the sum of its active legs, and whether they fit into it."""
    own = legs.where("active").groupBy(*key).agg(F.sum("quantity").alias("legs"))
    return positions.join(own, key, "left").select(*key, "open", F.coalesce("legs", F.lit(0).cast("double")).alias("legs"), F.coalesce(F.col("legs") <= F.col("open"), F.lit(True)).alias("conserved"))


def fired(path: DataFrame, triggers: DataFrame, by: list[str]) -> DataFrame:
    """(by..., conflict_group, trigger_id, kind, step): the first trigger of each conflict group that the price path crosses.

    ``path`` (by..., step, price) is an ordered walk; ``triggers`` (by..., conflict_group, trigger_id, kind, direction up or down, level). At one step PRIORITY
    decides, then the id; the losers stay pending."""
    hit = F.when(F.col("direction") == "up", F.col("price") >= F.col("level")).otherwise(F.col("price") <= F.col("level"))
    rank = F.array_position(F.array(*[F.lit(k) for k in PRIORITY]), F.col("kind"))
    first = triggers.join(path, by).where(hit).groupBy(*by, "conflict_group", "trigger_id", "kind").agg(F.min("step").alias("step"))
    best = first.groupBy(*by, "conflict_group").agg(F.min(F.struct("step", rank.alias("rank"), "trigger_id", "kind")).alias("x"))
    return best.select(*by, "conflict_group", "x.trigger_id", "x.kind", "x.step")


def cancel_siblings(orders: DataFrame, group: list[str]) -> DataFrame:
    """``orders`` (group..., order_id, status, filled) with ``after``: a fill in a group rejects its pending orders, cancels its resting ones and leaves the final ones."""
    any_fill = F.max(F.col("filled").cast("int")).over(Window.partitionBy(*group)) == 1
    status = F.col("status")
    after = F.when(~any_fill | F.col("filled"), status).when(status == "PENDING_NEW", "REJECTED").when(status.isin("NEW", "PARTIALLY_FILLED"), "CANCELED").otherwise(status)
    return orders.withColumn("after", after)


def fee_rate(instrument: Column, explicit: Column, default: float, known: str = "BTCUSDT") -> Column:
    """The explicit rate; the default one is for the known instrument alone, any other without a rate raises."""
    return F.when(explicit.isNotNull(), explicit).when(instrument == known, F.lit(default)).otherwise(F.raise_error(F.concat(F.lit("no fee rate for "), instrument)).cast("double"))
