"""Order books: level changes, continuity segments, state at an instant."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def levels(events: DataFrame) -> DataFrame:
    """One row for each level change of events (instrument, seq, ts_us, event_type, bids, asks: arrays of (price, size)).

    A size of 0 deletes the level."""
    side = lambda c, s: events.select("instrument", "seq", "ts_us", "event_type", F.lit(s).alias("side"), F.posexplode(c).alias("pos", "level"))
    rows = side("bids", "bid").unionByName(side("asks", "ask"))
    price, size = F.col("level.price").cast("decimal(38,18)"), F.col("level.size").cast("decimal(38,18)")
    return rows.select("instrument", "seq", "ts_us", "event_type", "side", "pos", price.alias("price"), size.alias("size"), F.when(size == 0, "delete").otherwise("upsert").alias("action"))


def segments(events: DataFrame) -> DataFrame:
    """Adds ``segment`` (a number from 1; 0 before any snapshot) and ``anchored``: a snapshot opens a segment, and a delta whose
    ``update_id`` doesn't follow the one before leaves the rest of its segment without an anchor."""
    w = Window.partitionBy("instrument").orderBy("seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    snap = F.col("event_type") == "snapshot"
    rows = events.withColumn("segment", F.sum(F.when(snap, 1).otherwise(0)).over(upto))
    broken = ~snap & ~F.col("update_id").eqNullSafe(F.lag("update_id").over(w) + 1)
    rows = rows.withColumn("broken", F.when(broken, 1).otherwise(0))
    own = Window.partitionBy("instrument", "segment").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("anchored", (F.col("segment") > 0) & (F.sum("broken").over(own) == 0)).drop("broken")


def state_at(events: DataFrame, by: list[str]) -> DataFrame:
    """The last size of every price that was not deleted since the last snapshot, which begins the book anew: (by..., side, price, size). No book without a snapshot."""
    since = events.where("event_type = 'snapshot'").groupBy(*by).agg(F.max("seq").alias("since"))
    changes = levels(events.join(since, by).where("seq >= since").drop("since"))
    last = changes.groupBy(*by, "side", "price").agg(F.max_by(F.struct("action", "size"), F.struct("seq", "pos")).alias("x"))
    return last.where("x.action = 'upsert'").select(*by, "side", "price", F.col("x.size").alias("size"))


def best(state: DataFrame, by: list[str]) -> DataFrame:
    """Best bid and ask, and whether the book is crossed."""
    bid, ask = F.max(F.when(F.col("side") == "bid", F.col("price"))), F.min(F.when(F.col("side") == "ask", F.col("price")))
    return state.groupBy(*by).agg(bid.alias("best_bid"), ask.alias("best_ask")).withColumn("crossed", F.coalesce(F.col("best_bid") >= F.col("best_ask"), F.lit(False)))


def day_measure(events: DataFrame, by: list[str]) -> DataFrame:
    """By ``by`` and UTC day: events, snapshots, level changes, segments begun, events without an anchor, most levels of an event, first and last instant."""
    rows = segments(events).withColumn("day", F.floor(F.col("ts_us") / 86_400_000_000))
    width = F.size("bids") + F.size("asks")
    return rows.groupBy(*by, "day").agg(
        F.count("*").alias("events"),
        F.count_if(F.col("event_type") == "snapshot").alias("snapshots"),
        F.sum(width).alias("changes"),
        F.count_if(~F.col("anchored")).alias("unanchored"),
        F.max(width).alias("widest"),
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
    )


def replayable(events: DataFrame, by: list[str]) -> DataFrame:
    """(by..., replayable): whether the first event by sequence is a snapshot."""
    return events.groupBy(*by).agg((F.min_by("event_type", "seq") == "snapshot").alias("replayable"))


_PAIRS = "array<array<string>>"
_LEVELS = "array<struct<price:string,size:string,action:string>>"


def _level(price: str, size: str) -> str:
    """SQL: one level; a size of zero deletes it and is written 0."""
    return f"named_struct('price', {price}, 'size', if(cast({size} as decimal(38,18)) = 0, '0', {size}), 'action', if(cast({size} as decimal(38,18)) = 0, 'delete', 'upsert'))"


def _pairs(column: str) -> str:
    return f"transform(coalesce({column}, cast(array() as {_PAIRS})), x -> {_level('x[0]', 'x[1]')})"


#: The venues' message schemas, and SQL for the common columns over the parsed message ``m``.
VENUES = {
    "bybit": (
        f"type string, ts bigint, cts bigint, data struct<s:string,b:{_PAIRS},a:{_PAIRS},u:bigint,seq:bigint>",
        {"instrument": "m.data.s", "event_type": "m.type", "exchange_ms": "m.cts", "provider_ms": "m.ts", "bids": _pairs("m.data.b"), "asks": _pairs("m.data.a"), "update_id": "m.data.u", "previous_id": "cast(null as bigint)", "token": "cast(m.data.seq as string)"},
    ),
    "okx": (
        f"arg struct<instId:string>, action string, data array<struct<asks:{_PAIRS},bids:{_PAIRS},ts:string,seqId:bigint,prevSeqId:bigint,checksum:bigint>>",
        {"instrument": "m.arg.instId", "event_type": "if(m.action = 'snapshot', 'snapshot', 'delta')", "exchange_ms": "cast(m.data[0].ts as bigint)", "provider_ms": "cast(null as bigint)", "bids": _pairs("m.data[0].bids"), "asks": _pairs("m.data[0].asks"), "update_id": "m.data[0].seqId", "previous_id": "m.data[0].prevSeqId", "token": "cast(m.data[0].checksum as string)"},
    ),
    "binance_diff": (
        "map<string,string>",  # the names differ in case alone, which columns can't
        {"instrument": "m['s']", "event_type": "'delta'", "exchange_ms": "cast(coalesce(m['T'], m['E']) as bigint)", "provider_ms": "cast(m['E'] as bigint)", "bids": _pairs(f"from_json(m['b'], '{_PAIRS}')"), "asks": _pairs(f"from_json(m['a'], '{_PAIRS}')"), "update_id": "cast(m['u'] as bigint)", "previous_id": "cast(m['pu'] as bigint)", "token": "m['U']"},
    ),
    "binance_snapshot": (
        f"lastUpdateId bigint, bids {_PAIRS}, asks {_PAIRS}",
        {"instrument": "given_instrument", "event_type": "'snapshot'", "exchange_ms": "given_ms", "provider_ms": "cast(null as bigint)", "bids": _pairs("m.bids"), "asks": _pairs("m.asks"), "update_id": "m.lastUpdateId", "previous_id": "cast(null as bigint)", "token": "cast(null as string)"},
    ),
    "kraken": (
        "type string, data array<struct<symbol:string,bids:array<struct<price:string,qty:string>>,asks:array<struct<price:string,qty:string>>,checksum:bigint,timestamp:string>>",
        {"instrument": "m.data[0].symbol", "event_type": "if(m.type = 'snapshot', 'snapshot', 'delta')", "exchange_ms": "unix_millis(to_timestamp(m.data[0].timestamp))", "provider_ms": "cast(null as bigint)", "bids": f"transform(m.data[0].bids, x -> {_level('x.price', 'x.qty')})", "asks": f"transform(m.data[0].asks, x -> {_level('x.price', 'x.qty')})", "update_id": "cast(null as bigint)", "previous_id": "cast(null as bigint)", "token": "cast(m.data[0].checksum as string)"},
    ),
    "coinbase": (
        f"type string, product_id string, time string, bids {_PAIRS}, asks {_PAIRS}, changes {_PAIRS}",
        {"instrument": "m.product_id", "event_type": "if(m.type = 'snapshot', 'snapshot', 'delta')", "exchange_ms": "unix_millis(to_timestamp(m.time))", "provider_ms": "cast(null as bigint)", **{name: f"if(m.type = 'snapshot', {_pairs('m.' + name)}, transform(filter(m.changes, x -> x[0] = '{way}'), x -> {_level('x[1]', 'x[2]')}))" for name, way in (("bids", "buy"), ("asks", "sell"))}, "update_id": "cast(null as bigint)", "previous_id": "cast(null as bigint)", "token": "cast(null as string)"},
    ),
}


def normalized(messages: DataFrame, venue: str) -> DataFrame:
    """Order-book events of a venue's messages (message: JSON text; binance_snapshot also given_instrument, given_ms): venue, instrument, event_type, exchange_ms, provider_ms, bids, asks
    (price, size, action; a size of zero deletes the level), update_id, previous_id, token. A message without instrument, kind or instant raises."""
    schema, columns = VENUES[venue]
    rows = messages.withColumn("m", F.from_json("message", schema)).select(F.lit(venue).alias("venue"), *[F.expr(sql).alias(name) for name, sql in columns.items()])
    whole = F.col("instrument").isNotNull() & F.col("event_type").isin("snapshot", "delta") & F.col("exchange_ms").isNotNull()
    return rows.where(F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit(f"not a {venue} book message")).cast("boolean")))
