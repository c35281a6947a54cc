"""Registered queries over fills, orders and decisions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage, policies, portfolio, representation, simulation
from .market import DAY, HOUR, T, bars_sql, query, table, trades

#: A first fill of each side, so that later decreases find something open.
SEED = 99_991


def _fills(spark, sf_dir):
    """Buys increase the long side and sells take one from it; on the short side it is the other way round."""
    t = trades(spark, sf_dir).select(F.lit("run").alias("run_id"), "instrument", "ts_us", "trade_id", "aggressor_side", "price", "size")
    side = lambda s, grow: t.select("run_id", "instrument", F.lit(s).alias("side"), "ts_us", F.lpad("trade_id", 12, "0").alias("fill_id"), F.when(F.col("aggressor_side") == grow, "increase").otherwise("decrease").alias("action"), "price", F.when(F.col("aggressor_side") == grow, F.col("size")).otherwise(1).cast("decimal(18,2)").alias("quantity"))
    both = side("long", "buy").unionByName(side("short", "sell"))
    first = both.select("run_id", "instrument", "side").distinct().select("*", F.lit(0).cast("long").alias("ts_us"), F.lit("first").alias("fill_id"), F.lit("increase").alias("action"), F.lit(100).cast("decimal(18,2)").alias("price"), F.lit(SEED).cast("decimal(18,2)").alias("quantity"))
    return both.unionByName(first)


FILLS = f"""f0 AS (SELECT instrument, 'long' AS side, ts_us, lpad(trade_id, 12, '0') AS fill_id, aggressor_side = 'buy' AS grow, price::DOUBLE AS price, CASE WHEN aggressor_side = 'buy' THEN size ELSE 1 END::DOUBLE AS q FROM t
UNION ALL SELECT instrument, 'short', ts_us, lpad(trade_id, 12, '0'), aggressor_side = 'sell', price::DOUBLE, CASE WHEN aggressor_side = 'sell' THEN size ELSE 1 END::DOUBLE FROM t),
f AS (SELECT * FROM f0 UNION ALL SELECT DISTINCT instrument, side, 0, 'first', true, 100.0, {SEED}.0 FROM f0), n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY instrument, side ORDER BY ts_us, fill_id) AS n FROM f),
st AS (SELECT instrument, side, ts_us, fill_id, n, grow, price, q, q AS open, price * q AS basis, 0.0::DOUBLE AS realized FROM n WHERE n = 1
UNION ALL SELECT n.instrument, n.side, n.ts_us, n.fill_id, n.n, n.grow, n.price, n.q, CASE WHEN n.grow THEN st.open + n.q ELSE st.open - n.q END, CASE WHEN n.grow THEN st.basis + n.price * n.q ELSE st.basis - n.q * (st.basis / st.open) END,
CASE WHEN n.grow THEN 0.0 ELSE (n.price * n.q - n.q * (st.basis / st.open)) * CASE WHEN n.side = 'long' THEN 1 ELSE -1 END END FROM st JOIN n ON n.instrument = st.instrument AND n.side = st.side AND n.n = st.n + 1)"""


@query(f"WITH RECURSIVE {T}, {FILLS} SELECT instrument, side, fill_id, round(open, 4) AS open, round(basis, 2) AS basis, round(realized, 3) AS realized FROM st")
def hedge_positions(spark, sf_dir):
    out = portfolio.hedged(_fills(spark, sf_dir))
    return out.select("instrument", "side", "fill_id", *[F.round(F.col(c).cast("double"), d).alias(c) for c, d in (("open", 4), ("basis", 2), ("realized", 3))])


@query(f"""WITH RECURSIVE {T}, {FILLS} SELECT instrument, side, fill_id, round(10000 + sum(realized) OVER (PARTITION BY instrument, side ORDER BY n) + (price * open - basis) * CASE WHEN side = 'long' THEN 1 ELSE -1 END, 2) AS equity FROM st""")
def mark_to_market(spark, sf_dir):
    return portfolio.marked(portfolio.hedged(_fills(spark, sf_dir)), 10_000.0).select("instrument", "side", "fill_id", F.round("equity", 2).alias("equity"))


@query(f"""WITH RECURSIVE {T}, {FILLS} SELECT instrument, side, fill_id, round(price * q + greatest(CASE WHEN side = 'long' THEN -realized ELSE realized END, 0), 2) AS debit, true AS balanced FROM st""")
def trial_balance(spark, sf_dir):
    lines = portfolio.journal(portfolio.hedged(_fills(spark, sf_dir)))
    return portfolio.unbalanced(lines).select("instrument", "side", "fill_id", F.round(F.col("debit").cast("double"), 2).alias("debit"), "balanced")


@query("""WITH l AS (SELECT l_orderkey AS o_orderkey, sum(l_quantity) AS legs FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) SELECT o.o_orderkey, floor(o_totalprice / 1000) AS open, coalesce(legs, 0) AS legs, coalesce(legs <= floor(o_totalprice / 1000), true) AS conserved FROM orders o LEFT JOIN l ON l.o_orderkey = o.o_orderkey""")
def leg_conservation(spark, sf_dir):
    positions = table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 1000).cast("double").alias("open"))
    legs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").alias("quantity"), (F.col("l_linestatus") == "O").alias("active"))
    return portfolio.leg_check(positions, legs, ["o_orderkey"])


_STATES = ("NEW", "PARTIALLY_FILLED", "FILLED", "CANCELED", "REJECTED", "EXPIRED")


@query(f"""WITH e AS (SELECT user_id, event_id, [{', '.join(f"'{s}'" for s in _STATES)}][1 + event_id % 6] AS status FROM events), p AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY user_id ORDER BY event_id), 'PENDING_NEW') AS previous FROM e)
SELECT user_id, event_id, status, previous, CASE WHEN previous = 'PENDING_NEW' THEN status IN ('NEW', 'REJECTED') WHEN previous = 'NEW' THEN status IN ('PARTIALLY_FILLED', 'FILLED', 'CANCELED', 'EXPIRED')
WHEN previous = 'PARTIALLY_FILLED' THEN status IN ('PARTIALLY_FILLED', 'FILLED', 'CANCELED', 'EXPIRED') ELSE false END AS legal FROM p""")
def order_transitions(spark, sf_dir):
    status = F.get(F.array(*[F.lit(s) for s in _STATES]), (F.col("event_id") % 6).cast("int"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", status.alias("status"))
    return coverage.transitions(rows, ["user_id"], ["event_id"], "status", "PENDING_NEW", portfolio.ORDER_STATES)


@query("""WITH e AS (SELECT *, lag(life) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN 'FINAL' ELSE 'PROVISIONAL' END AS life FROM events))
SELECT user_id, event_id, life, coalesce(p, 'PROVISIONAL') AS previous, coalesce(p, 'PROVISIONAL') <> 'FINAL' AS legal FROM e""")
def observation_lifecycle(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", "FINAL").otherwise("PROVISIONAL").alias("life"))
    return coverage.transitions(rows, ["user_id"], ["event_id"], "life", "PROVISIONAL", {"PROVISIONAL": ("PROVISIONAL", "FINAL")})


_TRIGGERS = (("a", "stop", "STOP", "down", 0.7), ("a", "take", "TAKE_PROFIT", "up", 1.3), ("a", "enter", "ENTRY", "up", 1.3), ("b", "deep", "STOP", "down", 0.5))


@query(f"""WITH {T}, {bars_sql(DAY)}, p AS (SELECT instrument, ts_us - ts_us % {DAY} AS bucket_us, row_number() OVER (PARTITION BY instrument, ts_us // {DAY} ORDER BY ts_us, trade_id) AS step, price::DOUBLE AS price FROM t),
g AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}', '{c}', '{d}', {e})" for a, b, c, d, e in _TRIGGERS)}) v(grp, id, kind, dir, f)),
h AS (SELECT b.instrument, b.bucket_us, grp, id, kind, min(step) AS step FROM b, g, p WHERE p.instrument = b.instrument AND p.bucket_us = b.bucket_us AND CASE WHEN dir = 'up' THEN p.price >= b.open::DOUBLE * f ELSE p.price <= b.open::DOUBLE * f END GROUP BY 1, 2, 3, 4, 5)
SELECT instrument, bucket_us, grp AS conflict_group, id AS trigger_id, kind, step FROM h QUALIFY row_number() OVER (PARTITION BY instrument, bucket_us, grp ORDER BY step, CASE kind WHEN 'STOP' THEN 1 WHEN 'ENTRY' THEN 2 ELSE 3 END, id) = 1""")
def intrabar_triggers(spark, sf_dir):
    from pyspark.sql import Window

    t = trades(spark, sf_dir).withColumn("bucket_us", F.col("ts_us") - F.col("ts_us") % DAY)
    w = Window.partitionBy("instrument", "bucket_us").orderBy("ts_us", "trade_id")
    path = t.select("instrument", "bucket_us", F.row_number().over(w).cast("long").alias("step"), F.col("price").cast("double").alias("price"))
    kinds = spark.createDataFrame(_TRIGGERS, "conflict_group string, trigger_id string, kind string, direction string, factor double")
    bars = representation.candles(trades(spark, sf_dir), DAY).select("instrument", "bucket_us", F.col("open").cast("double").alias("open"))
    triggers = bars.crossJoin(F.broadcast(kinds)).withColumn("level", F.col("open") * F.col("factor")).drop("open", "factor")  # a fixed list of four
    return portfolio.fired(path, triggers, ["instrument", "bucket_us"])


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 4 WHEN 0 THEN 'PENDING_NEW' WHEN 1 THEN 'NEW' WHEN 2 THEN 'PARTIALLY_FILLED' ELSE 'EXPIRED' END AS status, l_partkey % 7 = 1 AS filled FROM lineitem), f AS (SELECT *, max(filled::INTEGER) OVER (PARTITION BY l_orderkey) = 1 AS hit FROM o)
SELECT l_orderkey, l_linenumber, l_partkey, status, CASE WHEN NOT hit OR filled THEN status WHEN status = 'PENDING_NEW' THEN 'REJECTED' WHEN status IN ('NEW', 'PARTIALLY_FILLED') THEN 'CANCELED' ELSE status END AS "after" FROM f""")
def oco_groups(spark, sf_dir):
    k = F.col("l_partkey")
    status = F.get(F.array(*[F.lit(s) for s in ("PENDING_NEW", "NEW", "PARTIALLY_FILLED", "EXPIRED")]), (k % 4).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", status.alias("status"), (k % 7 == 1).alias("filled"))
    return portfolio.cancel_siblings(rows, ["l_orderkey"]).drop("filled")


@query(f"""WITH {T}, x AS (SELECT *, CASE WHEN trade_id::BIGINT % 3 = 0 THEN 4.0 ELSE 5.5 END AS rate FROM t), y AS (SELECT *, price::DOUBLE * CASE WHEN aggressor_side = 'buy' THEN 10002 ELSE 9998 END / 10000 AS paid FROM x)
SELECT trade_id, round(paid, 6) AS paid, round(paid * size::DOUBLE * rate / 10000, 6) AS fee, round((110 - price::DOUBLE) * size::DOUBLE * CASE WHEN aggressor_side = 'buy' THEN 1 ELSE -1 END, 6) AS unrealized FROM y""")
def fill_costs(spark, sf_dir):
    """Buys open longs and sells shorts, marked at 110; every third fill has a rate of its own."""
    x = lambda c: F.col(c).cast("double")
    explicit = F.when(F.col("trade_id").cast("long") % 3 == 0, 4.0)
    t = trades(spark, sf_dir).withColumn("rate", portfolio.fee_rate(F.lit("BTCUSDT"), explicit, 5.5)).withColumn("paid", simulation.slipped(x("price"), F.col("aggressor_side"), F.lit(2)))
    side = F.when(F.col("aggressor_side") == "buy", "long").otherwise("short")
    gain = simulation.unrealized(side, F.lit(110.0), x("size"), x("price") * x("size"))
    return t.select("trade_id", F.round("paid", 6).alias("paid"), F.round(simulation.fee(F.col("paid"), x("size"), F.col("rate")), 6).alias("fee"), F.round(gain, 6).alias("unrealized"))


@query(f"""WITH {T}, {bars_sql(HOUR)}, s AS (SELECT *, CASE WHEN trade_count % 4 <> 0 THEN close > open END AS a, CASE WHEN trade_count % 3 <> 0 THEN taker_buy_volume > taker_sell_volume END AS z FROM b)
SELECT instrument, bucket_us, a IS NOT NULL AND z IS NOT NULL AND a AND z AS all_of, a IS NOT NULL AND z IS NOT NULL AND (a OR z) AS any_of, CASE WHEN high - low > 300 THEN 'FLAT' WHEN a IS NOT NULL AND z IS NOT NULL AND (a OR z) THEN CASE WHEN close > open THEN 'LONG' ELSE 'SHORT' END ELSE 'NO_DECISION' END AS decision FROM s""")
def strategy_decisions(spark, sf_dir):
    bars = representation.bar_flow(trades(spark, sf_dir), HOUR)
    a = F.when(F.col("trade_count") % 4 != 0, F.col("close") > F.col("open"))
    z = F.when(F.col("trade_count") % 3 != 0, F.col("taker_buy_volume") > F.col("taker_sell_volume"))
    any_of = policies.combined([a, z], "ANY")
    side = F.when(F.col("close") > F.col("open"), "long").otherwise("short")
    return bars.select("instrument", "bucket_us", policies.combined([a, z], "ALL").alias("all_of"), any_of.alias("any_of"), policies.decision(F.col("high") - F.col("low") > 300, any_of, side).alias("decision"))


_RISK = """r AS (SELECT o_orderkey, (o_orderkey % 21 - 10)::DOUBLE AS target, (10 + o_orderkey % 90)::DOUBLE AS price, 10000.0 - o_orderkey % 3000 AS equity, 10000.0 AS peak, (o_orderkey % 7 * 400)::DOUBLE AS exposure, (o_orderkey % 7 * 100 * CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS current,
1000 AS now_us, CASE o_orderkey % 23 WHEN 0 THEN NULL WHEN 1 THEN 1001 WHEN 2 THEN 100 ELSE 900 END AS snapshot_us FROM orders),
x AS (SELECT *, abs(target) * price AS requested, abs(current) AS held, abs(exposure) - abs(current) AS other FROM r),
y AS (SELECT *, target = 0 OR (sign(target) = sign(current) AND requested <= held) AS reducing FROM x),
z AS (SELECT *, CASE WHEN snapshot_us IS NULL THEN 'missing_snapshot' WHEN snapshot_us > now_us THEN 'future_snapshot' WHEN now_us - snapshot_us > 500 THEN 'stale_snapshot' WHEN reducing THEN NULL
WHEN (peak - equity) / peak >= 0.25 THEN 'max_drawdown' WHEN requested > equity * 0.08 THEN 'max_position' WHEN other + requested > equity * 0.2 THEN 'max_total' END AS refusal FROM y),
b AS (SELECT *, CASE WHEN refusal IS NOT NULL THEN 0 WHEN reducing THEN requested ELSE least(equity * 0.02, equity * 0.08, greatest(0, equity * 0.2 - other)) END AS budget FROM z)"""


@query(f"""WITH {_RISK}, q AS (SELECT *, floor(least(abs(target), budget / price, 8) / 0.5) * 0.5 AS size FROM b) SELECT o_orderkey, refusal, round(budget, 6) AS budget, CASE WHEN size < 1 THEN 0.0 ELSE size END::DOUBLE AS size FROM q""")
def risk_and_sizing(spark, sf_dir):
    k = F.col("o_orderkey")
    n = lambda c: c.cast("double")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", n(k % 21 - 10).alias("target"), n(10 + k % 90).alias("price"), n(10_000 - k % 3000).alias("equity"), F.lit(10_000.0).alias("peak"), n(k % 7 * 400).alias("exposure"), n(k % 7 * 100 * F.when(k % 2 == 0, 1).otherwise(-1)).alias("current"),
        F.lit(1000).alias("now_us"), F.when(k % 23 == 0, None).when(k % 23 == 1, 1001).when(k % 23 == 2, 100).otherwise(900).alias("snapshot_us"),
    )
    out = policies.capital_risk(rows, 0.02, 0.08, 0.2, 0.25, 500)
    size = simulation.sized(F.col("target"), F.col("budget"), F.col("price"), F.lit(8.0), F.lit(1.0), F.lit(0.5))
    return out.select("o_orderkey", "refusal", F.round("budget", 6).alias("budget"), size.cast("double").alias("size"))


@query(f"""WITH {T}, {bars_sql(HOUR)}, o AS (SELECT instrument, bucket_us AS opened_us, bucket_us + {HOUR} AS settled_us, (close - open)::DOUBLE AS pnl FROM b),
x AS (SELECT *, settled_us + 60000000 AS asked_us, sum(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) OVER w AS era, max(CASE WHEN pnl < 0 THEN settled_us END) OVER w AS last_loss, row_number() OVER (PARTITION BY instrument, opened_us // {DAY} ORDER BY settled_us) AS today FROM o WINDOW w AS (PARTITION BY instrument ORDER BY settled_us)),
y AS (SELECT *, sum(CASE WHEN pnl < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY instrument, era ORDER BY settled_us) AS losses FROM x)
SELECT instrument, opened_us, pnl, CASE WHEN CASE WHEN opened_us // {DAY} = asked_us // {DAY} THEN today ELSE 0 END >= 18 THEN 'FREQUENCY_LIMITED'
WHEN greatest(last_loss + 30000000, CASE WHEN losses >= 3 THEN last_loss + {2 * HOUR} END) > asked_us THEN 'COOLING_DOWN' ELSE 'ALLOWED' END AS status FROM y""")
def cooldown_states(spark, sf_dir):
    bars = representation.candles(trades(spark, sf_dir), HOUR)
    outcomes = bars.select("instrument", F.col("bucket_us").alias("opened_us"), (F.col("bucket_us") + HOUR).alias("settled_us"), (F.col("close") - F.col("open")).cast("double").alias("pnl"))
    return policies.cooldown(outcomes, ["instrument"], 18, 30_000_000, 3, 2 * HOUR, 60_000_000).select("instrument", "opened_us", "pnl", "status")


SLICES = f"""n AS MATERIALIZED (SELECT instrument, ts_us, trade_id, row_number() OVER (PARTITION BY instrument ORDER BY ts_us, trade_id) AS n FROM t),
st AS (SELECT instrument, trade_id, n, ts_us, ts_us AS began, 1 AS held, 0 AS slice FROM n WHERE n = 1 UNION ALL
SELECT x.instrument, x.trade_id, x.n, x.ts_us, CASE WHEN x.cut THEN x.ts_us ELSE x.began END, CASE WHEN x.cut THEN 1 ELSE x.held + 1 END, CASE WHEN x.cut THEN x.slice + 1 ELSE x.slice END FROM
(SELECT n.*, st.began, st.held, st.slice, n.ts_us <> st.ts_us AND (st.held >= 200 OR n.ts_us - st.began >= 21600000000 OR n.ts_us // {DAY} <> st.began // {DAY}) AS cut FROM st JOIN n ON n.instrument = st.instrument AND n.n = st.n + 1) x)"""


@query(f"WITH RECURSIVE {T}, {SLICES} SELECT instrument, trade_id, slice::INTEGER AS slice FROM st")
def live_slices(spark, sf_dir):
    return simulation.slices(trades(spark, sf_dir), 200, 6 * 3600)
