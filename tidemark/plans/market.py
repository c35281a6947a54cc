"""The registered market-data queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.checks import order_violations
from ..functions.instants import bucket_floor, format_ns
from ..functions.scalars import ratio
from ..operators import book, features, intervals, learning, merging, operations, representation, research, validation

HOUR, DAY = 3_600_000_000, 86_400_000_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as trades."""
    return table(spark, sf_dir, "events").select(
        F.lit("sim").alias("venue"),
        F.concat(F.lit("U"), (F.col("user_id") % 5).cast("string")).alias("instrument"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.col("event_id").cast("string").alias("trade_id"),
        F.col("value").cast("decimal(18,2)").alias("price"),
        (1 + F.col("event_id") % 7).cast("decimal(18,2)").alias("size"),
        F.when(F.col("event_type").isin("purchase", "click"), "buy").otherwise("sell").alias("aggressor_side"),
    )


T = """t AS (SELECT 'sim' venue, 'U' || CAST(user_id % 5 AS VARCHAR) instrument, epoch_us(ts) ts_us, CAST(event_id AS VARCHAR) trade_id,
  CAST(value AS DECIMAL(18,2)) price, CAST(1 + event_id % 7 AS DECIMAL(18,2)) size,
  CASE WHEN event_type IN ('purchase','click') THEN 'buy' ELSE 'sell' END aggressor_side FROM events)"""


def bars_sql(width: int) -> str:
    return f"""b AS (SELECT instrument, ts_us - (ts_us % {width}) AS bucket_us, arg_min(price, (ts_us, trade_id)) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, (ts_us, trade_id)) AS close, sum(size) AS volume, count(*) AS trade_count,
  sum(CASE WHEN aggressor_side = 'buy' THEN size ELSE 0 END) AS taker_buy_volume, sum(CASE WHEN aggressor_side = 'sell' THEN size ELSE 0 END) AS taker_sell_volume
  FROM t GROUP BY 1, 2)"""


def doubles(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n in names})


OHLCV = ("open", "high", "low", "close", "volume")
_dbl = lambda *names: ", ".join(f"{n}::DOUBLE AS {n}" for n in names)


@query(f"WITH {T}, {bars_sql(HOUR)} SELECT instrument, bucket_us, {_dbl(*OHLCV)}, trade_count FROM b")
def candles_1h(spark, sf_dir):
    return doubles(representation.candles(trades(spark, sf_dir), HOUR), *OHLCV)


@query(f"WITH {T}, {bars_sql(HOUR)} SELECT instrument, bucket_us, {_dbl(*OHLCV, 'taker_buy_volume', 'taker_sell_volume')}, trade_count FROM b")
def bar_flow_1h(spark, sf_dir):
    return doubles(representation.bar_flow(trades(spark, sf_dir), HOUR), *OHLCV, "taker_buy_volume", "taker_sell_volume")


FOOT = f"""f AS (SELECT instrument, ts_us - (ts_us % {HOUR}) AS bucket_us, floor(price / 10)::BIGINT AS level,
  sum(CASE WHEN aggressor_side = 'buy' THEN size ELSE 0 END) AS buy_volume, sum(CASE WHEN aggressor_side = 'sell' THEN size ELSE 0 END) AS sell_volume FROM t GROUP BY 1, 2, 3)"""


def _cells(spark, sf_dir):
    grid = trades(spark, sf_dir).withColumn("price", (F.floor(F.col("price") / 10) * 10).cast("decimal(18,2)"))
    return representation.footprint(grid, HOUR, "10.00")


@query(f"""WITH {T}, {FOOT}, s AS (SELECT instrument, unnest(range(min(bucket_us), max(bucket_us) + 1, {HOUR})) AS bucket_us FROM f GROUP BY 1)
SELECT s.instrument, s.bucket_us, coalesce(f.level, -1) AS level, {_dbl('buy_volume', 'sell_volume')} FROM s LEFT JOIN f ON s.instrument = f.instrument AND s.bucket_us = f.bucket_us""")
def footprint_1h(spark, sf_dir):
    return doubles(_cells(spark, sf_dir), "buy_volume", "sell_volume").withColumn("level", F.coalesce("level", F.lit(-1).cast("long")))  # -1: no trades


_RATIO = "CASE WHEN {o} IS NULL THEN 'NaN'::DOUBLE WHEN {o} = 0 THEN CASE WHEN {x} > 0 THEN 'inf'::DOUBLE ELSE 0 END ELSE {x}::DOUBLE / {o}::DOUBLE END"
DIAG = f"""d0 AS (SELECT f.*, {_RATIO.format(x='f.buy_volume', o='p.sell_volume')} AS ask_ratio, {_RATIO.format(x='f.sell_volume', o='n.buy_volume')} AS bid_ratio
  FROM f LEFT JOIN f p ON p.instrument = f.instrument AND p.bucket_us = f.bucket_us AND p.level = f.level - 1
  LEFT JOIN f n ON n.instrument = f.instrument AND n.bucket_us = f.bucket_us AND n.level = f.level + 1),
d1 AS (SELECT *, NOT isnan(ask_ratio) AND ask_ratio >= 1.5 AND buy_volume > 0 AS a, NOT isnan(bid_ratio) AND bid_ratio >= 1.5 AND sell_volume > 0 AS z FROM d0),
d AS (SELECT *, CASE WHEN a AND z THEN CASE WHEN ask_ratio >= bid_ratio THEN 'ask' ELSE 'bid' END WHEN a THEN 'ask' WHEN z THEN 'bid' END AS side FROM d1)"""


@query(f"""WITH {T}, {FOOT}, {DIAG} SELECT instrument, bucket_us, level, side, CASE WHEN isnan(ask_ratio) THEN -1 WHEN isinf(ask_ratio) THEN -2 ELSE round(ask_ratio, 9) END AS ask_ratio,
CASE WHEN isnan(bid_ratio) THEN -1 WHEN isinf(bid_ratio) THEN -2 ELSE round(bid_ratio, 9) END AS bid_ratio, (buy_volume - sell_volume)::DOUBLE AS delta FROM d""")
def diagonal_imbalance(spark, sf_dir):
    out = features.diagonal_imbalance(_cells(spark, sf_dir), 1.5)
    plain = lambda c: F.when(F.isnan(c), -1.0).when(F.col(c) == float("inf"), -2.0).otherwise(F.round(c, 9)).alias(c)
    return out.select("instrument", "bucket_us", "level", "side", plain("ask_ratio"), plain("bid_ratio"), F.col("delta").cast("double").alias("delta"))


@query(f"""WITH {T}, {FOOT}, {DIAG},
r AS (SELECT *, CASE WHEN side IS NOT NULL AND side IS NOT DISTINCT FROM lag(side) OVER w AND level IS NOT DISTINCT FROM lag(level) OVER w + 1 THEN 0 ELSE 1 END AS brk FROM d WINDOW w AS (PARTITION BY instrument, bucket_us ORDER BY level)),
g AS (SELECT *, sum(brk) OVER (PARTITION BY instrument, bucket_us ORDER BY level) AS grp FROM r),
n AS (SELECT *, count(*) OVER (PARTITION BY instrument, bucket_us, grp) AS n FROM g)
SELECT instrument, bucket_us, level, side, side IS NOT NULL AND n >= 2 AS stacked, CASE WHEN side IS NOT NULL AND n >= 2 THEN n ELSE 0 END AS run_length FROM n""")
def stacked_imbalance(spark, sf_dir):
    out = features.stacked_imbalance(features.diagonal_imbalance(_cells(spark, sf_dir), 1.5), 2)
    return out.select("instrument", "bucket_us", "level", "side", "stacked", "run_length")


@query(f"""WITH {T}, {bars_sql(HOUR)} SELECT instrument, bucket_us, (CASE
WHEN taker_buy_volume - taker_sell_volume >= 0.3 * (taker_buy_volume + taker_sell_volume) AND high - greatest(open, close) > 0.5 * (high - low) AND close < open THEN 1
WHEN taker_sell_volume - taker_buy_volume >= 0.3 * (taker_buy_volume + taker_sell_volume) AND least(open, close) - low > 0.5 * (high - low) AND close > open THEN -1 ELSE 0 END)::INTEGER AS signal FROM b""")
def failed_aggression(spark, sf_dir):
    return features.failed_aggression(representation.bar_flow(trades(spark, sf_dir), HOUR)).select("instrument", "bucket_us", "signal")


@query(f"""WITH {T}, {bars_sql(HOUR)} SELECT instrument, bucket_us, close::DOUBLE AS close, coalesce(close > max(close) OVER w, false) AS breaks_up, coalesce(close < min(close) OVER w, false) AS breaks_down
FROM b WINDOW w AS (PARTITION BY instrument ORDER BY bucket_us ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def donchian_breakout(spark, sf_dir):
    out = features.donchian_breakout(representation.candles(trades(spark, sf_dir), HOUR), 20)
    return doubles(out.select("instrument", "bucket_us", "close", "breaks_up", "breaks_down"), "close")


def _equity(spark, sf_dir):
    bars = representation.candles(trades(spark, sf_dir), HOUR)
    w = Window.partitionBy("instrument").orderBy("bucket_us")
    return bars.select("instrument", "bucket_us", (F.col("close") - F.col("open")).alias("pnl")).withColumn("equity", F.sum("pnl").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 10000)


EQUITY = "e AS (SELECT instrument, bucket_us, close - open AS pnl, 10000 + sum(close - open) OVER (PARTITION BY instrument ORDER BY bucket_us) AS equity FROM b)"


@query(f"""WITH {T}, {bars_sql(HOUR)}, {EQUITY}, p AS (SELECT *, max(equity) OVER (PARTITION BY instrument ORDER BY bucket_us) AS peak FROM e)
SELECT instrument, bucket_us, equity::DOUBLE AS equity, peak::DOUBLE AS peak, CASE WHEN peak > 0 THEN round((peak - equity)::DOUBLE / peak::DOUBLE, 9) END AS drawdown FROM p""")
def drawdown(spark, sf_dir):
    out = features.drawdown(_equity(spark, sf_dir)).drop("pnl").withColumn("drawdown", F.round("drawdown", 9))
    return doubles(out, "equity", "peak")


@query(f"""WITH {T}, {bars_sql(HOUR)}, {EQUITY}, g AS (SELECT *, sum(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY instrument ORDER BY bucket_us) AS era FROM e)
SELECT instrument, bucket_us, pnl::DOUBLE AS pnl, (sum(CASE WHEN pnl < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY instrument, era ORDER BY bucket_us))::BIGINT AS losses FROM g""")
def loss_streak(spark, sf_dir):
    return doubles(features.loss_streak(_equity(spark, sf_dir).drop("equity")), "pnl")


def _spans(spark, sf_dir):
    return trades(spark, sf_dir).select("instrument", F.col("ts_us").alias("start"), (F.col("ts_us") + F.col("size").cast("long") * 600_000_000).alias("end"))


SPANS = "s AS (SELECT instrument, ts_us AS s, ts_us + size::BIGINT * 600000000 AS e FROM t)"
MERGED = """o AS (SELECT *, CASE WHEN max(e) OVER w IS NULL OR s > max(e) OVER w THEN 1 ELSE 0 END AS o FROM s WINDOW w AS (PARTITION BY instrument ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, sum(o) OVER (PARTITION BY instrument ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM o), m AS (SELECT instrument, min(s) AS s, max(e) AS e FROM i GROUP BY instrument, i)"""


@query(f'WITH {T}, {SPANS}, {MERGED} SELECT instrument, s AS "start", e AS "end" FROM m')
def coverage_merge(spark, sf_dir):
    return intervals.merge(_spans(spark, sf_dir), ["instrument"])


@query(f'WITH {T}, {SPANS}, {MERGED}, n AS (SELECT instrument, e AS s, lead(s) OVER (PARTITION BY instrument ORDER BY s) AS e FROM m) SELECT instrument, s AS "start", e AS "end" FROM n WHERE e IS NOT NULL')
def coverage_gaps(spark, sf_dir):
    rows = _spans(spark, sf_dir)
    within = rows.groupBy("instrument").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return intervals.gaps(rows, ["instrument"], within)


@query(f"""WITH {T}, {SPANS}, {MERGED} SELECT m.instrument, count(*) AS pairs, sum(least(m.e, b.e) - greatest(m.s, b.s))::BIGINT AS shared_us FROM m
JOIN (SELECT DISTINCT instrument, ts_us - ts_us % {DAY} AS s, ts_us - ts_us % {DAY} + {DAY // 2} AS e FROM t) b ON b.instrument = m.instrument AND m.s < b.e AND b.s < m.e GROUP BY 1""")
def support_overlap(spark, sf_dir):
    merged = intervals.merge(_spans(spark, sf_dir), ["instrument"])
    day = bucket_floor(F.col("ts_us"), DAY)
    halves = trades(spark, sf_dir).select("instrument", day.alias("start"), (day + DAY // 2).alias("end")).distinct()
    pairs = intervals.overlapping(merged, halves, ["instrument"], DAY)
    shared = F.least("l_end", "r_end") - F.greatest("l_start", "r_start")
    return pairs.groupBy("instrument").agg(F.count("*").alias("pairs"), F.sum(shared).alias("shared_us"))


@query(f"WITH {T}, {bars_sql(HOUR)} SELECT instrument, bucket_us AS event_us, (close - open)::DOUBLE AS move FROM b WHERE close - open >= 100 AND close - open > 0")
def event_detection(spark, sf_dir):
    bars = representation.candles(trades(spark, sf_dir), HOUR).withColumn("move", F.col("close") - F.col("open"))
    return bars.where(research.threshold(F.col("move"), ">=", F.lit(100), "+")).select("instrument", F.col("bucket_us").alias("event_us"), F.col("move").cast("double").alias("move"))


def _outcomes(spark, sf_dir):
    bars = representation.candles(trades(spark, sf_dir), HOUR)
    events = bars.where(F.col("close") > F.col("open")).select("instrument", F.col("bucket_us").alias("event_us"))
    return research.outcomes(events, bars, HOUR, [1, 2, 4])


OUTCOMES = f"""h AS (SELECT unnest([1, 2, 4])::INTEGER AS horizon), ev AS (SELECT instrument, bucket_us AS event_us, close::DOUBLE AS p0 FROM b WHERE close > open),
k AS (SELECT ev.*, horizon, k FROM ev, h, range(1, 5) x(k) WHERE k <= horizon), j AS (SELECT k.*, b.close::DOUBLE AS c, b.high::DOUBLE AS hi, b.low::DOUBLE AS lo FROM k LEFT JOIN b ON b.instrument = k.instrument AND b.bucket_us = k.event_us + k.k * {HOUR}),
v AS (SELECT *, coalesce(min(CASE WHEN c IS NULL THEN k END) OVER (PARTITION BY instrument, event_us, horizon), horizon + 1) AS valid FROM j),
o AS (SELECT instrument, event_us, horizon, CASE WHEN max(valid) = horizon + 1 THEN 'COMPLETE' ELSE 'INSUFFICIENT_COVERAGE' END AS state,
  CASE WHEN max(valid) = horizon + 1 THEN arg_max(c / p0 - 1, k) END AS forward_return, CASE WHEN max(valid) = horizon + 1 THEN (max(hi) - min(lo)) / max(p0) END AS high_low_excursion,
  CASE WHEN max(valid) = horizon + 1 THEN arg_max(c / p0 - 1, (abs(c / p0 - 1), -k)) END AS extreme_return,
  CASE WHEN max(valid) > 1 THEN greatest(0, max(CASE WHEN k < valid THEN c / p0 - 1 END)) END AS mfe, CASE WHEN max(valid) > 1 THEN least(0, min(CASE WHEN k < valid THEN c / p0 - 1 END)) END AS mae FROM v GROUP BY 1, 2, 3)"""
_MEASURES = ("forward_return", "high_low_excursion", "extreme_return", "mfe", "mae")


@query(f"WITH {T}, {bars_sql(HOUR)}, {OUTCOMES} SELECT instrument, event_us, horizon, state, " + ", ".join(f"round({m}, 9) AS {m}" for m in _MEASURES) + " FROM o")
def outcome_evaluation(spark, sf_dir):
    return _outcomes(spark, sf_dir).withColumns({m: F.round(m, 9) for m in _MEASURES})


_STUDY = """count(*) AS n, count(forward_return) AS n_complete, round(avg(forward_return), 9) AS mean, round(median(forward_return), 9) AS median, round(stddev_pop(forward_return), 9) AS deviation,
round(min(forward_return), 9) AS least, round(max(forward_return), 9) AS most, round(count(*) FILTER (forward_return > 0) / nullif(count(forward_return), 0), 9) AS positive_rate, round(count(*) FILTER (forward_return < 0) / nullif(count(forward_return), 0), 9) AS negative_rate"""
_STUDIED = ("mean", "median", "deviation", "least", "most", "positive_rate", "negative_rate")


@query(f"WITH {T}, {bars_sql(HOUR)}, {OUTCOMES} SELECT horizon, {_STUDY} FROM o GROUP BY 1")
def event_study(spark, sf_dir):
    return research.study(_outcomes(spark, sf_dir), ["horizon"]).withColumns({m: F.round(m, 9) for m in _STUDIED})


FOLDS = f"fo AS (SELECT x::INTEGER AS fold, 0::BIGINT AS train_start, (1704067200000000 + x * {5 * DAY})::BIGINT AS test_start, (1704067200000000 + (x + 1) * {5 * DAY})::BIGINT AS test_end FROM range(4) r(x))"


def _folds(spark):
    return validation.walk_forward(spark, 0, 1_704_067_200_000_000, 5 * DAY, 4)


@query(f"WITH {FOLDS} SELECT * FROM fo")
def walk_forward_folds(spark, sf_dir):
    return _folds(spark)


@query(f"""WITH {T}, {FOLDS} SELECT trade_id AS candidate_id, fold, CASE WHEN ts_us < train_start OR ts_us >= test_end THEN 'OUT_OF_FOLD' WHEN size = 3 THEN 'UNAVAILABLE' WHEN size = 5 THEN 'INSUFFICIENT_SUPPORT'
WHEN ts_us < test_start AND ts_us + {DAY} > test_start THEN 'PURGED' WHEN ts_us < test_start AND ts_us >= test_start - {2 * DAY} THEN 'EMBARGOED' ELSE 'ADMITTED' END AS class FROM t, fo""")
def candidate_classification(spark, sf_dir):
    t = trades(spark, sf_dir)
    late = F.when(F.col("size") == 3, F.col("ts_us") + 1).otherwise(F.col("ts_us"))
    candidates = t.select(F.col("trade_id").alias("candidate_id"), F.col("ts_us").alias("decision"), F.col("ts_us").alias("support_start"), (F.col("ts_us") + DAY).alias("support_end"), late.alias("available"), (F.col("size") != 5).alias("sufficient"))
    return validation.classify(candidates, _folds(spark), 2 * DAY)


@query(f"""WITH {T}, s AS (SELECT instrument, trade_id, ts_us AS s, ts_us + (size::BIGINT - 1) * 600000000 AS e FROM t), p AS (SELECT instrument, s AS x FROM s UNION SELECT instrument, e FROM s),
g AS (SELECT instrument, x, lead(x) OVER (PARTITION BY instrument ORDER BY x) AS y FROM p), c AS (SELECT g.instrument, x, y, count(*) AS c FROM g JOIN s ON s.instrument = g.instrument AND s.s <= x AND s.e >= y WHERE y IS NOT NULL GROUP BY 1, 2, 3)
SELECT s.instrument, s.trade_id, round(CASE WHEN s.s = s.e THEN 1.0 ELSE sum((y - x) / c / (s.e - s.s)) END, 6)::DOUBLE AS weight FROM s LEFT JOIN c ON c.instrument = s.instrument AND c.x >= s.s AND c.y <= s.e AND s.s < s.e GROUP BY s.instrument, s.trade_id, s.s, s.e""")
def uniqueness_weights(spark, sf_dir):
    rows = trades(spark, sf_dir).select("instrument", "trade_id", F.col("ts_us").alias("start"), (F.col("ts_us") + (F.col("size").cast("long") - 1) * 600_000_000).alias("end"))
    return validation.uniqueness(rows, ["instrument"]).select("instrument", "trade_id", F.round("weight", 6).alias("weight"))


RETURNS = "q AS (SELECT instrument AS trial, (row_number() OVER (PARTITION BY instrument ORDER BY bucket_us) - 1)::INTEGER AS pos, (close / open)::DOUBLE - 1 AS r FROM b)"


def _returns(spark, sf_dir):
    bars = representation.candles(trades(spark, sf_dir), HOUR)
    w = Window.partitionBy("instrument").orderBy("bucket_us")
    return bars.select(F.col("instrument").alias("trial"), (F.row_number().over(w) - 1).alias("pos"), (ratio(F.col("close"), F.col("open")) - 1).alias("r"))


def _panel(spark, sf_dir):
    """The returns of every hour of the span that all instruments share; an hour without trades returns 0."""
    bars = representation.candles(trades(spark, sf_dir), HOUR)
    span = bars.groupBy("instrument").agg(F.min("bucket_us").alias("lo"), F.max("bucket_us").alias("hi"))
    hours = span.agg(F.max("lo").alias("lo"), F.min("hi").alias("hi")).where("lo <= hi").select(F.posexplode(F.sequence("lo", "hi", F.lit(HOUR))).alias("pos", "bucket_us"))
    grid = span.select("instrument").crossJoin(F.broadcast(hours))
    r = ratio(F.col("close"), F.col("open")) - 1
    return grid.join(bars, ["instrument", "bucket_us"], "left").select(F.col("instrument").alias("trial"), "pos", F.when(F.col("open").isNull(), 0.0).otherwise(r).alias("r"))


RETURNS = RETURNS.replace("(close / open)::DOUBLE - 1", "close::DOUBLE / open::DOUBLE - 1")


@query(f"""WITH {T}, {bars_sql(HOUR)}, {RETURNS}, m AS (SELECT trial, avg(r) AS m, count(*) AS n FROM q GROUP BY 1), c AS (SELECT q.trial, max(n) AS n, max(m) AS m, sum((r - m) ** 2) AS s2, sum((r - m) ** 3) AS s3, sum((r - m) ** 4) AS s4 FROM q JOIN m ON m.trial = q.trial GROUP BY 1)
SELECT trial, n AS t, round(m / sqrt(s2 / (n - 1)), 9) AS sharpe, round(s3 / n / (s2 / n) ** 1.5, 6) AS skew, round(s4 / n / (s2 / n) ** 2, 6) AS kurtosis FROM c""")
def sharpe_moments(spark, sf_dir):
    return validation.moments(_returns(spark, sf_dir), ["trial"]).withColumns({"sharpe": F.round("sharpe", 9), "skew": F.round("skew", 6), "kurtosis": F.round("kurtosis", 6)})


@query("""WITH p AS (SELECT l.quality AS label, CASE WHEN d.n_chars > 500 THEN 1 ELSE 0 END AS predicted FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
c AS (SELECT unnest([0, 1])::INTEGER AS class), x AS (SELECT class, count(*) FILTER (label = class) AS support, count(*) FILTER (label = class AND predicted = class) AS hits, count(*) FILTER (predicted = class) AS said FROM p, c GROUP BY 1)
SELECT class, support, round(CASE WHEN said = 0 THEN 0 ELSE hits / said END, 9) AS precision, round(CASE WHEN support = 0 THEN 0 ELSE hits / support END, 9) AS recall,
round(CASE WHEN hits = 0 THEN 0 ELSE 2 * (hits / said) * (hits / support) / (hits / said + hits / support) END, 9) AS f1 FROM x""")
def classification_metrics(spark, sf_dir):
    pairs = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    out = learning.class_metrics(pairs.select(F.col("quality").alias("label"), F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("predicted")))
    return out.withColumns({m: F.round(m, 9) for m in ("precision", "recall", "f1")})


@query("SELECT l_orderkey, l_linenumber, count(DISTINCT (l_partkey, l_quantity)) AS payloads FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT (l_partkey, l_quantity)) > 1")
def conflicting_keys(spark, sf_dir):
    return merging.conflicts(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_quantity"])


@query(f"""WITH {T}, l AS (SELECT * FROM t WHERE size <> 2), r AS (SELECT venue, instrument, ts_us, trade_id, CASE WHEN size = 4 THEN price + 1 ELSE price END AS price, size FROM t WHERE size <> 6)
SELECT count(*) FILTER (l.trade_id IS NOT NULL AND r.trade_id IS NOT NULL) AS in_both, count(*) FILTER (r.trade_id IS NULL) AS left_only, count(*) FILTER (l.trade_id IS NULL) AS right_only, 0::BIGINT AS repeated,
count(*) FILTER (l.price <> r.price) AS differs_price, count(*) FILTER (l.size <> r.size) AS differs_size, 0::BIGINT AS left_null, 0::BIGINT AS right_null FROM l FULL JOIN r ON l.trade_id = r.trade_id""")
def archive_comparison(spark, sf_dir):
    t = trades(spark, sf_dir)
    right = t.where("size <> 6").withColumn("price", F.when(F.col("size") == 4, F.col("price") + 1).otherwise(F.col("price")))
    return merging.compare(t.where("size <> 2"), right, "trade_id", ["price", "size"])


@query(f"WITH {T} SELECT instrument, count(*) AS trades, count(*) FILTER (aggressor_side = 'buy') AS buys, count(*) FILTER (aggressor_side = 'sell') AS sells, count(*) FILTER (trade_id IS NULL) AS null_ids, min(ts_us) AS first_us, max(ts_us) AS last_us FROM t GROUP BY 1")
def side_stats(spark, sf_dir):
    return representation.side_stats(trades(spark, sf_dir))


def _book(spark, sf_dir):
    t = trades(spark, sf_dir)
    level = F.struct(F.floor(F.col("price") / 50).cast("string").alias("price"), (F.col("size") - 1).cast("string").alias("size"))
    none = F.expr("cast(array() as array<struct<price:string,size:string>>)")
    buy = F.col("aggressor_side") == "buy"
    return t.select("instrument", F.col("trade_id").cast("long").alias("seq"), "ts_us", F.when(F.col("trade_id").cast("long") % 500 < 5, "snapshot").otherwise("delta").alias("event_type"), F.when(buy, F.array(level)).otherwise(none).alias("bids"), F.when(~buy, F.array(level)).otherwise(none).alias("asks"), F.floor(F.col("trade_id").cast("long") / 5).alias("update_id"))


@query(f"""WITH {T}, e AS (SELECT instrument, trade_id::BIGINT AS seq, trade_id::BIGINT % 500 < 5 AS snap, trade_id::BIGINT // 5 AS u FROM t),
s AS (SELECT *, sum(snap::INTEGER) OVER w AS segment, CASE WHEN NOT snap AND u IS DISTINCT FROM lag(u) OVER w + 1 THEN 1 ELSE 0 END AS broken FROM e WINDOW w AS (PARTITION BY instrument ORDER BY seq)),
a AS (SELECT *, segment > 0 AND sum(broken) OVER (PARTITION BY instrument, segment ORDER BY seq) = 0 AS anchored FROM s) SELECT instrument, segment::BIGINT AS segment, count(*) AS events, count(*) FILTER (anchored) AS anchored FROM a GROUP BY 1, 2""")
def book_segments(spark, sf_dir):
    rows = book.segments(_book(spark, sf_dir))
    return rows.groupBy("instrument", "segment").agg(F.count("*").alias("events"), F.count_if("anchored").alias("anchored"))


@query(f"WITH {T}, r AS (SELECT instrument, ts_us // {DAY} AS day, sum(price * size)::DOUBLE AS metric FROM t GROUP BY 1, 2) SELECT instrument AS run_id, day, metric, row_number() OVER (PARTITION BY day ORDER BY metric DESC, instrument) AS rank FROM r")
def trial_ranking(spark, sf_dir):
    runs = trades(spark, sf_dir).groupBy(F.col("instrument").alias("run_id"), ((F.col("ts_us") - F.col("ts_us") % DAY) / DAY).cast("long").alias("day")).agg(F.sum(F.col("price") * F.col("size")).cast("double").alias("metric"))
    return operations.rank_runs(runs, ["day"], "metric", "run_id").withColumn("rank", F.col("rank").cast("long"))


@query("WITH s AS (SELECT event_type AS stream, event_id AS seq, lead(event_id) OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events) SELECT stream, seq + 1 AS first_missing, n - 1 AS last_missing FROM s WHERE n > seq + 1")
def signal_gaps(spark, sf_dir):
    return operations.signal_gaps(table(spark, sf_dir, "events").select(F.col("event_type").alias("stream"), F.col("event_id").alias("seq")))


@query(f"""WITH {T}, x AS (SELECT instrument AS name, 1000000.0::DOUBLE AS total, 1000000.0 - sum(size)::DOUBLE * 10 AS free, sum(size)::DOUBLE / 100 AS rate FROM t GROUP BY 1) SELECT name, round(free / rate, 6) AS hours_left,
CASE WHEN free / total <= 0.02 THEN 'EXHAUSTED' WHEN free / total <= 0.1 OR free / rate <= 24 THEN 'CRITICAL' WHEN free / total <= 0.2 THEN 'PRESSURE' ELSE 'NORMAL' END AS state FROM x""")
def storage_pressure(spark, sf_dir):
    used = F.sum("size").cast("double")
    rows = trades(spark, sf_dir).groupBy(F.col("instrument").alias("name")).agg(F.lit(1_000_000.0).alias("total"), (F.lit(1_000_000.0) - used * 10).alias("free"), (used / 100).alias("rate"))
    return operations.pressure(rows).select("name", F.round("hours_left", 6).alias("hours_left"), "state")


@query(f"WITH {T} SELECT trade_id, strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S') || CASE WHEN ts_us % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad((ts_us % 1000000)::VARCHAR, 6, '0'), '0') END || 'Z' AS instant FROM t")
def instant_text(spark, sf_dir):
    return trades(spark, sf_dir).select("trade_id", format_ns(F.col("ts_us") * 1000).alias("instant"))


