"""Registered queries over records: merging, normalisation, books, digests, coverage and catalogs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.instants import bucket_floor
from ..operators import book, coverage, intervals, merging
from .market import DAY, HOUR, MERGED, SPANS, T, _book, _spans, bars_sql, doubles, query, table, trades

CUT = 1_704_067_200_000_000 + 10 * DAY


@query(f"WITH {T} SELECT instrument, trade_id, ts_us, price::DOUBLE AS price, size::DOUBLE AS size FROM t")
def equivalent_dedup(spark, sf_dir):
    t = trades(spark, sf_dir)
    return doubles(merging.equivalent(t.unionByName(t.where("size >= 3")), ["instrument", "trade_id"], ["ts_us", "price", "size"]), "price", "size")


@query(f"""WITH {T}, c AS (SELECT max((ts_us, trade_id)) AS c FROM t WHERE ts_us <= {CUT})
SELECT ts_us, trade_id, instrument, price::DOUBLE AS price FROM t, c WHERE CASE WHEN (ts_us, trade_id) <= c.c THEN size <> 6 ELSE size <> 2 END""")
def historical_live_convergence(spark, sf_dir):
    """History lacks the records of size 6, live those of size 2; live repeats some records and begins long before the cutover."""
    t = trades(spark, sf_dir)
    at = t.where(F.col("ts_us") <= CUT).agg(F.max(F.struct("ts_us", "trade_id")).alias("c")).first().c or (0, "")
    live = t.where("size <> 2").unionByName(t.where("size = 3"))
    return doubles(merging.converge(t.where("size <> 6"), live, tuple(at), ["ts_us", "trade_id"], ["instrument", "price"]), "price")


@query(f"WITH {T}, a AS (SELECT min((ts_us, trade_id)) AS a FROM t WHERE size <> 2) SELECT ts_us, trade_id, instrument, price::DOUBLE AS price FROM t, a WHERE (ts_us, trade_id) > a.a")
def reconnect_reconcile(spark, sf_dir):
    t = trades(spark, sf_dir)
    window = t.where("size <> 2")
    anchor = window.agg(F.min(F.struct("ts_us", "trade_id")).alias("a")).first().a or (0, "")
    return doubles(merging.reconcile(window, t.where("size <> 4"), tuple(anchor), ["instrument", "price"]), "price")


@query(f"""WITH {T} SELECT trade_id, CASE WHEN size = 2 THEN 'new' WHEN size = 4 THEN 'conflict' ELSE 'idempotent' END AS class FROM t""")
def registration_classes(spark, sf_dir):
    t = trades(spark, sf_dir)
    offered = t.withColumn("price", F.when(F.col("size") == 4, F.col("price") + 1).otherwise(F.col("price")).cast("decimal(18,2)"))
    return merging.registration(t.where("size <> 2"), offered, ["trade_id"], ["price", "size"])


@query(f"""WITH {T}, l AS (SELECT *, ts_us - ts_us % {HOUR} AS hour FROM t WHERE size <> 2), a AS (SELECT instrument, ts_us - ts_us % {HOUR} AS hour, trade_id, CASE WHEN size = 4 THEN price + 1 ELSE price END AS price FROM t WHERE size <> 6)
SELECT coalesce(l.instrument, a.instrument) AS instrument, coalesce(l.hour, a.hour) AS hour, count(*) FILTER (l.trade_id IS NULL) AS missing, count(*) FILTER (a.trade_id IS NULL) AS extra, count(*) FILTER (l.price <> a.price) AS conflicting
FROM l FULL JOIN a ON a.trade_id = l.trade_id AND a.instrument = l.instrument AND a.hour = l.hour GROUP BY 1, 2""")
def live_window_evidence(spark, sf_dir):
    t = trades(spark, sf_dir).withColumn("hour", bucket_floor(F.col("ts_us"), HOUR))
    archive = t.where("size <> 6").withColumn("price", F.when(F.col("size") == 4, F.col("price") + 1).otherwise(F.col("price")).cast("decimal(18,2)"))
    return merging.window_evidence(t.where("size <> 2"), archive, ["instrument", "hour"], "trade_id", ["price"])


@query("""SELECT l_orderkey, l_linenumber, count(*) AS copies, CASE WHEN count(*) = 1 THEN 'single' WHEN count(DISTINCT l_partkey) = 1 THEN 'duplicate' ELSE 'conflict' END AS class
FROM (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey % 10 = 0) GROUP BY 1, 2""")
def signal_conflicts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return merging.repetition(rows.union(rows.where("l_partkey % 10 = 0")), ["l_orderkey", "l_linenumber"], ["l_partkey"])


@query(f"""WITH {T}, c AS (SELECT instrument, trade_id::BIGINT AS seq, trade_id::BIGINT % 500 < 5 AS snap, CASE WHEN aggressor_side = 'buy' THEN 'bid' ELSE 'ask' END AS side, floor(price / 50) AS price, size - 1 AS size FROM t),
s AS (SELECT instrument, max(seq) AS since FROM c WHERE snap GROUP BY 1),
l AS (SELECT c.instrument, side, price, arg_max(size, seq) AS size FROM c JOIN s ON s.instrument = c.instrument AND seq >= since GROUP BY 1, 2, 3) SELECT instrument, side, price::DOUBLE AS price, size::DOUBLE AS size FROM l WHERE size <> 0""")
def book_state(spark, sf_dir):
    return doubles(book.state_at(_book(spark, sf_dir), ["instrument"]), "price", "size")


@query(f"""WITH {T}, e AS (SELECT instrument, ts_us, trade_id::BIGINT AS seq, trade_id::BIGINT % 500 < 5 AS snap, trade_id::BIGINT // 5 AS u FROM t),
s AS (SELECT *, sum(snap::INTEGER) OVER w AS segment, CASE WHEN NOT snap AND u IS DISTINCT FROM lag(u) OVER w + 1 THEN 1 ELSE 0 END AS broken FROM e WINDOW w AS (PARTITION BY instrument ORDER BY seq)),
a AS (SELECT *, segment > 0 AND sum(broken) OVER (PARTITION BY instrument, segment ORDER BY seq) = 0 AS anchored FROM s)
SELECT instrument, ts_us // {DAY} AS day, count(*) AS events, count(*) FILTER (snap) AS snapshots, count(*) AS changes, count(*) FILTER (NOT anchored) AS unanchored, 1::INTEGER AS widest, min(ts_us) AS first_us, max(ts_us) AS last_us FROM a GROUP BY 1, 2""")
def book_day_measure(spark, sf_dir):
    return book.day_measure(_book(spark, sf_dir), ["instrument"])


@query(f"WITH {T} SELECT instrument, arg_min(trade_id::BIGINT % 500 < 5, trade_id::BIGINT) AS replayable FROM t GROUP BY 1")
def book_replayable(spark, sf_dir):
    return book.replayable(_book(spark, sf_dir), ["instrument"])


def messages(spark, sf_dir, venue: str):
    """The trades as order-book messages of a venue: one level each; a size of 1 is written as a removal."""
    t = trades(spark, sf_dir).withColumns({"id": F.col("trade_id").cast("long"), "ms": F.floor(F.col("ts_us") / 1000), "buy": F.col("aggressor_side") == "buy"})
    price, size = "cast(price as string)", "if(size = 1, '0.00', cast(size as string))"
    pair, none = f"array(array({price}, {size}))", "cast(array() as array<array<string>>)"
    bids, asks = f"if(buy, {pair}, {none})", f"if(buy, {none}, {pair})"
    snap, stamp = "id % 500 < 5", "date_format(timestamp_millis(ms), \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")"
    four, no_four = f"array(array({price}, {size}, '0', '1'))", none
    object_, no_object = f"array(named_struct('price', {price}, 'qty', {size}))", "cast(array() as array<struct<price:string,qty:string>>)"
    kind = lambda other: f"if({snap}, 'snapshot', '{other}')"
    sql = {
        "bybit": f"named_struct('topic', 'orderbook.50', 'type', {kind('delta')}, 'ts', ms + 3, 'cts', ms, 'data', named_struct('s', instrument, 'b', {bids}, 'a', {asks}, 'u', id, 'seq', id * 2))",
        "okx": f"named_struct('arg', named_struct('channel', 'books', 'instId', instrument), 'action', {kind('update')}, 'data', array(named_struct('asks', if(buy, {no_four}, {four}), 'bids', if(buy, {four}, {no_four}), 'ts', cast(ms as string), 'checksum', -id, 'seqId', id, 'prevSeqId', id - 1)))",
        "binance_diff": f"named_struct('e', 'depthUpdate', 'E', ms + 1, 'T', if(id % 2 = 0, ms, null), 's', instrument, 'U', id - 1, 'u', id, 'pu', id - 2, 'b', {bids}, 'a', {asks})",
        "binance_snapshot": f"named_struct('lastUpdateId', id, 'bids', {bids}, 'asks', {asks})",
        "kraken": f"named_struct('channel', 'book', 'type', {kind('update')}, 'data', array(named_struct('symbol', instrument, 'bids', if(buy, {object_}, {no_object}), 'asks', if(buy, {no_object}, {object_}), 'checksum', id, 'timestamp', {stamp})))",
        "coinbase": f"if({snap}, to_json(named_struct('type', 'snapshot', 'product_id', instrument, 'time', {stamp}, 'bids', {bids}, 'asks', {asks})), to_json(named_struct('type', 'l2update', 'product_id', instrument, 'time', {stamp}, 'changes', array(array(if(buy, 'buy', 'sell'), {price}, {size})))))",
    }[venue]
    return t.select(F.expr(sql if venue == "coinbase" else f"to_json({sql})").alias("message"), F.col("instrument").alias("given_instrument"), F.col("ms").alias("given_ms"))


_VENUE = """SELECT '{v}' AS venue, instrument, {kind} AS event_type, {ms} AS exchange_ms, {pms} AS provider_ms, {uid} AS update_id, {pid} AS previous_id, {tok} AS token,
CASE WHEN aggressor_side = 'buy' THEN 'bid' ELSE 'ask' END AS side, price::VARCHAR AS price, CASE WHEN size = 1 THEN '0' ELSE size::VARCHAR END AS size, CASE WHEN size = 1 THEN 'delete' ELSE 'upsert' END AS action FROM n"""
_N = "-1::BIGINT"
_K = "CASE WHEN id % 500 < 5 THEN 'snapshot' ELSE 'delta' END"
_VENUES = [
    dict(v="bybit", kind=_K, ms="ms", pms="ms + 3", uid="id", pid=_N, tok="(id * 2)::VARCHAR"),
    dict(v="okx", kind=_K, ms="ms", pms=_N, uid="id", pid="id - 1", tok="(-id)::VARCHAR"),
    dict(v="binance_diff", kind="'delta'", ms="CASE WHEN id % 2 = 0 THEN ms ELSE ms + 1 END", pms="ms + 1", uid="id", pid="id - 2", tok="(id - 1)::VARCHAR"),
    dict(v="binance_snapshot", kind="'snapshot'", ms="ms", pms=_N, uid="id", pid=_N, tok="''"),
    dict(v="kraken", kind=_K, ms="ms", pms=_N, uid=_N, pid=_N, tok="id::VARCHAR"),
    dict(v="coinbase", kind=_K, ms="ms", pms=_N, uid=_N, pid=_N, tok="''"),
]


def _venue_query(own: dict):
    @query(f"WITH {T}, n AS (SELECT *, trade_id::BIGINT AS id, ts_us // 1000 AS ms FROM t) " + _VENUE.format(**own))
    def run(spark, sf_dir):
        rows = book.normalized(messages(spark, sf_dir, own["v"]), own["v"]).fillna(-1, ["provider_ms", "update_id", "previous_id"]).fillna("", ["token"])
        side = lambda name: F.transform(name + "s", lambda x: F.struct(F.lit(name).alias("side"), x["price"].alias("price"), x["size"].alias("size"), x["action"].alias("action")))
        return rows.withColumn("l", F.explode(F.concat(side("bid"), side("ask")))).drop("bids", "asks").select("*", "l.*").drop("l")

    return run


def _register_venues() -> None:
    from .market import ORACLE, QUERIES

    for own in _VENUES:
        _venue_query(own)
        for where in (QUERIES, ORACLE):
            where[f"l2_normalized_{own['v']}"] = where.pop("run")


_register_venues()


@query(f"""WITH {T}, d AS (SELECT instrument, ts_us // {DAY} AS day, ts_us, trade_id, sha256('{{"price":"' || price::VARCHAR || '","trade_id":"' || trade_id || '","ts_us":' || ts_us::VARCHAR || '}}') AS d FROM t),
r AS (SELECT *, (row_number() OVER (PARTITION BY instrument, day ORDER BY ts_us, trade_id) - 1) // 64 AS part FROM d),
p AS (SELECT instrument, day, part, count(*) AS n, sha256(string_agg(d, '' ORDER BY ts_us, trade_id)) AS d FROM r GROUP BY 1, 2, 3)
SELECT instrument, day, sum(n)::BIGINT AS n, sha256(string_agg(d, '' ORDER BY part)) AS digest FROM p GROUP BY 1, 2""")
def content_digests(spark, sf_dir):
    t = trades(spark, sf_dir).withColumn("day", F.floor(F.col("ts_us") / DAY)).withColumn("price", F.col("price").cast("string"))
    return scalars.content_digest(t, ["instrument", "day"], ["ts_us", "trade_id"], ["ts_us", "trade_id", "price"], 64)


@query("""SELECT p_partkey, 'raw/trade/' || p_brand || '/' || replace(url_encode(p_name), '~', '%7E') || '/trade-v1' AS root, 'features/bar/' || p_brand || '/' || replace(url_encode(p_type), '~', '%7E') || '/set/v' || p_size::VARCHAR || '/feature-v1' AS feature_root FROM part""")
def dataset_roots(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    lit = F.lit
    return p.select(
        "p_partkey",
        scalars.root_path(lit("raw"), lit("trade"), F.col("p_brand"), F.col("p_name"), lit("trade-v1")).alias("root"),
        scalars.root_path(lit("features"), lit("bar"), F.col("p_brand"), F.col("p_type"), lit("feature-v1"), lit("set"), F.col("p_size")).alias("feature_root"),
    )


@query(f"""WITH {T} SELECT trade_id, CASE WHEN price = floor(price) THEN floor(price)::BIGINT::VARCHAR ELSE rtrim(price::VARCHAR, '0') END AS plain, (CASE WHEN (price * 4) % 2 = 1 AND (price * 4 - 1) % 4 = 0 THEN (price * 4 - 1) / 2 WHEN (price * 4) % 2 = 1 THEN (price * 4 + 1) / 2 ELSE round(price * 2, 0) END / 2)::DOUBLE AS half,
ts_us - ts_us % {DAY} AS midnight, ts_us - ts_us % {DAY} + {DAY} AS next_midnight, ts_us - ts_us % {HOUR} AS support_start, (ts_us + 5400000000 - 1) - (ts_us + 5400000000 - 1) % {HOUR} + {HOUR} AS support_end,
trade_id::BIGINT % 6 IN (0, 2, 4) AS yes, (CASE WHEN price >= 10 THEN 1 ELSE 0 END + CASE WHEN price >= 50 THEN 1 ELSE 0 END + CASE WHEN price >= 100 THEN 1 ELSE 0 END)::INTEGER AS class,
strftime(make_timestamp(ts_us), 'dt=%Y-%m-%d/seg=%H%M%S.') || lpad(((ts_us // 1000) % 1000)::VARCHAR, 3, '0') AS slice FROM t""")
def scalar_values(spark, sf_dir):
    t = trades(spark, sf_dir)
    ts = F.col("ts_us")
    start, end = scalars.support(ts, ts + 5_400_000_000, HOUR)
    words = F.array(*[F.lit(w) for w in (" Yes ", "no", "LONG", "flat", "1", "")])
    return t.select(
        "trade_id",
        scalars.decimal_text(F.concat(F.lit("00"), F.col("price").cast("string"), F.lit("00"))).alias("plain"),
        scalars.half_even(F.col("price"), F.lit(0.5).cast("decimal(2,1)")).cast("double").alias("half"),
        scalars.day_start(ts).alias("midnight"),
        scalars.next_midnight(ts).alias("next_midnight"),
        start.alias("support_start"),
        end.alias("support_end"),
        scalars.truthy(F.get(words, (F.col("trade_id").cast("long") % 6).cast("int"))).alias("yes"),
        scalars.threshold_class(F.col("price"), [10, 50, 100]).alias("class"),
        scalars.slice_key(ts - ts % 1000).alias("slice"),
    )


_POINTS = f"""m2 AS (SELECT instrument, s, e FROM m), pt AS (SELECT t.instrument, t.trade_id, t.ts_us + {DAY // 3} AS "at", EXISTS (SELECT 1 FROM m2 WHERE m2.instrument = t.instrument AND m2.s <= t.ts_us + {DAY // 3} AND t.ts_us + {DAY // 3} < m2.e) AS inside FROM t)"""
_WIDE = SPANS.replace("FROM t)", "FROM t WHERE size >= 4)")


@query(f"WITH {T}, {_WIDE}, {MERGED}, {_POINTS} SELECT instrument, trade_id, \"at\", inside FROM pt")
def support_containment(spark, sf_dir):
    t = trades(spark, sf_dir)
    spans = _spans(spark, sf_dir).where((F.col("end") - F.col("start")) >= 4 * 600_000_000)
    return coverage.contained(t.select("instrument", "trade_id", (F.col("ts_us") + DAY // 3).alias("at")), spans, ["instrument"], "at", DAY)


@query(f"""WITH {T}, {_WIDE}, {MERGED}, x AS (SELECT instrument, trade_id, ts_us, coalesce((ts_us, trade_id) <= lag((ts_us, trade_id)) OVER (PARTITION BY instrument ORDER BY trade_id::BIGINT + CASE WHEN size = 3 THEN 9 ELSE 0 END, trade_id), false) AS bad,
EXISTS (SELECT 1 FROM m WHERE m.instrument = t.instrument AND m.s <= t.ts_us AND t.ts_us < m.e) AS inside FROM t)
SELECT instrument, count(*) AS n, min(ts_us) AS first, max(ts_us) AS last, count(*) FILTER (bad) AS disordered, count(*) FILTER (NOT inside) AS outside, 0::BIGINT AS repeated FROM x GROUP BY 1""")
def scan_integrity(spark, sf_dir):
    t = trades(spark, sf_dir).withColumn("position", F.struct(F.col("trade_id").cast("long") + F.when(F.col("size") == 3, 9).otherwise(0), "trade_id"))
    spans = _spans(spark, sf_dir).where((F.col("end") - F.col("start")) >= 4 * 600_000_000)
    return coverage.scan_report(t, ["instrument"], "position", ["ts_us", "trade_id"], "ts_us", spans, DAY)


@query(f"""WITH {T}, x AS (SELECT *, lag((ts_us, trade_id)) OVER (PARTITION BY instrument ORDER BY trade_id::BIGINT + CASE WHEN size = 3 THEN 9 ELSE 0 END, trade_id) AS p FROM t) SELECT instrument, trade_id, ts_us FROM x WHERE (ts_us, trade_id) <= p""")
def order_integrity(spark, sf_dir):
    """Records of size 3 stand nine places late, so the order is broken."""
    from ..functions.checks import order_violations

    t = trades(spark, sf_dir).withColumn("position", F.struct(F.col("trade_id").cast("long") + F.when(F.col("size") == 3, 9).otherwise(0), "trade_id"))
    return order_violations(t, ["instrument"], "position", ["ts_us", "trade_id"]).select("instrument", "trade_id", "ts_us")


@query(f"""WITH {T}, {SPANS}, {MERGED}, r AS (SELECT instrument, max(s) - {5 * DAY} AS f FROM s GROUP BY 1) SELECT m.instrument, greatest(s, f) AS "start", e AS "end" FROM m JOIN r ON r.instrument = m.instrument WHERE e > f""")
def resumed_islands(spark, sf_dir):
    rows = _spans(spark, sf_dir)
    point = rows.groupBy("instrument").agg((F.max("start") - 5 * DAY).alias("resume"))
    return coverage.islands_after(rows.join(point, "instrument"), ["instrument"], "resume")


@query(f"""WITH {T}, {SPANS}, {MERGED}, g AS (SELECT instrument, lag(e) OVER w AS lo, s AS hi FROM m WINDOW w AS (PARTITION BY instrument ORDER BY s)), n AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY hi) AS gap FROM g WHERE lo IS NOT NULL)
SELECT instrument, gap, 'OPEN' AS kind, lo AS at FROM n UNION ALL SELECT instrument, gap, 'CLOSED', hi FROM n""")
def live_gap_events(spark, sf_dir):
    islands = intervals.merge(_spans(spark, sf_dir), ["instrument"])
    return coverage.gap_events(islands, ["instrument"]).withColumn("gap", F.col("gap").cast("long"))


_HOURS = f"h AS (SELECT DISTINCT instrument, ts_us - ts_us % {HOUR} AS s, ts_us - ts_us % {HOUR} + {HOUR} AS e FROM t WHERE size <> 5)"


@query(f"""WITH {T}, {_HOURS}, b AS (SELECT *, CASE WHEN s IS NOT DISTINCT FROM lag(e) OVER w THEN 0 ELSE 1 END AS b FROM h WINDOW w AS (PARTITION BY instrument ORDER BY s)), c AS (SELECT *, sum(b) OVER (PARTITION BY instrument ORDER BY s) AS chain FROM b)
SELECT instrument, chain::BIGINT AS chain, count(*) AS pieces, min(s) AS "start", max(e) AS "end" FROM c GROUP BY 1, 2""")
def chain_segments(spark, sf_dir):
    hour = bucket_floor(F.col("ts_us"), HOUR)
    rows = trades(spark, sf_dir).where("size <> 5").select("instrument", hour.alias("start"), (hour + HOUR).alias("end")).distinct()
    return coverage.chains(rows, ["instrument"])


@query(f"""WITH {T}, {SPANS}, p AS (SELECT instrument, row_number() OVER (PARTITION BY instrument ORDER BY s, e) AS name, s, e FROM s), o AS (SELECT *, max(e) OVER (PARTITION BY instrument ORDER BY s, e, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p)
SELECT instrument, s AS "start", e AS "end", reach FROM o WHERE s < reach""")
def partition_overlaps(spark, sf_dir):
    rows = _spans(spark, sf_dir).withColumn("name", F.lit("p"))
    return coverage.overlaps(rows, ["instrument"], "name").drop("name")


_ASSERT = f"""q AS (SELECT instrument, ts_us // {DAY} AS day, CASE WHEN event_mod = 0 THEN 'known_gap' ELSE 'complete' END AS status, ts_us AS s, ts_us + size::BIGINT * 7200000000 AS e, ts_us AS f, ts_us + size::BIGINT * 600000000 AS l FROM (SELECT *, trade_id::BIGINT % 97 AS event_mod FROM t))"""


@query(f"""WITH {T}, {_ASSERT}, k AS (SELECT * FROM q WHERE status = 'complete'), o AS (SELECT *, CASE WHEN max(e) OVER w IS NULL OR s > max(e) OVER w THEN 1 ELSE 0 END AS o FROM k WINDOW w AS (PARTITION BY instrument, day ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT instrument, day, sum(o) AS spans, min(s) AS s, max(e) AS e FROM o GROUP BY 1, 2), g AS (SELECT DISTINCT q.instrument, q.day FROM q JOIN c ON c.instrument = q.instrument AND c.day = q.day AND q.status = 'known_gap' AND q.s < c.e AND c.s < q.e),
a AS (SELECT instrument, day, min(f) AS f, max(l) AS l FROM q GROUP BY 1, 2)
SELECT a.instrument, a.day, coalesce(c.s, -1) AS "start", coalesce(c.e, -1) AS "end", CASE WHEN c.spans IS NULL THEN 'no_complete' WHEN c.spans > 1 THEN 'not_contiguous' WHEN g.day IS NOT NULL THEN 'contradicted' WHEN a.f < c.s OR a.l >= c.e THEN 'observed_outside' END AS fault
FROM a LEFT JOIN c ON c.instrument = a.instrument AND c.day = a.day LEFT JOIN g ON g.instrument = a.instrument AND g.day = a.day""")
def coverage_fold(spark, sf_dir):
    t = trades(spark, sf_dir)
    ts, size = F.col("ts_us"), F.col("size").cast("long")
    status = F.when(F.col("trade_id").cast("long") % 97 == 0, "known_gap").otherwise("complete")
    rows = t.select("instrument", F.floor(ts / DAY).alias("day"), status.alias("status"), ts.alias("start"), (ts + size * 7_200_000_000).alias("end"), ts.alias("first"), (ts + size * 600_000_000).alias("last"))
    return coverage.folded(rows, ["instrument", "day"]).fillna(-1, ["start", "end"])


@query("""WITH d AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey - 3 WHEN o_orderkey % 11 = 0 THEN o_orderkey WHEN o_orderkey % 13 = 0 THEN -o_orderkey WHEN o_orderkey % 5 = 3 THEN o_orderkey - 1 END AS supersedes FROM orders
UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 101 = 0),
r AS (SELECT id, count(*) AS n, max(supersedes) AS supersedes FROM d GROUP BY 1), a AS (SELECT supersedes AS id, count(DISTINCT id) AS k FROM d WHERE supersedes IS NOT NULL GROUP BY 1)
SELECT r.id, a.k IS NULL AS live, CASE WHEN r.n > 1 THEN 'duplicate' WHEN r.supersedes = r.id THEN 'self' WHEN r.supersedes IS NOT NULL AND s.id IS NULL THEN 'unknown' WHEN b.k > 1 THEN 'forked' END AS fault
FROM r LEFT JOIN a ON a.id = r.id LEFT JOIN r s ON s.id = r.supersedes LEFT JOIN a b ON b.id = r.supersedes""")
def supersession_heads(spark, sf_dir):
    k = F.col("o_orderkey")
    old = F.when(k % 5 == 0, k - 3).when(k % 11 == 0, k).when(k % 13 == 0, -k).when(k % 5 == 3, k - 1)
    orders = table(spark, sf_dir, "orders")
    again = orders.where(k % 101 == 0).select(k.alias("id"), F.lit(None).cast("long").alias("supersedes"))
    return coverage.heads(orders.select(k.alias("id"), old.alias("supersedes")).unionByName(again))


@query("""WITH m AS (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT o.o_orderkey, coalesce(n, 0) AS manifests, coalesce(n = 1, false) AS matched FROM (SELECT DISTINCT o_orderkey FROM orders) o LEFT JOIN m ON m.o_orderkey = o.o_orderkey""")
def manifest_match(spark, sf_dir):
    manifests = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return coverage.matched_once(table(spark, sf_dir, "orders"), manifests, ["o_orderkey"])


@query("""SELECT c_custkey, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P" FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def partition_rollup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("state"))
    return coverage.rollup(table(spark, sf_dir, "customer"), orders, ["c_custkey"], ["F", "O", "P"])


@query("""SELECT p.s_suppkey, d.n_name, r.r_name, r.r_name || '/' || d.n_name || '/' || p.s_name AS path FROM supplier p JOIN nation d ON d.n_nationkey = p.s_nationkey JOIN region r ON r.r_regionkey = d.n_regionkey""")
def catalog_paths(spark, sf_dir):
    """Partitions with their dataset and storage root."""
    roots, sets = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    own = table(spark, sf_dir, "supplier").join(sets, F.col("s_nationkey") == F.col("n_nationkey")).join(roots, F.col("n_regionkey") == F.col("r_regionkey"))
    return own.select("s_suppkey", "n_name", "r_name", F.concat_ws("/", "r_name", "n_name", "s_name").alias("path"))


@query(f"""WITH {T}, {bars_sql(HOUR)}, s AS (SELECT instrument, unnest(range(min(bucket_us), max(bucket_us) + 1, {HOUR})) AS bucket_us FROM b GROUP BY 1),
o AS (SELECT instrument, bucket_us + CASE WHEN trade_count = 7 THEN 1 ELSE 0 END AS bucket_us, trade_count >= 2 AS final FROM b)
SELECT coalesce(s.instrument, o.instrument) AS instrument, count(*) FILTER (o.bucket_us IS NULL) AS missing, count(*) FILTER (s.bucket_us IS NULL) AS unexpected, count(*) FILTER (NOT final) AS provisional,
count(*) FILTER (o.bucket_us IS NULL) = 0 AND count(*) FILTER (s.bucket_us IS NULL) = 0 AND count(*) FILTER (NOT final) = 0 AS proven FROM s FULL JOIN o ON o.instrument = s.instrument AND o.bucket_us = s.bucket_us GROUP BY 1""")
def final_proof(spark, sf_dir):
    """The expected observations are all buckets of an instrument's span."""
    from ..operators.representation import candles

    bars = candles(trades(spark, sf_dir), HOUR)
    span = bars.groupBy("instrument").agg(F.min("bucket_us").alias("lo"), F.max("bucket_us").alias("hi"))
    expected = span.select("instrument", F.explode(F.sequence("lo", "hi", F.lit(HOUR))).alias("bucket_us"))
    at = F.col("bucket_us") + F.when(F.col("trade_count") == 7, 1).otherwise(0)
    observed = bars.select("instrument", at.alias("bucket_us"), F.when(F.col("trade_count") >= 2, "FINAL").otherwise("PROVISIONAL").alias("lifecycle"))
    return coverage.proof(expected, observed, ["instrument"], ["bucket_us"])


@query(f"""WITH {T}, d AS (SELECT instrument, unnest(range(min(ts_us // {DAY}), max(ts_us // {DAY}) + 1)) AS day FROM t GROUP BY 1) SELECT instrument, day FROM d WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.instrument = d.instrument AND t.ts_us // {DAY} = d.day AND t.size = 7 AND t.price > 200)""")
def archive_days_missing(spark, sf_dir):
    t = trades(spark, sf_dir).withColumn("day", F.floor(F.col("ts_us") / DAY))
    needed = t.groupBy("instrument").agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select("instrument", F.explode(F.sequence("lo", "hi")).alias("day"))
    return needed.join(t.where("size = 7 and price > 200"), ["instrument", "day"], "left_anti")


@query(f"""WITH {T}, x AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts_us DESC, trade_id DESC) AS n FROM t) SELECT instrument, trade_id, ts_us FROM x WHERE n <= 5""")
def recent_trades(spark, sf_dir):
    """A report of the last five trades of each instrument."""
    from pyspark.sql import Window

    w = Window.partitionBy("instrument").orderBy(F.desc("ts_us"), F.desc("trade_id"))
    return trades(spark, sf_dir).withColumn("n", F.row_number().over(w)).where("n <= 5").select("instrument", "trade_id", "ts_us")
