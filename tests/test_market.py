"""Every market query against its SQL in DuckDB, and hand vectors of the operators."""

import glob
import os

import duckdb
import pytest

from tidemark.plans import market, portfolio as portfolio_plans, records, research as research_plans  # noqa: F401
from tidemark.operators import features, intervals, portfolio, representation, research, simulation, validation

from .conftest import SMALL

GATE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for p in glob.glob(f"{GATE}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(market.ORACLE))
def test_query_matches_sql(spark, duck, name):
    got, want = market.QUERIES[name](spark, GATE).toPandas(), duck.sql(market.ORACLE[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    flat = lambda f: f[cols].astype(str).sort_values(cols).reset_index(drop=True)
    assert flat(got).equals(flat(want))


def test_first_and_last_trade_by_time_then_id(spark):
    t = spark.createDataFrame([("X", 0, "20", "100.50", "0.10", "buy"), ("X", 0, "100", "99.25", "0.02", "sell"), ("X", 299_999_999, "7", "101.00", "1.00", "buy"), ("X", -1, "1", "5.00", "1.00", "buy")], "instrument string, ts_us long, trade_id string, price string, size string, aggressor_side string")
    t = t.selectExpr("instrument", "ts_us", "trade_id", "cast(price as decimal(18,2)) price", "cast(size as decimal(18,2)) size", "aggressor_side")
    rows = {r.bucket_us: r for r in representation.candles(t, 300_000_000).collect()}
    assert set(rows) == {0, -300_000_000}  # the bucket before the epoch is floored
    assert (float(rows[0].open), float(rows[0].high), float(rows[0].close), float(rows[0].volume)) == (99.25, 101.0, 101.0, 1.12)


def test_unknown_side_and_off_grid_price_raise(spark):
    t = spark.sql("select 'X' instrument, 1L ts_us, '1' trade_id, cast(1.25 as decimal(18,2)) price, cast(1 as decimal(18,2)) size, 'unknown' aggressor_side")
    with pytest.raises(Exception, match="unknown side"):
        representation.bar_flow(t, 10).collect()
    with pytest.raises(Exception, match="off the grid"):
        representation.footprint(t, 10, "0.50").collect()


def test_empty_footprint_buckets_stay(spark):
    t = spark.sql("select 'X' instrument, col1 ts_us, cast(col1 as string) trade_id, cast(1.5 as decimal(18,2)) price, cast(1 as decimal(18,2)) size, 'buy' aggressor_side from values (0L), (25L)")
    assert [(r.bucket_us, r.level) for r in representation.footprint(t, 10, "0.50").orderBy("bucket_us").collect()] == [(0, 3), (10, None), (20, 3)]


def test_volume_ratio(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(9, None), (9, 0), (0, 0), (9, 2)], "a int, b int").select(features.volume_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert str(rows[0].r) == "nan" and rows[1].r == float("inf") and [rows[2].r, rows[3].r] == [0.0, 4.5]


def test_gaps_at_the_edges(spark):
    covered = spark.createDataFrame([("a", 10, 20), ("a", 20, 25), ("a", 40, 50)], "k string, start long, end long")
    within = spark.createDataFrame([("a", 0, 45), ("b", 1, 2)], "k string, start long, end long")
    assert {tuple(r) for r in intervals.gaps(covered, ["k"], within).collect()} == {("a", 0, 10), ("a", 25, 40), ("b", 1, 2)}


@pytest.fixture(scope="module")
def opens_at_zero(spark, duck, tmp_path_factory):
    """A folder with an events table in which each hour of U1 of a short span opens at 0, and the same in DuckDB."""
    path = str(tmp_path_factory.mktemp("zero"))
    first = "row_number() OVER (PARTITION BY user_id % 5, epoch_us(ts) // 3600000000 ORDER BY ts)"
    rows = f"SELECT event_id, ts, user_id, event_type, CASE WHEN user_id % 5 = 1 AND epoch_us(ts) // 3600000000 % 700 < 20 AND {first} = 1 THEN 0.001 ELSE value END AS value, props FROM events"
    duck.sql(f"COPY ({rows}) TO '{path}/events.parquet' (FORMAT parquet)")
    own = duckdb.connect()
    own.sql("set timezone='UTC'")
    own.sql(f"create view events as select * from read_parquet('{path}/events.parquet')")
    bars = f"WITH {market.T}, {market.bars_sql(market.HOUR)} SELECT count(DISTINCT instrument), count(*) FROM b WHERE open = 0"
    [(trials, hours)] = own.sql(bars).fetchall()
    assert trials == 1 and hours > 5
    return path, own


def _as_sql(spark, zero, name):
    """Both results: NaN is text, for it is not equal to itself."""
    path, own = zero
    cols = market.QUERIES[name](spark, path).columns
    text = lambda rows: sorted(tuple("nan" if v != v else v for v in r) for r in rows)
    return text(map(tuple, market.QUERIES[name](spark, path).collect())), text(own.sql(f"SELECT {', '.join(cols)} FROM ({market.ORACLE[name]})").fetchall())


def test_sharpe_of_bars_that_open_at_zero(spark, opens_at_zero):
    got, want = _as_sql(spark, opens_at_zero, "sharpe_moments")
    assert got == want and {r[0] for r in got if r[2] == "nan"} == {"U1"}


def test_deflated_sharpe_of_bars_that_open_at_zero(spark, opens_at_zero):
    got, want = _as_sql(spark, opens_at_zero, "deflated_sharpe")
    assert got == want and got[0][0] == "U1" and got[0][1] == "nan"


def test_overfitting_of_bars_that_open_at_zero(spark, opens_at_zero):
    got, want = _as_sql(spark, opens_at_zero, "backtest_overfitting")
    assert got == want and len({r[1] for r in got}) > 1
    rows = [(t, i, float("inf") if (t, i) == ("a", 0) else (i * (7 + k) % 11 - 4 + k) / 100) for k, t in enumerate("abc") for i in range(24)]
    splits = validation.overfitting(spark.createDataFrame(rows, "trial string, pos int, r double"), 6).collect()
    assert len(splits) == 20 and all(x.winner != "a" for x in splits if x.split < 10)  # the first ten splits have the first block inside


def test_overfitting_probability_of_bars_that_open_at_zero(spark, opens_at_zero):
    got, want = _as_sql(spark, opens_at_zero, "overfitting_probability")
    assert got == want and got[0][0] == 20


def test_overfitting_of_equal_trials_gives_ranks_that_the_sql_can_give(spark, duck, tmp_path):
    rows = "SELECT event_id, ts, user_id, event_type, value, props FROM events WHERE user_id % 5 > 1 UNION ALL SELECT event_id + x * 1000000, ts, user_id - user_id % 5 + x, event_type, value, props FROM events, range(2) r(x) WHERE user_id % 5 = 1"
    duck.sql(f"COPY ({rows}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    own = duckdb.connect()
    own.sql("set timezone='UTC'")
    own.sql(f"create view events as select * from read_parquet('{tmp_path}/events.parquet')")
    half = own.sql(f"WITH {market.T}, {market.bars_sql(market.HOUR)}, {research_plans._SPLITS} SELECT split, trial, inside, round(sr, 12) FROM h").fetchall()
    sharpe = {(s, t, i): x for s, t, i, x in half}
    got = research_plans.backtest_overfitting(spark, str(tmp_path)).collect()
    assert len(got) == 20 and {"U0"} < {x.winner for x in got}  # U0 is as U1
    for x in got:
        trials = [t for s, t, i in sharpe if s == x.split and i]
        assert x.winner == min(trials, key=lambda t: (-sharpe[x.split, t, True], t))
        assert x["rank"] in range(1 + sum(sharpe[x.split, t, False] < sharpe[x.split, x.winner, False] for t in trials), 1 + sum(sharpe[x.split, t, False] <= sharpe[x.split, x.winner, False] for t in trials))
    panel = spark.createDataFrame([(t, i, (i * 7 % 11 - 4) / 100) for t in "ab" for i in range(24)], "trial string, pos int, r double")
    assert {(x.winner, x["rank"]) for x in validation.overfitting(panel, 6).collect()} == {("a", 1.5)}


def test_deflated_sharpe_vector():
    expected, p = validation.deflated_sharpe(0.5, 24, 0.0, 3.0, 0.2, 10)
    assert expected == pytest.approx(0.31491966026915, abs=1e-12) and p == pytest.approx(0.79866173151637, abs=1e-12)


def test_lockbox(spark):
    rows = spark.createDataFrame([(5, 0, 1), (1, 0, 6), (1, 0, 2)], "decision long, support_start long, support_end long")
    flags = lambda revealed: [r.refused for r in validation.lockbox_guard(rows, 4, 8, revealed).collect()]
    assert flags(False) == [True, True, False] and flags(True) == [True, False, False]


def test_threshold_signs(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(-2,), (0,), (3,)], "v int")
    assert [r[0] for r in rows.select(research.threshold(F.col("v"), "!=", F.lit(0), "+")).collect()] == [False, False, True]


def _side(spark, rows, side="long"):
    fills = [("r", "X", side, i, f"{i:03}", action, price, size) for i, (action, price, size) in enumerate(rows)]
    df = spark.createDataFrame(fills, "run_id string, instrument string, side string, ts_us long, fill_id string, action string, price string, quantity string")
    return portfolio.hedged(df)


def test_sides_at_average_cost(spark):
    rows = [("increase", "10", "2"), ("increase", "13", "1"), ("decrease", "14", "1"), ("decrease", "9", "2")]
    for side, sign in (("long", 1), ("short", -1)):
        got = [tuple(float(x) for x in (r.open, r.basis, r.realized)) for r in _side(spark, rows, side).orderBy("ts_us").collect()]
        assert got == [(2, 20, 0), (3, 33, 0), (2, 22, 3 * sign), (0, 0, -4 * sign)]
        lines = portfolio.unbalanced(portfolio.journal(_side(spark, rows, side))).collect()
        assert len(lines) == 4 and all(x.balanced for x in lines)
    exact = _side(spark, [("increase", "10", "3"), ("decrease", "1", "1"), ("decrease", "1", "1"), ("decrease", "1", "1")]).orderBy("ts_us").collect()
    assert float(exact[-1].basis) == 0 and float(exact[-1].open) == 0


def test_a_fill_at_price_zero_is_a_transaction(spark):
    rows = [("increase", "0", "2"), ("increase", "3", "1"), ("decrease", "0", "1")]
    for side, debits in (("long", {"000": 0, "001": 3, "002": 1}), ("short", {"000": 0, "001": 3, "002": 1})):
        lines = portfolio.unbalanced(portfolio.journal(_side(spark, rows, side))).collect()
        assert {x.fill_id: float(x.debit) for x in lines} == debits and all(x.balanced for x in lines)


def test_sides_refuse(spark):
    for bad in ([("decrease", "10", "1")], [("increase", "10", "1"), ("decrease", "10", "2")], [("increase", "10", "0")], [("increase", None, "1")], [("grow", "10", "1")]):
        with pytest.raises(Exception, match="fill"):
            _side(spark, bad).collect()
    assert _side(spark, []).count() == 0


def test_slices_chain(spark):
    t = market.trades(spark, SMALL)
    rows = simulation.slices(t, 50, 3600).join(t.select("trade_id", "ts_us"), "trade_id").toPandas()
    assert len(rows) == t.count()
    for _, own in rows.groupby("instrument"):
        span = own.groupby("slice").ts_us.agg(["min", "max", "count"])
        assert (span["count"] <= 50).all() and (span["min"].iloc[1:].to_numpy() > span["max"].iloc[:-1].to_numpy()).all()


def test_overfitting_takes_all_hours(spark, duck):
    import math
    from itertools import combinations
    from statistics import mean, stdev

    bars = duck.sql(f"WITH {market.T}, {market.bars_sql(market.HOUR)} SELECT instrument, bucket_us, close::DOUBLE / open::DOUBLE - 1 FROM b").fetchall()
    trials = sorted({b[0] for b in bars})
    lo, hi = max(min(b[1] for b in bars if b[0] == t) for t in trials), min(max(b[1] for b in bars if b[0] == t) for t in trials)
    r = {(t, h): x for t, h, x in bars}
    panel = {t: [r.get((t, h), 0.0) for h in range(lo, hi + 1, market.HOUR)] for t in trials}
    assert len(panel[trials[0]]) > 600

    def brute(panel):
        length, out = len(next(iter(panel.values()))), {}
        for split, chosen in enumerate(combinations(range(6), 3)):
            sharpe = {(t, side): mean(h) / stdev(h) for t, x in panel.items() for side in (True, False) for h in [[v for i, v in enumerate(x) if (i * 6 // length in chosen) is side]]}
            winner = min(panel, key=lambda t: (-sharpe[t, True], t))
            rank = 1 + sum(sharpe[t, False] < sharpe[winner, False] for t in panel)
            out[split] = (winner, float(rank), round(math.log(rank / (len(panel) + 1) / (1 - rank / (len(panel) + 1))), 6))
        return out

    found = lambda f: {x.split: (x.winner, x["rank"], round(x.logit, 6)) for x in f.collect()}
    assert found(research_plans.backtest_overfitting(spark, GATE)) == brute(panel)
    odd = {t: x[:101] for t, x in panel.items()}  # six does not divide it
    rows = spark.createDataFrame([(t, i, v) for t, x in odd.items() for i, v in enumerate(x)], "trial string, pos int, r double")
    assert found(validation.overfitting(rows, 6)) == brute(odd)


def test_centroid_baseline_takes_all_components(spark, duck):
    import numpy as np

    rows = duck.sql("SELECT vec_id, label, embedding FROM embeddings ORDER BY vec_id").fetchall()
    ids, labels, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float)
    assert x.shape[1] == 64
    train = ids % 5 != 0
    scale = x[train].std(axis=0)
    z = (x - x[train].mean(axis=0)) / np.where(scale < 1e-12, 1, scale)
    classes = sorted(set(labels[train].tolist()))
    centres = np.array([z[train & (labels == c)].mean(axis=0) for c in classes])
    score = 1 / (1 + ((z[~train][:, None] - centres[None]) ** 2).sum(axis=2))
    p = score / score.sum(axis=1, keepdims=True)
    got = {r.sample_id: (r.label, r.p) for r in research_plans.centroid_baseline(spark, GATE).collect()}
    assert sorted(got) == ids[~train].tolist()
    for i, own in zip(ids[~train].tolist(), p, strict=True):
        assert got[i][0] == classes[int(own.argmax())] and abs(got[i][1] - own.max()) < 1e-7
