"""Refusals and hand vectors of merging, books, scalars, coverage, policies and studies."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.functions.instants import parse_duration
from tidemark.operators import book, coverage, merging, policies, portfolio, studies

KEY, PAY = ["ts_us", "trade_id"], ["price"]


def trades(spark, rows):
    return spark.createDataFrame(rows, "ts_us long, trade_id string, price double")


def test_equivalent(spark):
    rows = [(1, "a", 1.0), (1, "a", 1.0), (2, "b", None), (2, "b", None)]
    assert sorted(map(tuple, merging.equivalent(trades(spark, rows), KEY, PAY).collect())) == [(1, "a", 1.0), (2, "b", None)]
    assert merging.equivalent(trades(spark, []), KEY, PAY).count() == 0
    for bad in ([(1, "a", 1.0), (1, "a", 2.0)], [(1, "a", 1.0), (1, "a", None)]):
        with pytest.raises(Exception, match="two payloads"):
            merging.equivalent(trades(spark, bad), KEY, PAY).collect()


def test_converge(spark):
    history = trades(spark, [(1, "a", 1.0), (2, "a", 2.0), (2, "c", 2.5)])
    live = trades(spark, [(1, "x", 9.0), (2, "a", 2.0), (2, "b", 7.0), (3, "a", 3.0), (3, "a", 3.0)])
    got = sorted(tuple(r) for r in merging.converge(history, live, (2, "a"), KEY, PAY).collect())
    assert got == [(1, "a", 1.0), (2, "a", 2.0), (2, "b", 7.0), (3, "a", 3.0)]  # the cutover is a key; early rows that history lacks are passed over
    with pytest.raises(Exception, match="contradicts"):
        merging.converge(history, trades(spark, [(1, "a", 5.0)]), (2, "a"), KEY, PAY).collect()
    assert merging.converge(history, live.where("false"), (9, "z"), KEY, PAY).count() == 3


def test_reconcile(spark):
    window = trades(spark, [(1, "a", 1.0), (2, "a", 2.0), (3, "a", 3.0)])
    buffered = trades(spark, [(3, "a", 3.0), (4, "a", 4.0)])
    assert sorted(r.ts_us for r in merging.reconcile(window, buffered, (1, "a"), PAY).collect()) == [2, 3, 4]
    with pytest.raises(Exception, match="anchor"):
        merging.reconcile(window, buffered, (1, "b"), PAY).collect()
    with pytest.raises(Exception, match="overlap"):
        merging.reconcile(window, buffered.where("ts_us = 4"), (1, "a"), PAY).collect()
    with pytest.raises(Exception, match="two payloads"):
        merging.reconcile(window, trades(spark, [(3, "a", 9.0)]), (1, "a"), PAY).collect()


def test_a_snapshot_begins_the_book_anew(spark):
    one = lambda p, s="1": [(p, s)]
    rows = [("X", 1, "snapshot", one("100"), one("101")), ("X", 2, "delta", one("99"), []), ("X", 3, "snapshot", one("90"), one("91")), ("X", 4, "delta", one("89"), one("91", "0")), ("X", 5, "delta", [], one("92")), ("Y", 1, "delta", one("5"), [])]
    level = "array<struct<price:string,size:string>>"
    events = spark.createDataFrame(rows, f"instrument string, seq long, event_type string, bids {level}, asks {level}").withColumn("ts_us", F.col("seq"))
    best = book.best(book.state_at(events, ["instrument"]), ["instrument"]).collect()
    assert [(r.instrument, float(r.best_bid), float(r.best_ask), r.crossed) for r in best] == [("X", 90.0, 92.0, False)]
    assert {r.instrument: r.replayable for r in book.replayable(events, ["instrument"]).collect()} == {"X": True, "Y": False}


@pytest.mark.parametrize("venue", ["bybit", "okx", "binance_diff", "kraken", "coinbase"])
def test_venues_refuse_what_is_no_book_message(spark, venue):
    for text in ("{}", "nothing", json.dumps({"type": "pong"})):
        with pytest.raises(Exception, match="book message"):
            book.normalized(spark.createDataFrame([(text,)], "message string"), venue).collect()


def test_durations():
    assert [parse_duration(x) for x in (300, "300", "5m", "100ms", "00:00:01.5")] == [300, 300, 300 * 10**9, 10**8, 15 * 10**8]
    for bad in (0, -1, True, "0", "0s", "5y", "", "1:2:3", "-5", 1.5):
        with pytest.raises(ValueError, match="duration"):
            parse_duration(bad)


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    plain = {"000.50": "0.5", "12": "12", "1.000": "1", "0": "0", "0.0": "0", "123456789012345678901234567890123456789012.10": "123456789012345678901234567890123456789012.1"}
    assert {t: value(scalars.decimal_text(F.lit(t))) for t in plain} == plain
    for bad in ("1e5", "-1", ".5", "5.", "", " 1"):
        with pytest.raises(Exception, match="not a decimal"):
            value(scalars.decimal_text(F.lit(bad)))
    assert value(scalars.path_encoded(F.lit("BTC/USD é~._-%"))) == "BTC%2FUSD%20%C3%A9%7E._-%25" and value(scalars.path_encoded(F.lit(""))) == ""
    assert [value(scalars.half_even(F.lit(x), F.lit(1.0))) for x in (0.5, 1.5, 2.5, -0.5)] == [0.0, 2.0, 2.0, 0.0]
    assert value(scalars.slice_key(F.lit(1_704_110_405_078_000))) == "dt=2024-01-01/seg=120005.078"
    with pytest.raises(Exception, match="millisecond"):
        value(scalars.slice_key(F.lit(1)))
    with pytest.raises(Exception, match="truth"):
        value(scalars.truthy(F.lit("maybe")))


def test_content_digest_is_the_same_however_rows_are_dealt(spark):
    rows = spark.createDataFrame([("a", i, f"v{i}" if i % 3 else None) for i in range(50)], "k string, n int, v string")
    got = [scalars.content_digest(d, ["k"], ["n"], ["v", "n"], 8).collect() for d in (rows, rows.repartition(7))]
    lines = [json.dumps({"n": i, "v": f"v{i}" if i % 3 else None}, separators=(",", ":")) for i in range(50)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    own = [sha(x) for x in lines]
    assert got[0] == got[1] and got[0][0].digest == sha("".join(sha("".join(own[i : i + 8])) for i in range(0, 50, 8)))


def test_heads_and_folds(spark):
    docs = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 4), (5, 99), (6, None), (6, None)], "id long, supersedes long")
    assert {r.id: (r.live, r.fault) for r in coverage.heads(docs).collect()} == {1: (False, None), 2: (True, "forked"), 3: (True, "forked"), 4: (False, "self"), 5: (True, "unknown"), 6: (True, "duplicate")}
    rows = [("a", "complete", 0, 5, 0, 9), ("a", "complete", 5, 10, 0, 9), ("b", "complete", 0, 5, 0, 4), ("b", "complete", 6, 9, 0, 4), ("c", "known_gap", 0, 5, 1, 2), ("d", "complete", 0, 5, 0, 4), ("d", "known_gap", 2, 3, 0, 4), ("e", "complete", 0, 5, 0, 5)]
    table = spark.createDataFrame(rows, "p string, status string, start long, end long, first long, last long")
    assert {r.p: r.fault for r in coverage.folded(table, ["p"]).collect()} == {"a": None, "b": "not_contiguous", "c": "no_complete", "d": "contradicted", "e": "observed_outside"}


def test_missing_signals_are_false(spark):
    rows = spark.createDataFrame([(True, None), (True, False), (True, True), (None, None)], "a boolean, b boolean")
    cols = [F.col("a"), F.col("b")]
    assert [(r.x, r.y) for r in rows.select(policies.combined(cols, "ALL").alias("x"), policies.combined(cols, "ANY").alias("y")).collect()] == [(False, False), (False, True), (True, True), (False, False)]


def test_deflated_sharpe_vector_and_reasons(spark):
    assert 0.2 * studies.expected_factor(10) == pytest.approx(0.31491966026915)
    frame = lambda rows: spark.createDataFrame(rows, "trial string, t long, sharpe double, skew double, kurtosis double")
    reason = lambda rows, k: studies.deflated(frame(rows), k).first().reason
    good = [("a", 24, 0.5, 0.0, 3.0), ("b", 24, 0.1, 0.0, 3.0)]
    assert reason(good, 2) is None and reason(good, 1.5) == "trials_out_of_range" and reason(good, 3) == "trials_out_of_range" and reason([], 1) == "no_trials"
    assert reason([good[0], ("b", 24, None, 0.0, 3.0)], 2) == "non_evaluable_trial" and reason([("a", 3, 0.5, 0.0, 3.0)], 1) == "too_few_observations"
    assert reason([good[0], ("b", 24, 0.5, 0.0, 3.0)], 2) == "no_dispersion" and reason([("a", 24, 2.0, 5.0, 3.0)], 1) == "radicand_not_positive"


def test_alignment_refuses(spark):
    maps = lambda m: spark.createDataFrame([(1, m)], "id int, p map<string,double>")
    with pytest.raises(Exception, match="unknown label"):
        studies.aligned_probabilities(maps({"z": 1.0}), "p", ["a"]).collect()
    with pytest.raises(Exception, match="sum to 1"):
        studies.aligned_probabilities(maps({"a": 0.5}), "p", ["a", "b"]).collect()
    values = lambda rows: spark.createDataFrame(rows, "s int, feature string, x double")
    assert studies.aligned_features(values([(1, "f", 2.0)]), ["s"], ["f", "g"]).first().lacking == 1
    for rows, why in (([(1, "f", 2.0), (1, "f", 2.0)], "two values"), ([(1, "h", 2.0)], "schema")):
        with pytest.raises(Exception, match=why):
            studies.aligned_features(values(rows), ["s"], ["f", "g"]).collect()


def test_fees_need_a_rate(spark):
    rows = spark.createDataFrame([("BTCUSDT", None), ("ETHUSDT", 1.0)], "i string, r double")
    assert [r.x for r in rows.select(portfolio.fee_rate(F.col("i"), F.col("r"), 5.5).alias("x")).collect()] == [5.5, 1.0]
    with pytest.raises(Exception, match="no fee rate"):
        rows.select(portfolio.fee_rate(F.lit("ETHUSDT"), F.lit(None).cast("double"), 5.5)).collect()
