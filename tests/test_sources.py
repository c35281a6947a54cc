import gzip
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.functions.checks import ViolationError, bounded
from tidemark.functions.instants import format_ns, parse_duration, parse_ns
from tidemark.sources import catalog, trades as T
from tidemark.streaming.candles import live_candles


def rows_of(spark, rows):
    return spark.createDataFrame([("sim", "X", t, p, "1", "buy", None, i, None) for t, p, i in rows], T.TRADE)


def test_instants(spark):
    texts = ["1970-01-01T00:00:00Z", "2024-01-15T10:04:59.999999999Z", "1969-12-31T23:59:59.5Z"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_ns(F.col("t")).alias("n"), format_ns(parse_ns(F.col("t"))).alias("t")).collect()
    assert [r.t for r in rows] == texts and [r.n for r in rows][0] == 0 and rows[2].n == -500_000_000
    assert [parse_duration(x) for x in (5, "5m", "100ms", "01:00:00.5")] == [5, 300 * 10**9, 10**8, 3600 * 10**9 + 5 * 10**8]


def test_gateway(spark, tmp_path):
    for name, rows in {"a": [(5, "10", "1"), (7, "11", "2")], "b": [(12, "12", "3")]}.items():
        assert T.write_trades(rows_of(spark, rows), f"{tmp_path}/{name}")["row_count"] == len(rows)
    with pytest.raises(ViolationError):
        T.write_trades(rows_of(spark, [(5, "0", "1")]), f"{tmp_path}/bad")
    with pytest.raises(ViolationError):
        T.write_trades(rows_of(spark, [(5, "1", "1"), (5, "1", "1")]), f"{tmp_path}/bad")
    parts = spark.createDataFrame([("d", "k1", 1, "valid", "a", 0, 10), ("d", "k2", 1, "valid", "b", 10, 15), ("d", "k3", 1, "degraded", "b", 15, 20)], "dataset string, partition_key string, revision int, state string, rel_path string, start long, end long")
    g = catalog.Gateway(str(tmp_path), parts)
    assert [r.trade_id for r in g.read(catalog.Request("d", 6, 13)).collect()] == ["2", "3"]
    with pytest.raises(ViolationError, match="gaps"):
        g.scan(catalog.Request("d", 0, 20))
    assert g.scan(catalog.Request("d", 0, 20, allow_partial=True)).gaps == ((15, 20),)
    plan = g.scan(catalog.Request("d", 6, 13)).rows._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(exchange_ts,6)" in plan
    with pytest.raises(ViolationError):
        T.safe_path("/r", "../x")
    with pytest.raises(ViolationError):
        bounded(spark.range(5), 4)


def test_archives(spark, tmp_path):
    head = "timestamp,symbol,side,size,price,tickDirection,trdMatchID,grossValue,homeNotional,foreignNotional\n"
    with gzip.open(tmp_path / "d.csv.gz", "wt") as f:
        f.write(head + "1705276800.4921,X,Buy,0.5,10.1,Plus,u1,1,1,1\n1705276801,X,Sell,1,10,Plus,u2,1,1,1\n")
    rows = T.read_archive_day(spark, f"{tmp_path}/d.csv.gz", "X", "2024-01-15").orderBy("exchange_ts").collect()
    assert [r.exchange_ts for r in rows] == [1705276800492000000, 1705276801000000000]
    with pytest.raises(ViolationError):
        T.read_archive_day(spark, f"{tmp_path}/d.csv.gz", "Y", "2024-01-15")
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("x.jsonl", '{"a":1}\n{"a":2}\n')
    assert [(r.line, r.value) for r in T.read_zipped_lines(spark, f"{tmp_path}/d.zip").collect()] == [(1, '{"a":1}'), (2, '{"a":2}')]
    with sqlite3.connect(tmp_path / "d.db") as db:
        db.execute("create table t (a integer, b text)")
        db.executemany("insert into t values (?, ?)", [(i, str(i)) for i in range(10)])
    got = T.read_sqlite(spark, f"{tmp_path}/d.db", "select a, b from t where a >= ? and a < ? order by a", "a long, b string", [(0, 5), (5, 9)])
    assert [r.a for r in got.orderBy("a").collect()] == list(range(9))
    T.write_json_lines(got, f"{tmp_path}/j")
    assert spark.read.text(f"{tmp_path}/j").count() == 9


def test_stream_equals_batch_and_refuses_late(spark, tmp_path):
    schema = "kind string, instrument string, ts_us long, until_us long, trade_id string, price double, size double"
    batches = [
        [("trade", "X", 5, None, "1", 10.0, 1.0), ("trade", "X", 3, None, "2", 9.0, 1.0), ("trade", "X", 12, None, "3", 8.0, 2.0)],
        [("mark", "X", 10, None, None, None, None), ("gap", "X", 21, 25, None, None, None)],
        [("trade", "X", 4, None, "4", 7.0, 1.0), ("trade", "X", 22, None, "5", 7.0, 1.0), ("mark", "X", 40, None, None, None, None)],
    ]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{i}")
    out = []
    for i in range(3):  # one file at a time, resumed from the checkpoint
        for f in (tmp_path / f"in{i}").glob("*.parquet"):
            (tmp_path / "src").mkdir(exist_ok=True)
            f.rename(tmp_path / "src" / f"{i}-{f.name}")
        q = live_candles(spark.readStream.schema(schema).parquet(f"{tmp_path}/src"), 10).writeStream.outputMode("append").foreachBatch(lambda d, n: out.extend(d.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(120)
    rows = [(r.bucket_us, r.open, r.close, r.volume, r.state) for r in out]
    assert rows == [(0, 9.0, 10.0, 2.0, "CLOSED"), (0, 7.0, 7.0, 1.0, "LATE"), (10, 8.0, 8.0, 2.0, "CLOSED")]
