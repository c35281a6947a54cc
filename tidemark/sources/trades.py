"""Readers of trades and book events: fixed schemas, pushed-down time bounds, no inference."""

from __future__ import annotations

import io
import sqlite3
import zipfile
from collections.abc import Iterator, Sequence
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checks import ViolationError, duplicate_keys, require_none

TRADE = T.StructType([
    T.StructField("venue", T.StringType()),
    T.StructField("instrument", T.StringType()),
    T.StructField("exchange_ts", T.LongType()),  # nanoseconds
    T.StructField("price", T.StringType()),
    T.StructField("size", T.StringType()),
    T.StructField("aggressor_side", T.StringType()),
    T.StructField("receive_ts", T.StringType()),
    T.StructField("trade_id", T.StringType()),
    T.StructField("sequence", T.StringType()),
])
DECIMAL = r"^\d+(\.\d+)?$"
#: The sides of a trade.
SIDES = ("buy", "sell", "unknown")


def safe_path(root: str, *parts: str) -> str:
    """root/parts, refused if a part is absolute or climbs out."""
    for p in parts:
        pure = PurePosixPath(p)
        if pure.is_absolute() or ".." in pure.parts or not pure.parts:
            raise ViolationError(f"unsafe path: {p!r}")
    return "/".join([root.rstrip("/"), *parts])


def scan_trades(spark: SparkSession, paths: Sequence[str], start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """Trades of Parquet files, in [start, end) if given; the bounds reach the scan as pushed filters."""
    rows = spark.read.schema(TRADE).parquet(*paths)
    if start_ns is not None:
        rows = rows.where(F.col("exchange_ts") >= start_ns)
    return rows if end_ns is None else rows.where(F.col("exchange_ts") < end_ns)


def invalid_trades(rows: DataFrame) -> DataFrame:
    """Rows that break the trade contract, with the reason."""
    positive = lambda c: F.coalesce(F.col(c).rlike(DECIMAL) & F.col(c).rlike("[1-9]"), F.lit(False))
    reason = (
        F.when(F.col("exchange_ts").isNull(), "no time")
        .when(~positive("price"), "price")
        .when(~positive("size"), "size")
        .when(~F.coalesce(F.col("aggressor_side").isin(*SIDES), F.lit(False)), "side")
        .when(F.col("sequence").isNotNull() & ~F.col("sequence").rlike(r"^\d+$"), "sequence")
    )
    return rows.withColumn("reason", reason).where("reason is not null")


def write_trades(rows: DataFrame, path: str) -> dict:
    """Checked trades as zstd Parquet sorted by (time, id); refuses broken rows and repeated keys. Returns what a manifest needs."""
    require_none(invalid_trades(rows), "invalid trades")
    require_none(duplicate_keys(rows, ["exchange_ts", "trade_id"]), "repeated trade keys")
    rows.repartitionByRange("exchange_ts", "trade_id").sortWithinPartitions("exchange_ts", "trade_id").write.option("compression", "zstd").parquet(path)
    back = rows.sparkSession.read.schema(TRADE).parquet(path)
    n, first, last = back.agg(F.count("*"), F.min("exchange_ts"), F.max("exchange_ts")).first()
    return {"row_count": n, "first_exchange_ts": first, "last_exchange_ts": last}


def read_archive_day(spark: SparkSession, path: str, instrument: str, day: str) -> DataFrame:
    """Trades of one UTC day from a CSV (.gz) archive; time is read from text, cut to milliseconds.

    Refuses other symbols, other days, unknown sides and repeated ids."""
    names = ("timestamp", "symbol", "side", "size", "price", "tickDirection", "trdMatchID", "grossValue", "homeNotional", "foreignNotional")
    raw = spark.read.csv(path, header=True, schema=", ".join(f"{n} string" for n in names), mode="FAILFAST", enforceSchema=False)
    ms = F.split("timestamp", r"\.")[0].cast("long") * 1000 + F.substring(F.rpad(F.coalesce(F.try_element_at(F.split("timestamp", r"\."), F.lit(2)), F.lit("")), 3, "0"), 1, 3).cast("long")
    rows = raw.select("symbol", (ms * 1_000_000).alias("exchange_ts"), "price", "size", F.lower("side").alias("aggressor_side"), F.col("trdMatchID").alias("trade_id"))
    in_day = F.date_format(F.timestamp_millis(F.floor(F.col("exchange_ts") / 1_000_000)), "yyyy-MM-dd") == day
    require_none(rows.where((F.col("symbol") != instrument) | ~in_day | ~F.col("aggressor_side").isin("buy", "sell")), "rows that do not belong to the archive day")
    require_none(duplicate_keys(rows, ["trade_id"]), "repeated trade ids")
    return rows.select(F.lit(instrument).alias("instrument"), "exchange_ts", "price", "size", "aggressor_side", "trade_id")


def read_zipped_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of the text lines in zip archives, streamed; one task for each archive, as a zip can't be split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for member in z.namelist():
                        with z.open(member) as f:
                            lines, n = [], 0
                            for n, line in enumerate(f, 1):
                                lines.append(line.decode().rstrip("\n"))
                                if len(lines) == 10_000:
                                    yield _lines(name, n, lines)
                                    lines = []
                            if lines:
                                yield _lines(name, n, lines)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, line long, value string")


def _lines(name: str, last: int, lines: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([name] * len(lines)), pa.array(range(last - len(lines) + 1, last + 1), pa.int64()), pa.array(lines)], ["file", "line", "value"])


def read_sqlite(spark: SparkSession, path: str, sql: str, schema: str, partitions: Sequence[tuple]) -> DataFrame:
    """Rows of ``sql`` (one parameter tuple for each partition) from a SQLite file that every executor can open read-only."""
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    arrow = spark.createDataFrame([], schema).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                    rows = db.execute(sql, partitions[i])
                    while got := rows.fetchmany(10_000):
                        yield pa.record_batch([pa.array(c, arrow.field(k).type) for k, c in enumerate(zip(*got, strict=True))], names)

    return spark.range(0, len(partitions), 1, max(1, len(partitions))).mapInArrow(run, schema)


def write_json_lines(rows: DataFrame, path: str) -> None:
    """One JSON object a line; nulls are written, keys keep the columns' order."""
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
