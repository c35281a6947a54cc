"""The read boundary: catalog lookup, partition pruning, declared coverage, gaps, ordered and verified results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checks import ViolationError, require_none
from ..operators import intervals
from .trades import safe_path, scan_trades

#: The partition states that each lifecycle policy admits.
LIFECYCLE = {"valid": ("valid",), "closed": ("valid", "closed"), "degraded": ("valid", "closed", "degraded")}


@dataclass(frozen=True)
class Request:
    dataset: str
    start: int
    end: int
    lifecycle: str = "valid"
    allow_partial: bool = False


@dataclass(frozen=True)
class Result:
    rows: DataFrame
    partitions: tuple[str, ...]
    covered: tuple[tuple[int, int], ...]
    gaps: tuple[tuple[int, int], ...]


class Gateway:
    """``partitions``: dataset, partition_key, revision, state, rel_path, start, end (nanoseconds, half-open coverage)."""

    def __init__(self, root: str, partitions: DataFrame):
        self.root, self.partitions = root, partitions

    def select(self, request: Request) -> DataFrame:
        """Partitions that meet the request, the last revision of each key, in order."""
        rows = self.partitions.where((F.col("dataset") == request.dataset) & (F.col("end") > request.start) & (F.col("start") < request.end) & F.col("state").isin(*LIFECYCLE[request.lifecycle]))
        last = rows.groupBy("partition_key").agg(F.max_by(F.struct(*rows.columns), "revision").alias("x")).select("x.*")
        return last.orderBy("start", "end", "partition_key")

    def scan(self, request: Request) -> Result:
        """The request's rows, from its partitions' files alone. Gaps raise unless partial results are allowed."""
        chosen = self.select(request)
        within = chosen.sparkSession.createDataFrame([(request.dataset, request.start, request.end)], "dataset string, start long, end long")
        key = ["dataset"]
        missing = tuple((r.start, r.end) for r in intervals.gaps(chosen.select("dataset", "start", "end"), key, within).orderBy("start").collect())
        if missing and not request.allow_partial:
            raise ViolationError(f"coverage has gaps: {missing}")
        merged = intervals.merge(chosen.select("dataset", "start", "end"), key).orderBy("start").collect()
        files = [r.rel_path for r in chosen.collect()]
        if not files:
            raise ViolationError("no partition covers the request")
        rows = scan_trades(chosen.sparkSession, [safe_path(self.root, f) for f in files], request.start, request.end)
        return Result(rows, tuple(files), tuple((max(r.start, request.start), min(r.end, request.end)) for r in merged), missing)

    def read(self, request: Request) -> DataFrame:
        """As ``scan``, verified to have strictly increasing keys and in their order."""
        rows = self.scan(request).rows
        require_none(rows.groupBy("exchange_ts", "trade_id").count().where("count > 1"), "repeated keys")
        return rows.orderBy("exchange_ts", "trade_id")
