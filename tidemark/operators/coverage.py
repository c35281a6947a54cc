"""Declared coverage: containment, folds of assertions, supersession, chains, integrity of a scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import intervals


def contained(points: DataFrame, covered: DataFrame, key: Sequence[str], at: str, cell: int) -> DataFrame:
    """``points`` with ``inside``: whether a covered interval (key..., start, end) holds the instant. Intervals are merged and dealt to cells, so the join is an equality."""
    number = lambda c: F.floor((c - F.pmod(c, F.lit(cell))) / cell)
    spans = intervals.merge(covered.select(*key, "start", "end"), key)
    cells = spans.select(*key, F.col("start").alias("__start"), F.col("end").alias("__end"), F.explode(F.sequence(number(F.col("start")), number(F.col("end") - 1))).alias("__cell"))
    spans_of = cells.groupBy(*key, "__cell").agg(F.collect_list(F.struct("__start", "__end")).alias("__spans"))  # disjoint within a cell
    both = points.withColumn("__cell", number(F.col(at))).join(spans_of, [*key, "__cell"], "left")
    return both.withColumn("inside", F.coalesce(F.exists("__spans", lambda s: (s["__start"] <= F.col(at)) & (F.col(at) < s["__end"])), F.lit(False))).drop("__cell", "__spans")


def clipped(spans: DataFrame, key: Sequence[str], within: DataFrame) -> DataFrame:
    """The parts of ``spans`` inside ``within`` (one interval a key)."""
    asked = within.select(*key, F.col("start").alias("lo"), F.col("end").alias("hi"))
    own = spans.join(asked, list(key)).where("start < hi and end > lo")
    return own.select(*key, F.greatest("start", "lo").alias("start"), F.least("end", "hi").alias("end"))


def islands_after(covered: DataFrame, key: Sequence[str], resume: str) -> DataFrame:
    """Merged coverage from the resume instant of each key on."""
    spans = intervals.merge(covered.select(*key, "start", "end"), key)
    points = covered.groupBy(*key).agg(F.max(resume).alias("from"))
    return spans.join(points, list(key)).where(F.col("end") > F.col("from")).select(*key, F.greatest("start", "from").alias("start"), "end")


def gap_events(islands: DataFrame, key: Sequence[str]) -> DataFrame:
    """For every gap between islands an OPEN at its lower and a CLOSED at its upper bound, numbered along the key."""
    w = Window.partitionBy(*key).orderBy("start")
    gaps = islands.withColumn("lower", F.lag("end").over(w)).where("lower is not null and start > lower").withColumn("gap", F.row_number().over(w))
    both = F.array(F.struct(F.lit("OPEN").alias("kind"), F.col("lower").alias("at")), F.struct(F.lit("CLOSED").alias("kind"), F.col("start").alias("at")))
    return gaps.select(*key, "gap", F.explode(both).alias("e")).select(*key, "gap", "e.kind", "e.at")


def chains(spans: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key..., chain, pieces, start, end): runs of intervals that each begin where the one before ends."""
    w = Window.partitionBy(*key).orderBy("start", "end")
    rows = spans.withColumn("breaks", F.when(F.col("start").eqNullSafe(F.lag("end").over(w)), 0).otherwise(1))
    rows = rows.withColumn("chain", F.sum("breaks").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*key, "chain").agg(F.count("*").alias("pieces"), F.min("start").alias("start"), F.max("end").alias("end"))


def overlaps(partitions: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    """Partitions that begin before an earlier one (by start, end, name) has ended."""
    w = Window.partitionBy(*key).orderBy("start", "end", name)
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return partitions.withColumn("reach", before).where("start < reach").select(*key, name, "start", "end", "reach")


def folded(assertions: DataFrame, partition: Sequence[str]) -> DataFrame:
    """Per partition the complete assertions (status, start, end; observed first and last) folded to one interval, and what is wrong with it.

    fault: no_complete, not_contiguous, contradicted (a known gap inside), observed_outside, or null."""
    part = list(partition)
    whole = intervals.merge(assertions.where("status = 'complete'").select(*part, "start", "end"), part)
    spans = whole.groupBy(*part).agg(F.count("*").alias("spans"), F.min("start").alias("start"), F.max("end").alias("end"))
    holes = assertions.where("status = 'known_gap'").select(*part, F.col("start").alias("gap_start"), F.col("end").alias("gap_end"))
    denied = holes.join(spans, part).where("gap_start < end and start < gap_end").groupBy(*part).agg(F.count("*").alias("denials"))
    seen = assertions.groupBy(*part).agg(F.min("first").alias("first"), F.max("last").alias("last"))
    rows = seen.join(spans, part, "left").join(denied, part, "left")
    fault = (
        F.when(F.col("spans").isNull(), "no_complete").when(F.col("spans") > 1, "not_contiguous").when(F.col("denials") > 0, "contradicted").when((F.col("first") < F.col("start")) | (F.col("last") >= F.col("end")), "observed_outside")
    )
    return rows.select(*part, "start", "end", fault.alias("fault"))


def heads(documents: DataFrame) -> DataFrame:
    """(id, live, fault) of documents (id, supersedes): live are those that none supersedes. fault: duplicate, self, unknown, forked (two successors of one), or null."""
    rows = documents.groupBy("id").agg(F.count("*").alias("copies"), F.max("supersedes").alias("supersedes"))
    after = documents.where("supersedes is not null").groupBy(F.col("supersedes").alias("id")).agg(F.count_distinct("id").alias("successors"))
    known = rows.select(F.col("id").alias("supersedes"), F.lit(True).alias("there"))
    both = rows.join(after, "id", "left").join(known, "supersedes", "left").join(after.toDF("supersedes", "siblings"), "supersedes", "left")
    fault = F.when(F.col("copies") > 1, "duplicate").when(F.col("supersedes") == F.col("id"), "self").when(F.col("supersedes").isNotNull() & F.col("there").isNull(), "unknown").when(F.col("siblings") > 1, "forked")
    return both.select("id", F.col("successors").isNull().alias("live"), fault.alias("fault"))


def scan_report(rows: DataFrame, key: Sequence[str], order: str, strict: Sequence[str], at: str, covered: DataFrame, cell: int) -> DataFrame:
    """Per key: rows, first and last instant, rows out of strict key order, repeated keys, rows outside the declared coverage."""
    w = Window.partitionBy(*key).orderBy(order)
    own = contained(rows, covered, key, at, cell).withColumn("disorder", F.coalesce(F.struct(*strict) <= F.lag(F.struct(*strict)).over(w), F.lit(False)))
    out = own.groupBy(*key).agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"), F.count_if("disorder").alias("disordered"), F.count_if(~F.col("inside")).alias("outside"))
    again = rows.groupBy(*key, *strict).count().groupBy(*key).agg(F.count_if(F.col("count") > 1).alias("repeated"))
    return out.join(again, list(key))


def matched_once(claims: DataFrame, manifests: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key..., manifests, matched) of every claimed partition: it must have exactly one manifest."""
    n = manifests.groupBy(*key).agg(F.count("*").alias("n"))
    return claims.select(*key).distinct().join(n, list(key), "left").select(*key, F.coalesce("n", F.lit(0)).alias("manifests"), F.coalesce(F.col("n") == 1, F.lit(False)).alias("matched"))


def rollup(datasets: DataFrame, partitions: DataFrame, key: Sequence[str], states: Sequence[str]) -> DataFrame:
    """Number of partitions of each state for every dataset, those without any included."""
    n = partitions.groupBy(*key).pivot("state", list(states)).count()
    return datasets.select(*key).join(n, list(key), "left").na.fill(0, list(states))


def proof(expected: DataFrame, observed: DataFrame, by: Sequence[str], identity: Sequence[str]) -> DataFrame:
    """Per ``by`` whether the observed identities are exactly the expected ones, each FINAL: missing, unexpected, provisional, proven."""
    both = expected.select(*by, *identity, F.lit(True).alias("wanted")).join(observed.select(*by, *identity, "lifecycle", F.lit(True).alias("there")), [*by, *identity], "full")
    n = lambda c: F.count_if(c)
    out = both.groupBy(*by).agg(n(F.col("there").isNull()).alias("missing"), n(F.col("wanted").isNull()).alias("unexpected"), n(F.col("there").isNotNull() & ~F.col("lifecycle").eqNullSafe("FINAL")).alias("provisional"))
    return out.withColumn("proven", (F.col("missing") == 0) & (F.col("unexpected") == 0) & (F.col("provisional") == 0))


def transitions(rows: DataFrame, key: Sequence[str], order: Sequence[str], state: str, first: str, allowed: dict[str, Sequence[str]]) -> DataFrame:
    """``rows`` with ``previous`` (``first`` before the first) and ``legal``: whether the table allows the step."""
    w = Window.partitionBy(*key).orderBy(*order)
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, to in sorted(allowed.items()) for b in to])
    out = rows.withColumn("previous", F.coalesce(F.lag(state).over(w), F.lit(first)))
    return out.withColumn("legal", F.array_contains(pairs, F.concat("previous", F.lit(">"), F.col(state))))
