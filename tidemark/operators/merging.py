"""Deduplication, convergence and comparison of record sets: equal or refused, never silently one of both."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accepted(bad: Column, message: str) -> Column:
    """True for every row, or an error as soon as ``bad`` holds for one that is computed."""
    return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True))


def equivalent(df: DataFrame, key: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """One row for each key; a key with two payloads raises when its row is computed. Null keys are one key, null payloads are equal."""
    one = df.groupBy(*key).agg(F.min(F.struct(*payload)).alias("lo"), F.max(F.struct(*payload)).alias("hi"))
    return one.where(accepted(~F.col("lo").eqNullSafe(F.col("hi")), "one key with two payloads")).select(*key, "lo.*")


def conflicts(df: DataFrame, key: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Keys with more than one payload, and how many."""
    return df.groupBy(*key).agg(F.count_distinct(F.struct(*payload)).alias("payloads")).where("payloads > 1")


def converge(history: DataFrame, live: DataFrame, cutover: tuple[int, str], key: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """History up to the key ``cutover``, live rows beyond it. ``key``: two columns, a time and an id.

    Up to the cutover live rows that history has as well must agree with it, else an error; those that it lacks are passed over. Repeated rows of a side are one, contradicting ones an error."""
    at, own = F.struct(F.lit(cutover[0]).cast("long").alias(key[0]), F.lit(cutover[1]).alias(key[1])), F.struct(*key)
    old, new = equivalent(history.where(own <= at), key, payload), equivalent(live, key, payload)
    early = new.where(own <= at).select(*key, F.struct(*payload).alias("mine"))
    both = old.join(early, list(key), "left").where(accepted(F.col("mine").isNotNull() & ~F.col("mine").eqNullSafe(F.struct(*payload)), "a live row contradicts history"))
    return both.select(*key, *payload).unionByName(new.where(own > at).select(*key, *payload))


def reconcile(window: DataFrame, buffered: DataFrame, anchor: tuple[int, str], payload: Sequence[str]) -> DataFrame:
    """Rows after the anchor (ts_us, trade_id) of a polled window and a live buffer; an error if the window lacks the anchor or the two share no key, or where they disagree."""
    key = ["ts_us", "trade_id"]
    at, own = F.struct(F.lit(anchor[0]).cast("long").alias("ts_us"), F.lit(anchor[1]).alias("trade_id")), F.struct(*key)
    anchored = window.agg(F.count_if(own == at).alias("anchors"))
    shared = window.join(buffered.select(*key).distinct(), key, "left_semi").agg(F.count("*").alias("shared"))
    rows = equivalent(window.select(*key, *payload).unionByName(buffered.select(*key, *payload)).where(own > at), key, payload)
    checks = F.broadcast(anchored.crossJoin(shared))  # one row
    return rows.crossJoin(checks).where(accepted(F.col("anchors") == 0, "the anchor is not in the window")).where(accepted(F.col("shared") == 0, "window and buffer do not overlap")).select(*key, *payload)


def registration(known: DataFrame, offered: DataFrame, key: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """(key..., class) of every offered key: new, idempotent (known with equal content), or conflict."""
    own = known.select(*key, F.struct(*payload).alias("theirs")).dropDuplicates(list(key))
    both = offered.groupBy(*key).agg(F.min(F.struct(*payload)).alias("mine"), F.max(F.struct(*payload)).alias("other")).join(own, list(key), "left")
    kind = F.when(~F.col("mine").eqNullSafe(F.col("other")), "conflict").when(F.col("theirs").isNull(), "new").when(F.col("mine").eqNullSafe(F.col("theirs")), "idempotent").otherwise("conflict")
    return both.select(*key, kind.alias("class"))


def window_evidence(live: DataFrame, archive: DataFrame, window: Sequence[str], key: str, payload: Sequence[str]) -> DataFrame:
    """By claimed window: records that only the archive has, that only live has, and that both have with different content."""
    side = lambda d, p: d.select(*window, key, F.struct(*payload).alias(p))
    both = side(live, "l").join(side(archive, "a"), [*window, key], "full")
    return both.groupBy(*window).agg(F.count_if(F.col("l").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("extra"), F.count_if(F.col("l").isNotNull() & F.col("a").isNotNull() & ~F.col("l").eqNullSafe(F.col("a"))).alias("conflicting"))


def repetition(df: DataFrame, key: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """(key..., copies, class): single, duplicate (equal content) or conflict."""
    own = df.groupBy(*key).agg(F.count("*").alias("copies"), F.min(F.struct(*payload)).alias("lo"), F.max(F.struct(*payload)).alias("hi"))
    kind = F.when(F.col("copies") == 1, "single").when(F.col("lo").eqNullSafe(F.col("hi")), "duplicate").otherwise("conflict")
    return own.select(*key, "copies", kind.alias("class"))


def compare(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row: keys in either side only, in both, null and repeated keys, and differences by field."""
    one = lambda d, p: d.groupBy(key).agg(F.count("*").alias(p + "n"), *[F.min(f).alias(p + f) for f in fields])
    both = one(left.where(F.col(key).isNotNull()), "l_").join(one(right.where(F.col(key).isNotNull()), "r_"), key, "full")
    met = F.col("l_n").isNotNull() & F.col("r_n").isNotNull()
    out = both.agg(
        F.count_if(met).alias("in_both"),
        F.count_if(F.col("r_n").isNull()).alias("left_only"),
        F.count_if(F.col("l_n").isNull()).alias("right_only"),
        F.count_if(F.greatest("l_n", "r_n") > 1).alias("repeated"),
        *[F.count_if(met & ~F.col("l_" + f).eqNullSafe(F.col("r_" + f))).alias("differs_" + f) for f in fields],
    )
    nulls = lambda d, n: d.agg(F.count_if(F.col(key).isNull()).alias(n))
    return out.crossJoin(nulls(left, "left_null")).crossJoin(nulls(right, "right_null"))  # three single rows
