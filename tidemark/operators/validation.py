"""Walk-forward folds, leakage classification, uniqueness weights, robust comparison of trials."""

from __future__ import annotations

import math
from itertools import combinations
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EULER = 0.5772156649015329


def walk_forward(spark: SparkSession, start: int, first_test: int, test: int, folds: int) -> DataFrame:
    """Expanding train [start, t), adjacent test [t, t + test) for each fold."""
    t = F.lit(first_test) + F.col("id") * test
    return spark.range(folds).select(F.col("id").cast("int").alias("fold"), F.lit(start).cast("long").alias("train_start"), t.alias("test_start"), (t + test).alias("test_end"))


def classify(candidates: DataFrame, folds: DataFrame, embargo: int) -> DataFrame:
    """(candidate_id, fold, class) of every candidate and fold. The folds (some tens) are broadcast: a fixed list.

    Candidates: decision, support_start, support_end, available, sufficient. Out of fold, unavailable, insufficient, purged,
    embargoed and admitted, in this order; test-side candidates are never purged or embargoed."""
    rows = candidates.crossJoin(F.broadcast(folds))
    d = F.col("decision")
    train = d < F.col("test_start")
    kind = (
        F.when((d < F.col("train_start")) | (d >= F.col("test_end")), "OUT_OF_FOLD")
        .when(F.col("available").isNull() | (F.col("available") > d), "UNAVAILABLE")
        .when(~F.coalesce("sufficient", F.lit(False)), "INSUFFICIENT_SUPPORT")
        .when(train & (F.col("support_start") < F.col("test_end")) & (F.col("test_start") < F.col("support_end")), "PURGED")
        .when(train & (d >= F.col("test_start") - embargo), "EMBARGOED")
        .otherwise("ADMITTED")
    )
    return rows.select("candidate_id", "fold", kind.alias("class"))


def lockbox_guard(candidates: DataFrame, start: int, end: int, revealed: bool) -> DataFrame:
    """A decision inside the holdout is refused always, an overlapping support only until the reveal."""
    inside = (F.col("decision") >= start) & (F.col("decision") < end)
    overlap = (F.col("support_start") < end) & (F.col("support_end") > start)
    return candidates.withColumn("refused", inside | (overlap & F.lit(not revealed)))


def uniqueness(samples: DataFrame, key: list[str]) -> DataFrame:
    """Mean of 1 / concurrency over each sample's support [start, end), by time; an empty support weighs 1.

    Boundaries cut time into segments; a running sum of opens less closes is the concurrency, and prefix sums of length / concurrency at the
    boundaries give each support's integral, so samples and segments are never paired."""
    live = samples.where("start < end")
    steps = live.select(*key, F.col("start").alias("t"), F.lit(1).alias("d")).union(live.select(*key, "end", F.lit(-1)))
    steps = steps.groupBy(*key, "t").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*key).orderBy("t")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumns({"open": F.sum("d").over(upto), "nxt": F.lead("t").over(w)})
    steps = steps.withColumn("area", F.when((F.col("open") > 0) & F.col("nxt").isNotNull(), (F.col("nxt") - F.col("t")) / F.col("open")).otherwise(0.0))
    before = F.coalesce(F.sum("area").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    at = steps.select(*key, "t", before.alias("area"))
    out = samples.join(at.withColumnsRenamed({"t": "start", "area": "a0"}), [*key, "start"], "left").join(at.withColumnsRenamed({"t": "end", "area": "a1"}), [*key, "end"], "left")
    weight = F.when(F.col("start") >= F.col("end"), 1.0).otherwise((F.col("a1") - F.col("a0")) / (F.col("end") - F.col("start")))
    return out.withColumn("weight", weight).drop("a0", "a1")


def moments(returns: DataFrame, by: list[str], value: str = "r") -> DataFrame:
    """Observations, Sharpe ratio (sample deviation), skewness and Pearson kurtosis of each trial."""
    return returns.groupBy(*by).agg(
        F.count(value).alias("t"),
        F.when(F.stddev_samp(value) > 0, F.avg(value) / F.nullif(F.stddev_samp(value), F.lit(0.0))).alias("sharpe"),
        F.skewness(value).alias("skew"),
        (F.kurtosis(value) + 3).alias("kurtosis"),
    )


def deflated_sharpe(sharpe: float, t: int, skew: float, kurtosis: float, deviation: float, trials: float) -> tuple[float, float]:
    """(expected maximum, probability) for the selected trial; ValueError names why it can't be evaluated."""
    if t < 4:
        raise ValueError("too few observations")
    if trials < 1 or 1 < trials < 2:
        raise ValueError("number of effective trials out of range")
    n = NormalDist()
    expected = 0.0 if trials == 1 else deviation * ((1 - EULER) * n.inv_cdf(1 - 1 / trials) + EULER * n.inv_cdf(1 - 1 / (trials * math.e)))
    radicand = 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe**2
    if radicand <= 0:
        raise ValueError("radicand is not positive")
    return expected, n.cdf((sharpe - expected) * math.sqrt(t - 1) / math.sqrt(radicand))


def overfitting(panel: DataFrame, blocks: int, ties: str = "mean") -> DataFrame:
    """One row per split of the blocks into halves: in-sample winner, its out-of-sample rank and logit.

    ``panel``: trial, pos (0-based), r, equal length for every trial. Block edges are dealt over the whole length: blocks differ by one observation at most. Block sums are grouped first;
    splits (a fixed, small list) meet blocks, not observations. Means and deviations follow from counts, means and squared deviations of blocks.
    A half with a return that isn't finite has the Sharpe ratio NaN: it never wins while another trial has a number, and out of sample it ranks above all. Equal ratios (to 12 decimals, for the last bits depend on the order of sums), NaN too, share the mean of their ranks; with ``ties="order"`` they rank in the order of trials."""
    if ties not in ("mean", "order"):
        raise ValueError("ties must be mean or order")
    spark = panel.sparkSession
    per_trial = panel.groupBy("trial").agg(F.count("*").alias("n"))
    least, length, trials = per_trial.agg(F.min("n"), F.max("n"), F.count("*")).first()
    if trials < 2 or least != length:
        raise ValueError("at least two trials of equal length are needed")
    if blocks < 4 or blocks % 2 or length < blocks or length // blocks * (blocks // 2) < 2:
        raise ValueError("blocks must be even, at least 4, and no more than the observations")
    own = panel.groupBy("trial", F.expr(f"cast(pos * {blocks}L div {length} as int)").alias("block")).agg(F.count("*").alias("n"), F.avg("r").alias("m"), (F.var_pop("r") * F.count("*")).alias("s2"))
    splits = [(i, b, b in chosen) for i, chosen in enumerate(combinations(range(blocks), blocks // 2)) for b in range(blocks)]
    table = F.broadcast(spark.createDataFrame(splits, "split int, block int, inside boolean"))
    half = own.join(table, "block").groupBy("split", "trial", "inside").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum("s2").alias("s2"), F.collect_list(F.struct("n", "m")).alias("parts"))
    half = half.withColumn("between", F.expr("aggregate(parts, 0D, (a, x) -> a + x.n * (x.m - mean) * (x.m - mean))"))
    half = half.withColumn("sharpe", F.col("mean") / F.nullif(F.sqrt((F.col("s2") + F.col("between")) / (F.col("n") - 1)), F.lit(0.0))).withColumn("sharpe", F.round("sharpe", 12))
    order = F.struct(F.col("sharpe").isNull().alias("none"), (-F.col("sharpe")).alias("s"), F.col("trial").alias("n"))  # NaN, and then null, last
    winner = half.where("inside").groupBy("split").agg(F.min_by("trial", order).alias("trial"))
    w = Window.partitionBy("split").orderBy("sharpe", "trial")
    rank = F.avg("n").over(Window.partitionBy("split", "sharpe")) if ties == "mean" else F.col("n").cast("double")
    ranked = half.where("not inside").withColumn("n", F.row_number().over(w)).withColumn("rank", rank).withColumn("trials", F.count("*").over(Window.partitionBy("split")))
    omega = F.col("rank") / (F.col("trials") + 1)
    return ranked.join(winner, ["split", "trial"]).select("split", F.col("trial").alias("winner"), "rank", F.log(omega / (1 - omega)).alias("logit"))
