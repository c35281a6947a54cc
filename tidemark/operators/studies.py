"""Labels, comparison of trials, whole-model metrics and alignment to fixed schemas."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import threshold_class
from .validation import EULER


def labelled(outcomes: DataFrame, value: str, thresholds: Sequence[float], state: str = "state") -> DataFrame:
    """``outcomes`` with label_state and label: complete ones get the right-open bin of their value, others say why they have none."""
    known = {"COMPLETE": "LABELED", "CENSORED": "NO_VALUE_CENSORED", "INSUFFICIENT_COVERAGE": "NO_VALUE_INSUFFICIENT"}
    kind = F.coalesce(*[F.when(F.col(state) == a, b) for a, b in known.items()], F.raise_error(F.lit("unknown outcome state")).cast("string"))
    return outcomes.withColumn("label_state", kind).withColumn("label", F.when(F.col(state) == "COMPLETE", threshold_class(F.col(value), thresholds)))


def dependency(labels: DataFrame, start: str, end: str) -> DataFrame:
    """What a label depends on: its support [start, end + 1), known when its fold completes."""
    return labels.withColumns({"support_start": F.col(start), "support_end": F.col(end) + 1, "cutoff": F.lit("FOLD_COMPLETION")})


def expected_factor(trials: float) -> float:
    """Expected maximum of ``trials`` standard normal values: the factor of the dispersion."""
    n = NormalDist()
    return 0.0 if trials == 1 else (1 - EULER) * n.inv_cdf(1 - 1 / trials) + EULER * n.inv_cdf(1 - 1 / (trials * math.e))


def deflated(trials: DataFrame, effective: float) -> DataFrame:
    """One row of ``trials`` (trial, t, sharpe, skew, kurtosis): the selected trial (highest Sharpe ratio, NaN above all, then smallest name), dispersion, expected maximum, z, and why it can't be evaluated.

    The deflated Sharpe ratio is the normal probability below z. reason: no_trials, non_evaluable_trial, too_few_observations, trials_out_of_range, no_dispersion, radicand_not_positive, or null."""
    best = F.min_by(F.struct("trial", "t", "sharpe", "skew", "kurtosis"), F.struct((~F.isnan("sharpe")).alias("o"), (-F.col("sharpe")).alias("s"), F.col("trial").alias("n")))
    out = trials.agg(F.count("*").alias("n"), F.count("sharpe").alias("good"), best.alias("b"), F.coalesce(F.stddev_samp("sharpe"), F.lit(0.0)).alias("dispersion"), F.min("t").alias("least"))
    sr, out_of_range = F.col("b.sharpe"), F.lit(effective < 1 or 1 < effective < 2) | (F.lit(effective) > F.col("n"))
    top = F.col("dispersion") * (0.0 if effective < 1 or 1 < effective < 2 else expected_factor(effective))
    radicand = 1 - F.col("b.skew") * sr + (F.col("b.kurtosis") - 1) / 4 * sr * sr
    reason = (
        F.when(F.col("n") == 0, "no_trials").when(F.col("good") < F.col("n"), "non_evaluable_trial").when(F.col("least") < 4, "too_few_observations").when(out_of_range, "trials_out_of_range")
        .when((F.col("n") > 1) & (F.col("dispersion") == 0), "no_dispersion").when(radicand <= 0, "radicand_not_positive")
    )
    out = out.select(F.col("b.trial").alias("selected"), sr.alias("sharpe"), F.col("b.t").alias("t"), "dispersion", top.alias("expected_max"), radicand.alias("radicand"), reason.alias("reason"))
    z = (F.col("sharpe") - F.col("expected_max")) * F.sqrt(F.col("t") - 1) / F.sqrt("radicand")
    return out.withColumn("z", F.when(F.col("reason").isNull(), z)).drop("radicand")


def overfitting_probability(splits: DataFrame) -> DataFrame:
    """One row: number of splits, and the share whose winner has a logit below 0 out of sample."""
    return splits.agg(F.count("*").alias("splits"), F.avg(F.when(F.col("logit") < 0, 1.0).otherwise(0.0)).alias("pbo"))


def overall(per_class: DataFrame) -> DataFrame:
    """One row of class_metrics' result: rows, accuracy, and the plain means of precision, recall and F1 over the classes."""
    hits = F.col("recall") * F.col("support")
    return per_class.agg(F.sum("support").alias("n"), (F.sum(hits) / F.sum("support")).alias("accuracy"), *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")])


def brier(rows: DataFrame, label: str, p: str, labels: Sequence[str]) -> DataFrame:
    """One row: mean over the rows of the squared differences of the probabilities (map) and the label, over all labels."""
    loss = sum((F.pow(F.coalesce(F.try_element_at(p, F.lit(x)), F.lit(0.0)).cast("double") - F.when(F.col(label) == x, 1.0).otherwise(0.0), 2) for x in labels), F.lit(0.0))
    return rows.agg(F.count("*").alias("n"), F.avg(loss).alias("brier"))


def aligned_probabilities(rows: DataFrame, p: str, labels: Sequence[str]) -> DataFrame:
    """The map ``p`` (label to decimal) as one column p_<label> each; missing labels are 0, unknown ones and sums other than 1 raise."""
    own = {x: F.coalesce(F.try_element_at(p, F.lit(x)), F.lit(0)).cast("decimal(20,10)") for x in labels}
    unknown = F.size(F.array_except(F.map_keys(p), F.array(*[F.lit(x) for x in labels]))) > 0
    total = sum(own.values(), F.lit(0).cast("decimal(20,10)"))
    ok = F.when(unknown, F.raise_error(F.lit("unknown label")).cast("boolean")).when(total != 1, F.raise_error(F.lit("probabilities do not sum to 1")).cast("boolean")).otherwise(F.lit(True))
    return rows.where(ok).withColumns({f"p_{x}": c for x, c in own.items()}).drop(p)


def aligned_features(values: DataFrame, sample: Sequence[str], schema: Sequence[str]) -> DataFrame:
    """Values (sample..., feature, x) as one column for each feature of the fixed schema, and how many of them a sample lacks. Two values of one feature, or one that the schema lacks, raise."""
    cell = lambda f: F.max(F.when(F.col("feature") == f, F.col("x")))
    known = F.count_if(F.col("feature").isin(*schema))
    out = values.groupBy(*sample).agg(*[cell(f).alias(f) for f in schema], F.count("*").alias("__n"), F.count_distinct("feature").alias("__d"), known.alias("__k"))
    ok = F.when(F.col("__n") != F.col("__d"), F.raise_error(F.lit("two values of one feature")).cast("boolean")).when(F.col("__k") != F.col("__n"), F.raise_error(F.lit("feature is not in the schema")).cast("boolean")).otherwise(F.lit(True))
    return out.where(ok).withColumn("lacking", sum((F.col(f).isNull().cast("int") for f in schema), F.lit(0))).drop("__n", "__d", "__k")


def population(members: DataFrame, attempts: DataFrame, key: str, metric: str, done: str) -> DataFrame:
    """(key, metric, reason) of every member of the closed population: the best metric of its completed attempts, or why it has none (no_attempt, not_completed)."""
    best = attempts.groupBy(key).agg(F.max(F.when(F.col(done), F.col(metric))).alias(metric), F.lit(True).alias("tried"))
    rows = members.select(key).join(best, key, "left")
    return rows.select(key, metric, F.when(F.col("tried").isNull(), "no_attempt").when(F.col(metric).isNull(), "not_completed").alias("reason"))
