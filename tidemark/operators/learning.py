"""A small supervised baseline: normalisation, weighted nearest centroid, classification metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fit_normalizer(train: DataFrame) -> DataFrame:
    """Mean and population deviation of each feature (sample_id, feature, x); a deviation below 1e-12 becomes 1."""
    sd = F.stddev_pop("x")
    return train.groupBy("feature").agg(F.avg("x").alias("mean"), F.when(sd < 1e-12, 1.0).otherwise(sd).alias("scale"))


def normalize(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """The fitted table has one row for each feature of a fixed schema."""
    return rows.join(F.broadcast(fitted), "feature").withColumn("x", (F.col("x") - F.col("mean")) / F.col("scale")).drop("mean", "scale")


def centroids(train: DataFrame) -> DataFrame:
    """Weighted mean of each feature by class: (label, feature, centre)."""
    return train.groupBy("label", "feature").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("centre"))


def predict(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """(sample_id, label, p): shares of 1 / (1 + squared distance); exact hits share all. Centres are classes times features."""
    d = rows.select("sample_id", "feature", "x").join(F.broadcast(centres), "feature").groupBy("sample_id", "label").agg(F.sum((F.col("x") - F.col("centre")) ** 2).alias("d2"))
    w = Window.partitionBy("sample_id")
    hits = F.sum(F.when(F.col("d2") == 0, 1.0).otherwise(0.0)).over(w)
    score = 1 / (1 + F.col("d2"))
    d = d.withColumns({"hits": hits, "score": score})
    p = F.when(F.col("hits") > 0, F.when(F.col("d2") == 0, 1.0 / F.col("hits")).otherwise(0.0)).otherwise(F.col("score") / F.sum("score").over(w))
    return d.withColumn("p", p).select("sample_id", "label", "p")


def top_prediction(p: DataFrame) -> DataFrame:
    """The likeliest label of each sample; ties go to the smaller label."""
    w = Window.partitionBy("sample_id").orderBy(F.desc("p"), "label")
    return p.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def confusion(pairs: DataFrame) -> DataFrame:
    """(label, predicted, n) of pairs (label, predicted)."""
    return pairs.groupBy("label", "predicted").agg(F.count("*").alias("n"))


def class_metrics(pairs: DataFrame) -> DataFrame:
    """Support, precision, recall and F1 of each class; 0 where a denominator is 0."""
    cells = confusion(pairs)
    true = cells.groupBy(F.col("label").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hits"))
    said = cells.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("said"))
    both = true.join(said, "class", "full").fillna(0, ["support", "hits", "said"])
    share = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.col(b))
    both = both.withColumns({"precision": share("hits", "said"), "recall": share("hits", "support")})
    f1 = F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return both.withColumn("f1", f1).select("class", "support", "precision", "recall", "f1")
