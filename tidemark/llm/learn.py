"""Bounded samples of labelled rows, and small numpy training tools."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sample_texts(docs: DataFrame, labels: DataFrame, per_class: int, most_bytes: int) -> tuple[list[str], list]:
    """Texts and labels of at most ``per_class`` rows of each label, chosen by a hash of the id.

    ``docs`` (id, text), ``labels`` (id, label). The ids are chosen before any text is read. Null, empty and, as a bound of
    the sample, texts over ``most_bytes`` are left out. Of an id with several labels the highest counts."""
    ids = labels.where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    # a share of each label by hash, somewhat over what is needed, leaves the window few rows; labels are few
    many = {r["label"]: r["count"] for r in ids.groupBy("label").count().collect()}
    share = F.lit(0.0)
    for label, count in many.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, (1.2 * per_class + 100) / count))).otherwise(share)
    ids = ids.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < share * (1 << 30))
    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    ids = ids.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_class).select("id", "label")
    rows = docs.select("id", "text").where((F.octet_length("text") <= most_bytes) & (F.length("text") > 0))
    got = rows.join(F.broadcast(ids), "id").dropDuplicates(["id"]).orderBy(F.xxhash64("id", F.lit(7)), "id").toArrow()
    return got.column("text").to_pylist(), got.column("label").to_pylist()


def held(id_col, mod: int):
    """crc32 of the id as text, modulo ``mod``."""
    return F.crc32(id_col.cast("string")) % mod


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    """Adam steps on a dict of arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float = 0.01):
        self.p, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray], scale: float = 1.0) -> None:
        self.t += 1
        fix = np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.p[k] -= (self.rate * scale * fix) * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)


def platt(x: np.ndarray, y: np.ndarray, steps: int = 150) -> tuple[float, float]:
    """Slope and intercept of a logistic fit of y on x (Newton steps, lightly regularised)."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * x + b)
        w = p * (1 - p) + 1e-6
        g = np.array([((p - y) * x).mean() + 1e-3 * a, (p - y).mean()])
        h = np.array([[(w * x * x).mean() + 1e-3, (w * x).mean()], [(w * x).mean(), w.mean()]])
        d = np.linalg.solve(h + 1e-4 * np.eye(2), g)
        a, b = a - np.clip(0.5 * d[0], -0.3, 0.3), b - np.clip(0.5 * d[1], -0.5, 0.5)
    return float(a), float(b)


def strings(texts: list) -> pa.Array:
    return pa.array(texts, pa.string())
