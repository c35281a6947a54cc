"""Quality: attention-based multiple-instance learning over all passages of a document.

A passage is PASSAGE words. Its hashed character trigrams and surface statistics are encoded by a learned layer; gated
attention, learned from document labels alone, weighs the passages; the weighted sum is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .learn import Adam, platt, sample_texts, sigmoid, strings
from .shared import frees, small_batches

PASSAGE, BUCKETS, WIDTH, GATE = 48, 1024, 16, 8
PER_CLASS, SAMPLE_BYTES = 1500, 12_000
_KIND = np.zeros(256, np.uint8)
_KIND[48:58] = 1
_KIND[65:91] = 2
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3


def passages(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, features, first): the passages of runs of texts; text d has passages first[d]:first[d+1], one at least."""
    raw, off = K.text_buffers(texts)
    at = 0
    while at < len(off) - 1:
        to = max(at + 1, int(np.searchsorted(off, off[at] + (K.PIECE >> 1), "right")) - 1)
        part, own = raw[off[at] : off[to]], off[at : to + 1] - off[at]
        w = K.words(part, own, lower=False)
        n = w.counts
        many = np.maximum(1, -(-n // PASSAGE))
        first = np.concatenate([[0], np.cumsum(many)])
        doc = np.repeat(np.arange(to - at), many)
        start = w.first[doc] + (np.arange(first[-1]) - first[doc]) * PASSAGE
        end = np.minimum(start + PASSAGE, w.first[doc + 1])
        x = np.zeros((first[-1], BUCKETS + 8), np.float32)
        size = (end - start).astype(np.float32)
        full = end > start
        if len(w.hash):
            lo, hi = np.where(full, w.start[np.minimum(start, len(w.start) - 1)], 0), np.where(full, w.end[np.maximum(end - 1, 0)], 0)
            length = np.maximum(hi - lo, 1).astype(np.float32)
            step = max(1, (4 << 20) // BUCKETS)
            for i in range(0, first[-1], step):  # trigram histograms, a few thousand passages at a time
                a, b = lo[i : i + step], hi[i : i + step]
                used = np.flatnonzero(b > a)
                if not len(used):
                    continue
                s, e = int(a[used[0]]), int(b[used[-1]])
                seg = part[s:e].astype(np.uint32)
                if len(seg) < 3:
                    continue
                code = (seg[:-2] | (seg[1:-1] << np.uint32(8)) | (seg[2:] << np.uint32(16))) * np.uint32(2654435761)
                owner = np.repeat(used, np.diff(np.append(a[used], e)))[: len(code)] * BUCKETS
                got = np.bincount(owner + (code >> np.uint32(22)), minlength=len(a) * BUCKETS)
                x[i : i + step, :BUCKETS] = np.sqrt(got[: len(a) * BUCKETS].reshape(len(a), BUCKETS) / length[i : i + step, None])
            kind = _KIND[part]
            for j, k in enumerate((1, 2, 3)):
                total = np.concatenate([[0], np.cumsum(kind == k)])
                x[:, BUCKETS + j] = (total[hi] - total[lo]) / length
            same = np.zeros(len(w.hash) + 1)
            same[2:] = np.cumsum(w.hash[1:] == w.hash[:-1])
            x[:, BUCKETS + 3] = np.where(full, same[np.maximum(end, 0)] - same[np.minimum(start + 1, len(same) - 1)], 0) / np.maximum(size, 1)
            x[:, BUCKETS + 4] = np.where(full, length / np.maximum(size, 1) / 10, 0)
            order = np.lexsort((w.hash, np.repeat(np.arange(first[-1]), (end - start))))
            passage_of = np.repeat(np.arange(first[-1]), (end - start))
            h = w.hash[order]
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (passage_of[1:] != passage_of[:-1])
            x[:, BUCKETS + 5] = np.bincount(passage_of[fresh], minlength=first[-1]) / np.maximum(size, 1)
        x[:, BUCKETS + 6] = size / PASSAGE
        x[:, BUCKETS + 7] = 1
        yield at, to, x, first
        at = to


class Model:
    """Trained on texts and 0/1 labels; with fewer than two labels every score is the share of label 1 (0.5 without any)."""

    def __init__(self, texts: list[str], labels: list[int], epochs: int = 8, seed: int = 3):
        self.p, self.slope, self.offset = None, 1.0, 0.0
        y = np.array([int(v) == 1 for v in labels], float)
        self.constant = float(y.mean()) if len(y) else 0.5
        if len(set(labels)) < 2:
            return
        feats, firsts, base = [], [np.zeros(1, np.int64)], 0
        for _, _, x, first in passages(strings(texts)):
            feats.append(x.astype(np.float16))
            firsts.append(first[1:] + base)
            base += first[-1]
        x, first = np.concatenate(feats), np.concatenate(firsts)
        rng = np.random.default_rng(seed)
        f = lambda *s: rng.normal(0, s[0] ** -0.5, s).astype(np.float32)
        self.p = {"e": f(BUCKETS + 8, WIDTH), "v": f(WIDTH, GATE), "u": f(WIDTH, GATE), "w": f(GATE, 1), "o": f(WIDTH, 1), "b": np.zeros(1, np.float32)}
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        test = np.arange(len(y)) % 5 == 4
        train, adam = np.flatnonzero(~test), Adam(self.p, 0.01)
        for epoch in range(epochs):
            rng.shuffle(train)
            for i in range(0, len(train), 32):
                own = train[i : i + 32]
                rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in own])
                self._step(adam, x[rows].astype(np.float32), np.concatenate([[0], np.cumsum(first[own + 1] - first[own])]), y[own], weight[own], 1 - epoch / epochs)
        z = np.concatenate([self._forward(x[first[d] : first[d + 1]].astype(np.float32), np.array([0, first[d + 1] - first[d]]))[-1] for d in np.flatnonzero(test)])
        if len(set(y[test])) == 2:
            self.slope, self.offset = platt(z, y[test])
            self.slope = max(self.slope, 0.1)

    def _forward(self, x: np.ndarray, first: np.ndarray):
        p = self.p
        h = np.tanh(x @ p["e"])
        t, g = np.tanh(h @ p["v"]), sigmoid(h @ p["u"])
        a = ((t * g) @ p["w"])[:, 0]
        n = np.diff(first)
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, first[:-1]), n))
        a /= np.repeat(np.add.reduceat(a, first[:-1]), n)
        z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
        return h, t, g, a, z, (z @ p["o"])[:, 0] + p["b"][0]

    def _step(self, adam: Adam, x, first, y, weight, scale) -> None:
        p = self.p
        h, t, g, a, z, logit = self._forward(x, first)
        d = ((sigmoid(logit) - y) * weight / len(y)).astype(np.float32)
        n = np.diff(first)
        dz = np.repeat(d[:, None] * p["o"].T, n, axis=0)
        da = (dz * h).sum(axis=1)
        ds = a * (da - np.repeat(np.add.reduceat(a * da, first[:-1]), n))
        dtg = ds[:, None] * p["w"].T
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ p["v"].T + dg @ p["u"].T) * (1 - h * h)
        adam.step({"e": x.T @ dh + 1e-5 * p["e"], "v": h.T @ dt, "u": h.T @ dg, "w": ((t * g).T @ ds)[:, None], "o": (z.T @ d)[:, None], "b": d.sum(keepdims=True)}, scale)

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.p is None:
            return np.full(len(texts), self.constant)
        out = [self._forward(x, first)[-1] for _, _, x, first in passages(texts)]
        return sigmoid(self.slope * (np.concatenate(out) if out else np.zeros(0)) + self.offset).astype(float)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", learn=None, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Model:
    """Learns from the rows of ``labels`` that meet the condition ``learn``; labels other than 0 and 1 are left out."""
    own = (labels if learn is None else labels.where(learn)).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("label in (0, 1)")
    return Model(*sample_texts(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), own, per_class, SAMPLE_BYTES))


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row: 0 to 1, higher if label 1 is likelier.

    A null text is empty; an empty text is one passage without words. Repeated rows and null ids give rows of their own. Other
    columns are ignored."""
    small_batches(docs.sparkSession)
    own = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(own.value.score(b.column(1)), pa.float64())], ["id", "score"])

    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return src.mapInArrow(frees(run), f"id {src.schema['id'].dataType.simpleString()}, score double")
