"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .learn import held, sample_texts, strings
from .shared import frees, small_batches, tidy

BUCKETS, WIDTH = 8192, 16
#: Training sample: rows of each language, and the longest text taken into it.
PER_CLASS, SAMPLE_BYTES = 1000, 30_000
_MARK = np.full(256, 32, np.uint8)  # all that is no letter is a word's edge
for _r in (range(97, 123), range(128, 256)):
    _MARK[list(_r)] = list(_r)


def subword_counts(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, counts): the hashed subwords of 2 to 4 bytes, with word edges, of runs of lower-cased texts."""
    raw, off = K.text_buffers(pc.utf8_lower(texts.cast(pa.large_string())))
    at = 0
    while at < len(off) - 1:
        to = max(at + 1, min(int(np.searchsorted(off, off[at] + (K.PIECE >> 1), "right")) - 1, at + 400))
        counts = np.zeros((to - at) * BUCKETS, np.float32)
        lo = int(off[at])
        while lo < off[to]:  # long texts in pieces: only subwords are cut at a piece's edge, which a copied margin mends
            hi = min(int(off[to]), lo + K.PIECE)
            part = _MARK[raw[lo : min(hi + 3, int(off[to]))]]
            doc = np.searchsorted(off, np.arange(lo, hi), "right") - 1 if to - at > 1 else None
            last = off[doc + 1] if doc is not None else np.full(hi - lo, off[to])
            base = (doc - at) * BUCKETS if doc is not None else 0
            code = part.astype(np.uint32)
            gap = part == 32
            roll = code.copy()
            inner = np.zeros(len(part), bool)
            for n in (2, 3, 4):
                size = min(hi - lo, len(part) - n + 1)
                if size <= 0:
                    break
                roll = roll[:size] | (code[n - 1 : n - 1 + size] << np.uint32(8 * (n - 1)))
                if n > 2:
                    inner = inner[:size] | gap[n - 2 : n - 2 + size]
                else:
                    inner = np.zeros(size, bool)
                ok = ~(inner | (gap[:size] & gap[n - 1 : n - 1 + size]))
                ok &= np.arange(lo + n, lo + n + size) <= last[:size]
                bucket = ((roll * np.uint32(2654435761) + np.uint32(n * 40503)) * np.uint32(2246822519) >> np.uint32(19)).astype(np.int64)
                counts += np.bincount((bucket + (base[:size] if doc is not None else 0))[ok], minlength=len(counts)).astype(np.float32)
            lo = hi
        yield at, to, counts.reshape(to - at, BUCKETS)
        at = to


def _averaged(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


class Rows:
    """Rows of mostly zeros, kept without them."""

    def __init__(self, blocks: Iterable[np.ndarray]):
        self.rows = []
        for block in blocks:
            for row in block:
                at = np.flatnonzero(row)
                self.rows.append((at.astype(np.uint16), row[at]))

    def __getitem__(self, which: np.ndarray) -> np.ndarray:
        out = np.zeros((len(which), BUCKETS), np.float32)
        for i, j in enumerate(which):
            at, value = self.rows[j]
            out[i, at] = value
        return out


class Model:
    """Trained on texts and languages; without any, every answer is ``und`` with score 0."""

    def __init__(self, texts: list[str], langs: list[str], epochs: int = 12, rate: float = 20.0, seed: int = 5, reject: float = 0.001):
        self.langs = sorted(set(langs))
        self.temperature, self.threshold = 1.0, 0.0
        if not self.langs:
            return
        x = Rows(_averaged(c) for _, _, c in subword_counts(strings(texts)))
        y = np.array([self.langs.index(v) for v in langs])
        rng = np.random.default_rng(seed)
        n, k = len(y), len(self.langs)
        self.embed = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
        self.weight = rng.normal(0, 0.1, (WIDTH, k)).astype(np.float32)
        self.bias = np.zeros(k, np.float32)
        test = np.arange(n) % 5 == 4 if n >= 20 else np.zeros(n, bool)
        train = np.flatnonzero(~test)
        total, done = epochs * -(-len(train) // 32), 0
        for _ in range(epochs):
            rng.shuffle(train)
            for i in range(0, len(train), 32):
                own = train[i : i + 32]
                rows = x[own]
                h = rows @ self.embed
                p = self._softmax(h @ self.weight + self.bias)
                p[np.arange(len(own)), y[own]] -= 1
                p /= len(own)
                step = rate * (1 - done / total)
                back = p @ self.weight.T
                self.weight -= 0.1 * step * (h.T @ p)
                self.bias -= 0.1 * step * p.sum(axis=0)
                self.embed -= step * (rows.T @ back)
                done += 1
        check = np.flatnonzero(test) if test.any() else train
        z = np.concatenate([(x[check[i : i + 256]] @ self.embed) @ self.weight for i in range(0, len(check), 256)]) + self.bias
        nll = lambda t: -np.log(self._softmax(z / t)[np.arange(len(check)), y[check]] + 1e-12).mean()
        self.temperature = min(np.geomspace(0.25, 4, 33), key=nll)
        p = self._softmax(z / self.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == y[check]]
        if len(right):  # of right answers a share of ``reject`` at most lies below; sure answers are never rejected
            self.threshold = float(min(np.quantile(right, reject), 0.5))

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected) of every text; ``und``, 0 and rejected without any letter."""
        names, scores = [], []
        for a, b, counts in subword_counts(texts):
            if not self.langs:
                names += ["und"] * (b - a)
                scores.append(np.zeros(b - a))
                continue
            p = self._softmax(((_averaged(counts) @ self.embed) @ self.weight + self.bias) / self.temperature)
            names += [self.langs[i] for i in p.argmax(axis=1)]
            scores.append(p.max(axis=1).astype(float))
        score = np.concatenate(scores) if scores else np.zeros(0)
        letter = np.array(pc.match_substring_regex(texts.cast(pa.large_string()), r"\pL").fill_null(False), bool)
        score = np.where(letter, score, 0.0)
        return [n if ok else "und" for n, ok in zip(names, letter, strict=True)], score, ~letter | (score < self.threshold)


def train(docs: DataFrame, learn=None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_class: int = PER_CLASS) -> Model:
    """A model of the languages in ``docs``; ``learn``: a condition on the rows to learn from. Null languages teach nothing."""
    rows = docs if learn is None else docs.where(learn)
    rows = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("label"))
    model = Model(*sample_texts(rows, rows.select("id", "label"), per_class, SAMPLE_BYTES))
    tidy(docs.sparkSession)
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) of every row. The whole text counts.

    Null, empty and letterless texts: ``und``, score 0, rejected. Ties go to the first language by name. Repeated rows and
    null ids give rows of their own; other columns are ignored."""
    small_batches(docs.sparkSession)
    held_model = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS * WIDTH floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, score, rejected = held_model.value.predict(b.column(1))
            yield pa.record_batch([b.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["id", "lang_pred", "score", "rejected"])

    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(frees(run), f"id {kind}, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language the model doesn't reject."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    held_model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = b.filter(pa.array(~held_model.value.predict(b.column(at))[2], pa.bool_()))
            if good.num_rows:
                yield good

    return docs.mapInArrow(frees(run), docs.schema)


__all__ = ["Model", "train", "identify", "keep_identified", "held"]
