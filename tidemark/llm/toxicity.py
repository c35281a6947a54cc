"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

A text is cut into overlapping windows of WINDOW words, STRIDE apart. A word's input is the embedding of its hash and the mean
embedding of its hashed character trigrams. The network scores every window; a text scores as its worst window,
calibrated on the training texts. Gradients are written out in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .learn import Adam, platt, sample_texts, sigmoid, strings

WINDOW, STRIDE = 16, 12
WORDS, CHARS, WIDTH, HIDDEN, LOOK = 8192, 4096, 8, 8, 8
PER_CLASS, SAMPLE_BYTES = 1000, 8_000
_EDGE = np.zeros(256, bool)  # words here are runs of letters and digits
_EDGE[:128] = True
_EDGE[[*range(48, 58), *range(65, 91), *range(97, 123), 39]] = False


class Pieces:
    """Words of a batch as inputs: the distinct words' buckets, each word's number among them, and the windows."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        w = K.words(raw, off, boundary=_EDGE)
        unique, at, self.word = np.unique(w.hash, return_index=True, return_inverse=True)
        self.bucket = (unique & np.uint64(WORDS - 1)).astype(np.int64)
        start, size = w.start[at], w.end[at] - w.start[at] + 2  # with a mark on both ends
        self.grams = np.maximum(size - 2, 0)
        total = np.concatenate([[0], np.cumsum(size)])
        text = np.full(total[-1] + 2, 32, np.uint32)
        owner = np.repeat(np.arange(len(at)), size - 2)
        inner = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(size - 2)[:-1]]), size - 2) if len(at) else owner
        text[total[:-1][owner] + 1 + inner] = K._LOWER[raw[start[owner] + inner]] if len(owner) else 0
        spot = total[:-1][owner] + inner
        code = (text[spot] | (text[spot + 1] << np.uint32(8)) | (text[spot + 2] << np.uint32(16))) * np.uint32(2654435761)
        self.gram = (code >> np.uint32(20)).astype(np.int64)
        self.gram_of = owner
        n = w.counts
        many = np.where(n <= WINDOW, 1, 1 + -(-(n - WINDOW) // STRIDE))
        self.first = np.concatenate([[0], np.cumsum(many)])
        doc = np.repeat(np.arange(len(n)), many)
        begin = w.first[doc] + (np.arange(self.first[-1]) - self.first[doc]) * STRIDE
        self.at = begin[:, None] + np.arange(WINDOW)
        self.real = self.at < w.first[doc + 1][:, None]
        self.token = np.where(self.real, np.append(self.word, 0)[np.minimum(self.at, len(self.word))], 0)


def pieces(texts: pa.Array) -> Iterator[Pieces]:
    raw, off = K.text_buffers(texts)
    at = 0
    while at < len(off) - 1:
        to = max(at + 1, int(np.searchsorted(off, off[at] + (K.PIECE >> 1), "right")) - 1)
        yield Pieces(raw[off[at] : off[to]], off[at : to + 1] - off[at])
        at = to


class Model:
    """Trained on texts and 0/1 labels; with fewer than two labels every score is the share of label 1 (0 without any)."""

    def __init__(self, texts: list[str], labels: list[int], epochs: tuple[int, int] = (2, 3), seed: int = 11):
        y = np.array([int(v) == 1 for v in labels], float)
        self.p, self.slope, self.offset, self.constant = None, 1.0, 0.0, float(y.mean()) if len(y) else 0.0
        if len(set(labels)) < 2:
            return
        rng = self.rng = np.random.default_rng(seed)
        f = lambda *s: rng.normal(0, s[0] ** -0.5, s).astype(np.float32)
        self.p = {"word": rng.normal(0, 0.1, (WORDS, WIDTH)).astype(np.float32), "char": rng.normal(0, 0.3, (CHARS, WIDTH)).astype(np.float32), "a": f(2 * HIDDEN, LOOK), "q": f(LOOK, 1), "o": f(2 * HIDDEN, 1), "b": np.zeros(1, np.float32)}
        for way in "fb":
            self.p |= {"x" + way: f(2 * WIDTH, 3 * HIDDEN), "h" + way: f(HIDDEN, 3 * HIDDEN), "c" + way: np.zeros(3 * HIDDEN, np.float32)}
        all_ = Pieces(*K.text_buffers(strings(texts)))
        doc = np.repeat(np.arange(len(y)), np.diff(all_.first))
        test = np.arange(len(y)) % 5 == 4
        adam = Adam(self.p, 0.01)
        turns = -(-len(all_.token) // 256)  # a small sample is gone through more often
        epochs = (max(epochs[0], min(12, 400 // turns)), max(epochs[1], min(12, 400 // turns)))
        total = sum(epochs)
        for epoch in range(total):
            if epoch < epochs[0]:  # every window has its text's label
                rows = np.flatnonzero(~test[doc])
            else:  # the worst window of each text, and windows of clean texts that look bad
                z = self._all(all_)
                worst = np.array([all_.first[d] + z[all_.first[d] : all_.first[d + 1]].argmax() for d in range(len(y))])
                hard = np.flatnonzero((y[doc] == 0) & (z > -3) & ~test[doc])
                some = np.flatnonzero((y[doc] == 0) & ~test[doc])
                rows = np.concatenate([np.repeat(worst[(y == 1) & ~test], 3), worst[(y == 0) & ~test], rng.permutation(hard)[:6000], rng.permutation(some)[:3000]])
            target = y[doc[rows]]
            weight = np.where(target == 1, 0.5 / max(target.mean(), 1e-6), 0.5 / max(1 - target.mean(), 1e-6))
            order = rng.permutation(len(rows))
            for i in range(0, len(rows), 256):
                own = order[i : i + 256]
                self._step(adam, all_, rows[own], target[own], weight[own], 1 - 0.8 * epoch / total)
        z = self._all(all_)
        top = np.maximum.reduceat(z, all_.first[:-1])
        use = test if len(set(y[test])) == 2 else np.ones(len(y), bool)
        self.slope, self.offset = platt(top[use], y[use])
        self.slope = max(self.slope, 0.1)

    # -- network
    def _inputs(self, c: Pieces) -> np.ndarray:
        mean = np.zeros((len(c.bucket), WIDTH), np.float32)
        if len(c.gram):
            for j in range(WIDTH):
                mean[:, j] = np.bincount(c.gram_of, self.p["char"][c.gram, j], minlength=len(c.bucket))
        mean /= np.maximum(c.grams, 1)[:, None]
        return np.concatenate([self.p["word"][c.bucket], mean], axis=1)

    def _scan(self, x: np.ndarray, real: np.ndarray, way: str, keep: bool):
        """Hidden states (step, window, unit) in one direction. x: projected inputs (window, step, 3 * HIDDEN)."""
        u = self.p["h" + way]
        n, steps, _ = x.shape
        h = np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((steps, n, HIDDEN), np.float32)
        saved = []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            zr = 0.5 + 0.5 * np.tanh(0.5 * (x[:, t, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN]))
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            m = np.tanh(x[:, t, 2 * HIDDEN :] + (r * h) @ u[:, 2 * HIDDEN :])
            on = real[:, t, None]
            new = np.where(on, h + z * (m - h), h)
            if keep:
                saved.append((t, h, z, r, m, on))
            h = new
            out[t] = h
        return out, saved

    def _pool(self, hf: np.ndarray, hb: np.ndarray, real: np.ndarray):
        h = np.concatenate([hf, hb], axis=2)  # (step, window, 2 * HIDDEN)
        k = np.tanh(h @ self.p["a"])
        s = np.where(real.T, (k @ self.p["q"])[:, :, 0], -1e9)
        s = np.exp(s - s.max(axis=0))
        s = np.where(real.T, s, 0)
        s /= np.maximum(s.sum(axis=0), 1e-9)
        pooled = (s[:, :, None] * h).sum(axis=0)
        return h, k, s, pooled, (pooled @ self.p["o"])[:, 0] + self.p["b"][0]

    def _all(self, c: Pieces) -> np.ndarray:
        """The logit of every window."""
        x = self._inputs(c)
        proj = {w: x @ self.p["x" + w] + self.p["c" + w] for w in "fb"}
        out = np.zeros(len(c.token), np.float32)
        if not len(x):
            out[:] = self.p["b"][0]
            return out
        for i in range(0, len(c.token), 4096):
            token, real = c.token[i : i + 4096], c.real[i : i + 4096]
            hf, hb = (self._scan(proj[w][token], real, w, False)[0] for w in "fb")
            out[i : i + 4096] = self._pool(hf, hb, real)[-1]
        return out

    def _step(self, adam: Adam, c: Pieces, rows: np.ndarray, y: np.ndarray, weight: np.ndarray, scale: float) -> None:
        p, real = self.p, c.real[rows]
        used, token = np.unique(c.token[rows], return_inverse=True)
        token = token.reshape(real.shape)
        lo, hi = np.searchsorted(c.gram_of, used), np.searchsorted(c.gram_of, used, "right")
        pick = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)]) if len(used) else lo
        gram, owner = c.gram[pick], np.repeat(np.arange(len(used)), hi - lo)
        mean = np.zeros((len(used), WIDTH), np.float32)
        np.add.at(mean, owner, p["char"][gram])
        size = np.maximum(hi - lo, 1)[:, None].astype(np.float32)
        seen = (self.rng.random((len(used), 1)) < 0.6).astype(np.float32) / 0.6  # without some words, their characters must do
        x = np.concatenate([p["word"][c.bucket[used]] * seen, mean / size], axis=1)
        hidden, saved = {}, {}
        for w in "fb":
            hidden[w], saved[w] = self._scan((x @ p["x" + w] + p["c" + w])[token], real, w, True)
        h, k, s, pooled, logit = self._pool(hidden["f"], hidden["b"], real)
        d = ((sigmoid(logit) - y) * weight / len(y)).astype(np.float32)
        g = {"o": (pooled.T @ d)[:, None], "b": d.sum(keepdims=True)}
        dp = d[:, None] * p["o"].T
        ds = (dp[None] * h).sum(axis=2)
        ds = s * (ds - (s * ds).sum(axis=0))
        dk = ds[:, :, None] * p["q"].T * (1 - k * k)
        g["q"] = np.einsum("twl,tw->l", k, ds)[:, None]
        g["a"] = np.einsum("twi,twl->il", h, dk)
        dh_all = s[:, :, None] * dp[None] + dk @ p["a"].T
        dx = np.zeros((len(used), 2 * WIDTH), np.float32)
        for j, w in enumerate("fb"):
            u = p["h" + w]
            dh = np.zeros((len(rows), HIDDEN), np.float32)
            du, dc, flow = np.zeros_like(u), np.zeros(3 * HIDDEN, np.float32), np.zeros((len(used), 3 * HIDDEN), np.float32)
            for t, before, z, r, m, on in reversed(saved[w]):
                dh = dh + dh_all[t][:, j * HIDDEN : (j + 1) * HIDDEN]
                own = np.where(on, dh, 0)
                dm = own * z * (1 - m * m)
                drh = dm @ u[:, 2 * HIDDEN :].T
                dz = own * (m - before) * z * (1 - z)
                dr = drh * before * r * (1 - r)
                dzr = np.concatenate([dz, dr], axis=1)
                du[:, : 2 * HIDDEN] += before.T @ dzr
                du[:, 2 * HIDDEN :] += (r * before).T @ dm
                full = np.concatenate([dzr, dm], axis=1)
                np.add.at(flow, token[:, t], full)
                dh = np.where(on, dh * (1 - z) + drh * r, dh) + dzr @ u[:, : 2 * HIDDEN].T
            dc = flow.sum(axis=0)
            g |= {"h" + w: du, "c" + w: dc, "x" + w: x.T @ flow}
            dx += flow @ p["x" + w].T
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(g["word"], c.bucket[used], dx[:, :WIDTH] * seen)
        np.add.at(g["char"], gram, (dx[:, WIDTH:] / size)[owner])
        adam.step(g, scale)
        for name in ("word", "char"):  # what few windows need fades
            p[name] *= 1 - 0.004 * scale

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.p is None:
            return np.full(len(texts), self.constant)
        out = []
        for c in pieces(texts):
            out.append(np.maximum.reduceat(self._all(c), c.first[:-1]))
        return sigmoid(self.slope * (np.concatenate(out) if out else np.zeros(0)) + self.offset).astype(float)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", learn=None, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Model:
    """Learns from the rows of ``labels`` that meet the condition ``learn``; labels other than 0 and 1 are left out. Score the
    model with ``quality.score``: a null text is empty, and an empty text is one window without words."""
    own = (labels if learn is None else labels.where(learn)).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("label in (0, 1)")
    return Model(*sample_texts(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), own, per_class, SAMPLE_BYTES))
