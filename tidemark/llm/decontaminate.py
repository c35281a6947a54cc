"""Benchmark decontamination: SimHash of item-sized windows, a multi-index over Hamming blocks, exact verification.

For a benchmark item of n words, the windows of n words of every document (the whole document, if it is shorter) get a 64-bit
SimHash of their words. The items' fingerprints are indexed by RADIUS + 1 blocks of bits: any fingerprint within RADIUS bits
equals an item's in one block at least, so the index finds all of them. A found window is verified by the weighted
Jaccard similarity of its word shingles (a shingle weighs as often as it occurs). Windows that
hold no shingle of any item have similarity 0 and get no fingerprint.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import frees, small_batches

U = np.uint64
#: Hamming radius of the fingerprints, of 64 bits.
RADIUS = 11
#: Items (of at most ITEM_BYTES in all) that are indexed at once; more items take more passes.
ITEMS, ITEM_BYTES = 20_000, 32 << 20


class Index:
    """A block of benchmark items. Items without words never match."""

    def __init__(self, ids: list[int], texts: list[str | None], k: int = 5, similarity: float = 0.8, radius: int = RADIUS):
        self.ids, self.k, self.similarity, self.radius = np.array(ids, np.int64), k, similarity, radius
        raw, off = K.text_buffers(pa.array(texts, pa.string()))
        w = K.words(raw, off)
        self.size = w.counts
        h, first = K.shingles(w, k)
        self.weights = [Counter(h[a:b].tolist()) for a, b in zip(first[:-1], first[1:], strict=True)]
        self.sketch = K.simhash_spans(w.hash, w.first[:-1], w.first[1:])
        owner = np.repeat(np.arange(len(ids)), np.diff(first))
        self.anchors: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for width in np.unique(np.minimum(self.size, k)[self.size > 0]).tolist():
            own = np.flatnonzero(np.minimum(self.size, k)[owner] == width)
            pairs = np.unique(np.stack([h[own], owner[own].astype(U)], 1), axis=0) if len(own) else np.zeros((0, 2), U)
            values, at = np.unique(pairs[:, 0], return_index=True)
            sieve = np.zeros(1 << 20, bool)
            sieve[values & U((1 << 20) - 1)] = True
            self.anchors[width] = (values, np.append(at, len(pairs)), pairs[:, 1].astype(np.int64), sieve)
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            code = self._code(self.size, self.sketch, lo, hi)
            order = np.argsort(code, kind="stable")
            self.blocks.append((lo, hi, code[order], order))

    @staticmethod
    def _code(size: np.ndarray, sketch: np.ndarray, lo: int, hi: int) -> np.ndarray:
        return (size.astype(U) << U(32)) | ((sketch >> U(lo)) & U((1 << (hi - lo)) - 1))

    def _windows(self, w: K.Words, sh: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, size) of the windows with a shingle of an item of that size; positions are word numbers."""
        keys = []
        doc = None
        for width, (values, at, items, sieve) in self.anchors.items():
            h, first = sh[width]
            hit = np.flatnonzero(sieve[h & U((1 << 20) - 1)])
            if not len(hit):
                continue
            k = np.searchsorted(values, h[hit])
            ok = (k < len(values)) & (values[np.minimum(k, len(values) - 1)] == h[hit])
            hit, k = hit[ok], k[ok]
            if not len(hit):
                continue
            d = np.searchsorted(first, hit, "right") - 1
            p = w.first[d] + hit - first[d]
            many = at[k + 1] - at[k]
            src = np.repeat(np.arange(len(hit)), many)
            item = items[np.repeat(at[k] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())]
            n = self.size[item]
            lo = np.maximum(p[src] - n + width, w.first[d[src]])
            hi = np.minimum(p[src], w.first[d[src] + 1] - n)
            short = hi < lo  # the document is shorter than the item
            lo = np.where(short & (hi < w.first[d[src]]), w.first[d[src]], lo)
            hi = np.maximum(hi, lo)
            trio = np.unique(np.stack([lo, hi, n, d[src]], 1), axis=0)
            span = trio[:, 1] - trio[:, 0] + 1
            start = np.repeat(trio[:, 0] - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum())
            keys.append(np.stack([start, np.repeat(trio[:, 2], span), np.repeat(trio[:, 3], span)], 1))
        if not keys:
            none = np.zeros(0, np.int64)
            return none, none, none
        key = np.unique(np.concatenate(keys), axis=0)
        start, size, doc = key[:, 0], key[:, 1], key[:, 2]
        return start, np.minimum(start + size, w.first[doc + 1]), size

    def search(self, col: pa.Array) -> list[dict[int, float]]:
        """For each text the items that it holds, with the highest similarity of a window."""
        out: list[dict[int, float]] = [{} for _ in range(len(col))]
        raw, off = K.text_buffers(col)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(off, off[at] + K.PIECE, "right")) - 1)
            self._search(raw[off[at] : off[to]], off[at : to + 1] - off[at], out, at)
            at = to
        return out

    def _search(self, raw: np.ndarray, off: np.ndarray, out: list[dict[int, float]], base: int) -> None:
        w = K.words(raw, off)
        sh = {width: K.shingles(w, width, whole=width == self.k) for width in self.anchors}
        start, end, size = self._windows(w, sh)
        if not len(start):
            return
        doc = np.searchsorted(w.first, start, "right") - 1
        some = np.unique(doc)  # only their words are fingerprinted
        keep = np.concatenate([np.arange(w.first[d], w.first[d + 1]) for d in some.tolist()])
        shift = np.searchsorted(keep, start) - start
        sketch = K.simhash_spans(w.hash[keep], start + shift, end + shift)
        found = []
        for lo, hi, code, order in self.blocks:
            own = self._code(size, sketch, lo, hi)
            a, b = np.searchsorted(code, own, "left"), np.searchsorted(code, own, "right")
            many = b - a
            src = np.repeat(np.arange(len(own)), many)
            item = order[np.repeat(a - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())]
            near = np.bitwise_count(sketch[src] ^ self.sketch[item]) <= self.radius
            found.append(np.stack([src[near], item[near]], 1))
        for s, i in np.unique(np.concatenate(found), axis=0).tolist():
            width = min(self.k, int(self.size[i]))
            if end[s] - start[s] < width:
                continue
            h, first = sh[width]
            d = int(doc[s])
            p = first[d] + start[s] - w.first[d]
            mine, item = Counter(h[p : p + end[s] - start[s] - width + 1].tolist()), self.weights[i]
            least = sum(min(c, item[x]) for x, c in mine.items())
            most = sum(mine.values()) + sum(item.values()) - least
            if least >= self.similarity * most - 1e-9:
                got, key = out[base + d], int(self.ids[i])
                got[key] = max(got.get(key, 0.0), least / most)


def _indexes(benchmark: DataFrame, id_col: str, text_col: str, k: int, similarity: float) -> Iterator[Index]:
    rows = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").alias("t")).where("i is not null and t is not null")
    count, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    parts = max(1, -(-count // ITEMS), -(-size // ITEM_BYTES))
    for part in range(parts):
        own = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part).toArrow()
        yield Index(own.column("i").to_pylist(), own.column("t").to_pylist(), k, similarity)


def find_leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, items, similarities): for every row of ``docs`` the benchmark items found in it, by id, and their best similarity.

    Null and empty texts hold nothing; null or word-less items and items with a null id are never found. Of items with
    equal ids the best counts; equal texts under two ids are both found. Repeated rows give repeated rows. Other columns are
    ignored, whatever their names. Without items, the lists are empty."""
    small_batches(docs.sparkSession)
    out = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.expr("array()").cast("array<long>").alias("items"), F.expr("array()").cast("array<double>").alias("similarities"))
    schema = out.schema
    for index in _indexes(benchmark, item_col, item_text_col, k, similarity):
        where = docs.sparkSession.sparkContext.broadcast(index)  # at most ITEMS items of ITEM_BYTES

        def run(batches: Iterator[pa.RecordBatch], where=where) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = where.value.search(b.column(1))
                for g, items, best in zip(got, b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    for i, s in zip(items, best, strict=True):
                        g[i] = max(g.get(i, 0.0), s)
                lists = [sorted(g.items()) for g in got]
                yield pa.record_batch([b.column(0), b.column(1), pa.array([[i for i, _ in x] for x in lists], pa.list_(pa.int64())), pa.array([[s for _, s in x] for x in lists], pa.list_(pa.float64()))], ["id", "text", "items", "similarities"])

        out = out.mapInArrow(frees(run), schema)
    return out.select("id", "items", "similarities")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, similarity: float = 0.8, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark item (see find_leaks)."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    out = docs
    for index in _indexes(benchmark, item_col, item_text_col, k, similarity):
        where = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], where=where) -> Iterator[pa.RecordBatch]:
            for b in batches:
                clean = b.filter(pa.array([not g for g in where.value.search(b.column(at))], pa.bool_()))
                if clean.num_rows:
                    yield clean

        out = out.mapInArrow(frees(run), docs.schema)
    return out
