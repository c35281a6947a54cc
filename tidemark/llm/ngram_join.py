"""N-gram Jaccard join: parity sketches, pigeonhole blocks per size band, exact verification.

A document's tokens are its distinct word shingles. Each token flips one bit of a bit sketch, so two sketches differ in
no more bits than the sets differ in tokens. At Jaccard similarity t, sets of a and b tokens differ in at most
r = (1 - t) / (1 + t) * (a + b) tokens; a sketch cut into r + q blocks hence agrees in q blocks at least. The
documents of two neighbouring size bands share a cutting. A block with two or more tokens is a key of the join. Blocks of
fewer tokens, which many documents share, matter only to documents with q or more of them; there they are keys in pairs, and as
q of them agree, two are among the first that an order common to all leaves (all but q - 2). In bands of long documents, where that would be
more, r / 2 + q blocks serve: in q of them the sets differ by one token at most, so keys are the blocks and the blocks
without any one token, in proportion to the length. All pairs at or above t meet in a bucket; candidates are verified on the sets
themselves. Groups come from links that span them, unless all links are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .graph import bucket_stars, similarity_groups
from .shared import broadcast_if_small, cut, frees, release, small_batches

U = np.uint64


def bands(num: int, den: int, top: int) -> np.ndarray:
    """Lower ends of the size bands: sets that can be linked are in the same or in neighbouring bands."""
    low = [1]
    while low[-1] <= top:
        low.append(low[-1] * den // num + 1)
    return np.array(low)


def _poor(n: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The expected share of ``blocks`` that have less than two of ``n`` tokens."""
    c = n / blocks
    return np.exp(-c) * (1 + c)


@lru_cache
def cuttings(num: int, den: int, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower ends of the bands, and by band: radius, blocks, spare, single). A pair whose smaller set is in the band differs in at most
    ``radius`` tokens, so at least ``spare`` blocks agree; with ``single``, they differ in one token at most.
    Of all cuttings the one with the fewest expected keys is taken."""
    low = bands(num, den, top)
    most = low[1:] - 1
    radius = (den - num) * (most + most * den // num) // (den + num)
    sizes = np.array([low[:-1], (low[:-1] + most) / 2, most, most * den / num])  # of sets that use this cutting
    best = np.full(len(most), np.inf)
    blocks, spare, single = np.zeros_like(radius), np.zeros_like(radius), np.zeros(len(most), bool)
    for share in (0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6):
        q = 2 + (radius * share).astype(int)
        m = radius + q
        p = _poor(sizes, m)
        mean, dev = m * p - q + 2, np.sqrt(m * p * (1 - p)) + 1e-9
        z = mean / dev
        tail, bell = 1 / (1 + np.exp(-1.702 * z)), np.exp(-z * z / 2) / np.sqrt(2 * np.pi)
        pairs = ((mean * mean + dev * dev) * tail + mean * dev * bell) / 2
        cost = (m * (1 - p) + 2 * pairs).mean(axis=0)
        better = cost < best
        best[better], blocks[better], spare[better] = cost[better], m[better], q[better]
    q = 2 + radius // 20
    m = radius // 2 + q
    better = (sizes + m).mean(axis=0) < best
    blocks[better], spare[better], single[better] = m[better], q[better], True
    return low, radius, blocks, spare, single


def sketch_keys(h: np.ndarray, first: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, first) of documents with the distinct tokens ``h[first[d]:first[d+1]]``."""
    n = np.diff(first)
    if not len(h):
        return np.zeros(0, U), first * 0
    top = 64
    while top < int(n.max()):
        top *= 8  # few different tables
    low, radius, by_band, spares, singles = cuttings(num, den, top)
    band = np.searchsorted(low, n, "right") - 1
    out_key, out_doc = [], []
    for back in (0, 1):
        group = band - back
        ok = (n > 0) & (group >= 0)
        group = np.clip(group, 0, None)
        ok &= radius[group] > 0
        blocks, spare, single = np.where(ok, by_band[group], 0), spares[group], singles[group]
        at = np.concatenate([[0], np.cumsum(blocks)])
        if not at[-1]:
            continue
        t, token_doc = (h, np.repeat(np.arange(len(n)), n)) if ok.all() else (h[np.repeat(ok, n)], np.repeat(np.flatnonzero(ok), n[ok]))
        where = (((t >> U(32)) * blocks[token_doc].astype(U)) >> U(32)).astype(np.int64) + at[token_doc]
        bit = K.mix((t & U(0xFFFFF)) + U(1))  # which of 2**20 bits of the block it flips
        word = np.zeros(at[-1], U)
        np.bitwise_xor.at(word, where, bit)  # two flips of a bit cancel: parity
        count = np.bincount(where, minlength=at[-1])
        doc = np.repeat(np.arange(len(n)), blocks)
        number = (np.arange(at[-1]) - np.repeat(at[:-1], blocks)).astype(U)
        salt = K.mix(((group[doc] + 1).astype(U) << U(40)) | number)
        key = K.mix(word ^ salt)
        lean = count < np.where(single[doc], 3, 2)
        poor_of = np.bincount(doc[lean], minlength=len(n))
        weak = ok & (poor_of >= spare)  # all blocks that agree may be poor
        rich = (count >= 2) | (single & weak)[doc]
        out_key.append(key[rich])
        out_doc.append(doc[rich])
        if single.any():
            left = single[token_doc] & ((count[where] >= 3) | weak[token_doc])
            out_key.append(K.mix(word[where[left]] ^ bit[left] ^ salt[where[left]]))  # the block without this token
            out_doc.append(token_doc[left])
        for d in np.flatnonzero(weak & ~single).tolist():
            k = np.sort(key[at[d] : at[d + 1]][lean[at[d] : at[d + 1]]])[: poor_of[d] - spare[d] + 2]  # two that agree are among these
            i, j = np.triu_indices(len(k), 1)
            out_key.append(K.mix(k[i] * U(3) + k[j]))
            out_doc.append(np.full(len(i), d))
    if not out_key:
        return np.zeros(0, U), first * 0
    key, doc = np.concatenate(out_key), np.concatenate(out_doc)
    order = np.argsort(doc, kind="stable")
    return key[order], np.searchsorted(doc[order], np.arange(len(n) + 1))


#: Longs of the short sketch, for up to 64 * SIFT tokens, by which candidates are sifted before their sets are read.
SIFT = 8


def short_sketch(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(short, longs, first): one parity sketch of SIFT longs a document, and for sets of more tokens than it has bits a longer one, of SIFT longs doubled until it has a bit for every token.

    A sketch folds to one of half the length by XOR of its halves, so any two can be compared; the short one is the long one folded."""
    n = np.diff(first)
    size = SIFT << np.ceil(np.log2(np.maximum(n, 1) / (64 * SIFT)).clip(0)).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    p = K.mix(h ^ U(0x5EED))
    doc = np.repeat(np.arange(len(n)), n)
    word = np.zeros(at[-1], U)
    np.bitwise_xor.at(word, at[doc] + ((p >> U(6)) & (size[doc] - 1).astype(U)).astype(np.int64), U(1) << (p & U(63)))
    short = np.bitwise_xor.reduceat(word.reshape(-1, SIFT), at[:-1] // SIFT) if len(n) else word.reshape(-1, SIFT)
    long = size > SIFT
    return short.reshape(-1), word[np.repeat(long, size)], np.concatenate([[0], np.cumsum(np.where(long, size, 0))])


def apart() -> tuple[str, str]:
    """SQL: bits in which the short sketches ``ma.s`` and ``mb.s`` differ, and bits in which the long ones ``w`` do, the longer one folded to the shorter (null if a set has none)."""
    folded = lambda m, o: f"if(size({m}.w) > size({o}.w), transform(sequence(0, size({o}.w) - 1), i -> aggregate(sequence(i, size({m}.w) - 1, size({o}.w)), 0L, (x, j) -> x ^ {m}.w[j])), {m}.w)"
    long = f"if(size(ma.w) > 0 and size(mb.w) > 0, aggregate(zip_with({folded('ma', 'mb')}, {folded('mb', 'ma')}, (x, y) -> bit_count(x ^ y)), 0, (x, y) -> x + y), null)"
    return " + ".join(f"bit_count(ma.s[{i}] ^ mb.s[{i}])" for i in range(SIFT)), long


def _slices(off: np.ndarray, most: int = K.PIECE) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(off) - 1:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, to
        at = to


def shingle_sets(col: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, hashes, first) for runs of rows: each row's distinct shingle hashes, sorted."""
    raw, off = K.text_buffers(col)
    for a, b in _slices(off):
        w = K.words(raw[off[a] : off[b]], off[a : b + 1] - off[a])
        h, first = K.distinct_sorted(*K.shingles(w, k))
        yield a, b, h, first


def classes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each document's set."""
    return K.signed(K.mix(K.segment_sum(K.mix(h), first) + np.diff(first).astype(U)))


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", all_links: bool = False) -> dict[str, DataFrame]:
    """Documents whose sets of distinct k-word shingles have Jaccard similarity of at least ``percent`` / 100.

    Returns ``members`` (id, n_shingles, class), ``links`` (a, b: pairs of classes) and ``groups`` (id, n_shingles,
    component_id). With ``all_links``, links are all pairs of different classes at or above the threshold, up to the square of a group's size;
    without it they are only as many of these as span the groups, for which no group's pairs need be formed. A class is a set of shingles, named by a 64-bit hash of it; all copies share it and are
    compared once. Null and word-less texts have n_shingles 0 and no class: they link with nothing and are their
    own component. Rows with a null id get the component of their class (null if it has no other id). Repeated rows are
    kept; rows of one id with different texts each have the component of their own text. Other columns are ignored. An empty table gives empty tables."""
    spark = docs.sparkSession
    small_batches(spark)
    num, den = percent, 100
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for a, b, h, first in shingle_sets(batch.column(1), k):
                n = np.diff(first)
                cls = classes(h, first)
                new = np.zeros(len(n), bool)  # of each set only the first copy in a task gives keys
                for i, (c, m) in enumerate(zip(cls.tolist(), n.tolist(), strict=True)):
                    if m and c not in seen:
                        seen.add(c)
                        new[i] = True
                keep = np.repeat(new, n)
                size = np.where(new, n, 0)
                short, wide, wide_at = short_sketch(h, first)
                keys, at = sketch_keys(h[keep], np.concatenate([[0], np.cumsum(size)]), num, den)
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a), pa.array(n), pa.array(cls, mask=n == 0), K.lists(pa.array(K.signed(short)), np.arange(len(n) + 1) * SIFT), K.lists(pa.array(K.signed(wide)), wide_at), K.lists(pa.array(K.signed(keys)), at)],
                    ["id", "n_shingles", "class", "sift", "wide", "keys"],
                )

    table = cut(src.mapInArrow(frees(scan), "id long, n_shingles long, class long, sift array<long>, wide array<long>, keys array<long>"), "sketch")
    entries = table.select(F.explode("keys").alias("key"), F.col("class").alias("node"))
    if all_links:
        entries = cut(entries.where("node is not null").distinct(), "entries")
    raw = bucket_stars(entries)
    marks = table.where("class is not null").groupBy(F.col("class").alias("node")).agg(F.struct(F.first("n_shingles").alias("n"), F.first("sift").alias("s"), F.first("wide").alias("w")).alias("m"))
    marks = cut(marks, "marks")
    members = cut(table.select("id", "n_shingles", "class"), "members")
    release(table)

    def candidates_of(pairs: DataFrame) -> DataFrame:
        """(class, set) of the classes in ``pairs``; their documents are read again, of rows of one id those of the class."""
        nodes = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
        one = members.where("class is not null and id is not null").groupBy("class").agg(F.min("id").alias("id"))
        want = cut(one.join(nodes, "class").select("id", "class"), "want")
        out = cut(sets(src.join(broadcast_if_small(want), "id")), "sets")
        release(want)
        return out

    def sets(texts: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, h, first in shingle_sets(batch.column(0), k):
                    out = pa.record_batch([batch.column(1).slice(a, b - a), K.lists(pa.array(K.signed(h)), first)], ["class", "tokens"])
                    yield out.filter(pa.array(classes(h, first) == out.column(0).to_numpy()))

        return texts.select("text", "class").mapInArrow(frees(run), "class long, tokens array<long>").dropDuplicates(["class"])

    def verify(near: DataFrame) -> DataFrame:
        own = candidates_of(near)
        both = near.join(own.select(F.col("class").alias("a"), F.col("tokens").alias("ta")), "a").join(own.select(F.col("class").alias("b"), F.col("tokens").alias("tb")), "b")
        both = both.withColumn("c", F.size(F.array_intersect("ta", "tb")))
        out = cut(both.where(f"100L * c >= {num}L * (size(ta) + size(tb) - c)").select("a", "b"), "links")
        release(own)
        return out

    # the sketches differ in no more bits than the sets in tokens
    short, long = apart()
    most = f"(ma.n + mb.n) * {den - num}"
    near = f"100 * least(ma.n, mb.n) >= {num} * greatest(ma.n, mb.n) and ({short}) * {den + num} <= {most} and coalesce(({long}) * {den + num} <= {most}, true)"
    comp, links = similarity_groups(raw, marks, near, verify)
    if all_links:
        side = lambda node, mark: entries.select("key", F.col("node").alias(node)).join(marks.toDF(node, mark), node)
        pairs = cut(side("a", "ma").join(side("b", "mb"), "key").where("a < b").where(near).select("a", "b").distinct(), "pairs")
        links = verify(pairs)
        release(entries, pairs)
    release(raw, marks)
    least = members.where("class is not null").groupBy("class").agg(F.min("id").alias("least"))
    rooted = least.join(comp.withColumnRenamed("node", "class"), "class", "left").select("class", F.coalesce("root", "class").alias("root"), "least")
    own = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(own, "root").select("class", "component_id")
    groups = members.join(named, "class", "left").select("id", "n_shingles", F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return {"members": members, "links": links, "groups": groups}
