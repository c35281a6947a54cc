"""Connected components and similarity groups over candidate buckets, with DataFrame operations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import broadcast_if_small, cut, frees, release, tidy

#: Nodes of a bucket that one task compares with those that are left.
SALTED = 500
#: Links that one task joins in its memory (some 100 bytes each while it works); more of them go through rounds.
AT_ONCE = 1_000_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (a, b), in order, and of each the smallest node of its component."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, root = at[: len(a)], at[len(a) :], np.arange(len(node))
    while len(u):  # u and v are roots
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(up := root[root], root):
            root = up
        u, v = root[u], root[v]
        u, v = u[u != v], v[u != v]
    return node, node[root]


def joined_at_once(edges: DataFrame) -> DataFrame:
    """(node, root, moved) of every node of ``edges`` (a, b: long, known: boolean), found in one task; root is the smallest node of its component.

    Rows that are ``known`` say that b was the root of a; ``moved`` are former roots, and nodes without one, that have another root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not got:
            return
        a, b, known = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        node, root = roots(a, b)
        moved = (node != root) & (np.isin(node, b[known]) | ~np.isin(node, a[known]))
        for i in range(0, len(node), 100_000):
            yield pa.record_batch([pa.array(x[i : i + 100_000]) for x in (node, root, moved)], ["node", "root", "moved"])

    return edges.select("a", "b", "known").coalesce(1).mapInArrow(frees(run), "node long, root long, moved boolean")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b: long); root is the smallest node of its component.

    Up to AT_ONCE links are joined in one task. More go through alternating large-star and small-star steps: each is a grouped minimum (combined before the
    shuffle) and a join that adaptive execution can split, so a hub of many links is no single task.
    Every round is written to the shared folder, and so is the result; the round before is deleted. Self links and repeats do no harm; no links, no rows."""
    e = cut(edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    if e.count() <= AT_ONCE:
        out = cut(joined_at_once(e.select(F.col("u").alias("a"), F.col("v").alias("b"), F.lit(False).alias("known"))).select("node", "root"), "comp")
        release(e)
        return out
    last, e = e, cut(e.distinct(), "edges")
    release(last)
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v >= u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low2, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low2.select("u", F.col("m").alias("v")))
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .distinct()
        )
        last, e = e, cut(small, "star")
        release(last)
        ends = e.where("u <> v").select(F.col("u").alias("node"), F.lit(1).alias("up")).union(e.where("u <> v").select("v", F.lit(0)))
        if ends.groupBy("node").agg(F.sum("up").alias("n"), F.min("up").alias("least")).where("n > 1 or n = 1 and least = 0").isEmpty():
            break  # every node hangs on one root or is one
    else:
        raise RuntimeError("components did not settle")
    out = cut(e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), F.least("u", "root").alias("root")), "comp")
    release(e)
    return out


def merged(comp: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``comp`` (node, root), as components gives it, with the written links ``more`` (a, b) put in, and the roots that moved (old, new); both are written.

    Up to AT_ONCE rows of both are joined in one task. Of more, only the roots of the new links go through rounds; all other nodes are relabelled once."""
    if comp.count() + more.count() <= AT_ONCE:
        both = comp.select(F.col("node").alias("a"), F.col("root").alias("b"), F.lit(True).alias("known")).union(more.select("a", "b", F.lit(False)))
        joined = cut(joined_at_once(both), "joined")
        out, moved = cut(joined.select("node", "root"), "comp"), cut(joined.where("moved").select(F.col("node").alias("old"), F.col("root").alias("new")), "moved")
        release(joined)
        return out, moved
    ends = more.select(F.col("a").alias("node")).union(more.select("b")).distinct()
    found = comp.join(broadcast_if_small(ends), "node")
    known = cut(ends.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.col("root").isNull().alias("new")), "known")
    root = lambda x: known.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    joined = components(more.join(root("a"), "a").join(root("b"), "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    moved = cut(joined.where("node <> root").toDF("old", "new"), "moved")
    out = cut(relabelled(comp.union(known.where("new").select("node", "root")), moved), "comp")
    release(known, joined)
    return out, moved


def relabelled(rows: DataFrame, moved: DataFrame) -> DataFrame:
    """``rows`` with the new root of those whose ``root`` moved (old, new)."""
    out = rows.join(broadcast_if_small(moved), rows["root"] == F.col("old"), "left")
    return out.select(*[F.coalesce("new", "root").alias("root") if c == "root" else F.col(c) for c in rows.columns])


def stars(rows: DataFrame, order: str) -> DataFrame:
    """(key, hub, x, alone): in every bucket of ``rows`` (key, node: long) the first node by ``order`` (an SQL
    expression over key and node) against each other distinct node. Buckets stream through in sorted order, so a
    task holds one hub, not a bucket; single-node buckets give nothing. ``alone``: the bucket has these two nodes only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key0 = hub0 = last0 = gone = held = None

        def out(k: np.ndarray, h: np.ndarray, x: np.ndarray, alone: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(k), pa.array(h), pa.array(x), pa.array(alone)], ["key", "hub", "x", "alone"])

        for b in batches:
            if not b.num_rows:
                continue
            key, node = b.column(0).to_numpy(), b.column(1).to_numpy()
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            new[0] = key0 is None or key[0] != key0
            fresh = np.ones(len(key), bool)
            fresh[1:] = new[1:] | (node[1:] != node[:-1])
            fresh[0] = new[0] or node[0] != last0
            at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            hub = np.where(at >= 0, node[at], hub0 if hub0 is not None else 0)
            keep = ~new & fresh & (node != hub)
            key0, hub0, last0 = key[-1], hub[-1], node[-1]
            if keep.any():
                new_rows = key[keep], hub[keep], node[keep]
                k, h, x = new_rows if held is None else (np.concatenate(p) for p in zip(held, new_rows, strict=True))
                if len(k) > 1:  # the last row waits for its successor
                    after = k[:-1] == k[1:]
                    before = np.concatenate([[gone is not None and k[0] == gone], after[:-1]])
                    yield out(k[:-1], h[:-1], x[:-1], ~(after | before))
                    gone = k[-2]
                held = k[-1:], h[-1:], x[-1:]
        if held is not None:
            yield out(*held, np.array([gone is None or held[0][0] != gone]))

    dealt = rows.select("key", "node").repartition("key").sortWithinPartitions("key", F.expr(order), "node")
    return dealt.mapInArrow(frees(run), "key long, hub long, x long, alone boolean")


#: Parts for each shuffle partition that packed entries are dealt to, and the most entries of a packed row.
PARTS, PACKED = 4, 4096


def packed_buckets(rows: DataFrame) -> DataFrame:
    """(key, node, n): the distinct nodes of every bucket of ``rows`` (node: long, keys: array<long>, well mixed) that has ``n`` nodes, two or more; those of a bucket follow each other, by an order of mixed nodes that is the same in all buckets.

    Entries (key, node) go to the shuffle packed by part of the keys, some thousands a row, and are sorted in a task's memory at 16 bytes each."""
    count = min(PARTS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 65_535)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            both = np.concatenate(held, axis=1)
            part = (both[0].view(np.uint64) % np.uint64(count)).astype(np.uint16)
            order = np.argsort(part, kind="stable")
            both, part = both[:, order], part[order]
            edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            at = np.concatenate([np.arange(i, j, PACKED) for i, j in zip(edge[:-1], edge[1:], strict=True)])
            to = np.append(at[1:], len(part))
            data = [both[:, i:j].tobytes() for i, j in zip(at.tolist(), to.tolist(), strict=True)]
            for i in range(0, len(at), 200):
                yield pa.record_batch([pa.array(part[at[i : i + 200]].astype(np.int32)), pa.array(data[i : i + 200], pa.binary())], ["part", "data"])

        for b in batches:
            keys = b.column(1)
            each = keys.value_lengths().fill_null(0).to_numpy()
            held.append(np.stack([keys.flatten().to_numpy(), np.repeat(b.column(0).to_numpy(), each)]))
            n += held[-1].shape[1]
            if n >= 1_000_000:
                yield from out()
                held, n = [], 0
        if n:
            yield from out()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [np.frombuffer(x.as_buffer(), np.int64).reshape(2, -1) for b in batches for x in b.column(0)]
        if not got:
            return
        key, node = np.concatenate(got, axis=1)
        del got
        order = np.argsort(key)
        key, node = key[order], node[order]
        again = key[1:] == key[:-1]
        meet = np.zeros(len(key), bool)  # most keys have one entry
        meet[1:] |= again
        meet[:-1] |= again
        key, node = key[meet], node[meet]
        order = np.lexsort((node, K.mix(node.view(np.uint64)), key))
        key, node = key[order], node[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        fresh = new.copy()
        fresh[1:] |= node[1:] != node[:-1]
        key, node, new = key[fresh], node[fresh], new[fresh]
        if not len(key):
            return
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(key)))
        size = np.repeat(size, size)
        key, node, size = key[size > 1], node[size > 1], size[size > 1]  # the same node twice makes no bucket
        for i in range(0, len(key), 20_000):
            yield pa.record_batch([pa.array(c[i : i + 20_000]) for c in (key, node, size)], ["key", "node", "n"])

    packed = rows.select("node", "keys").where("keys is not null").mapInArrow(frees(pack), "part int, data binary").repartition("part")
    return packed.select("data").mapInArrow(frees(run), "key long, node long, n long")


def packed_stars(rows: DataFrame) -> DataFrame:
    """``stars`` of ``rows`` (node: long, keys: array<long>, well mixed), by the order of packed_buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = hub0 = None
        for b in batches:
            if not b.num_rows:
                continue
            key, node, n = (c.to_numpy() for c in b.columns)
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            new[0] = key[0] != last
            at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            hub = np.where(at >= 0, node[at], hub0 or 0)
            last, hub0 = key[-1], hub[-1]
            yield pa.record_batch([pa.array(c[~new]) for c in (key, hub, node, n == 2)], ["key", "hub", "x", "alone"])

    return packed_buckets(rows).mapInArrow(frees(run), "key long, hub long, x long, alone boolean")


def bucket_stars(rows: DataFrame) -> DataFrame:
    """The written stars of ``rows`` (key, node: long) for similarity_groups: the hub differs from key to key, but a node is hub of many of its keys."""
    return cut(stars(rows, "xxhash64(node, pmod(key, 4))"), "stars")


def similarity_groups(raw: DataFrame, marks: DataFrame, near: str, verify: Callable[[DataFrame], DataFrame], star_rounds: int = 2, settle: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Components of the verified links among nodes that share a bucket, as (components, links).

    ``raw`` are the bucket_stars of the bucket entries. ``marks`` (node, m) has one mark of each node, ``near`` is an SQL condition over the marks
    ``ma`` and ``mb`` that holds for every true link: joins make only pairs that pass it. ``verify`` maps distinct pairs (a, b) with a < b to
    the pairs that are true links, as a written table. A bucket's nodes are first compared with one hub each; nodes that are left in
    another component than most of their bucket are compared with new hubs, best linked nodes of that component, which absorbs large groups
    of near copies without forming their pairs. Finally every node that is still left is compared, by the marks, with the nodes of other components in its buckets.
    So the components are those of all pairs within buckets. Returns components (node, root) and links (a, b).

    With ``settle``, that last comparison makes no pairs: it is given the nodes of the open buckets (key, node, root, base, n; a node is left if its root is not the base)
    and the hubs that nodes were compared with (node, hub), and gives the links, as a written table, of nodes of one bucket and different roots."""
    crowd = raw.where("not alone")  # a bucket of two is settled by its one pair
    if raw.isEmpty():
        none = raw.sparkSession.createDataFrame([], "a long, b long")
        return components(none), none
    order = lambda d, x, y: d.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where("a < b").distinct()
    marked = lambda node, mark: marks.select(F.col("node").alias(node), F.col("m").alias(mark))
    sift = lambda d: d.join(marked("a", "ma"), "a").join(marked("b", "mb"), "b").where(near).select("a", "b")
    tried = cut(sift(order(raw, "hub", "x")), "tried")
    links = verify(tried)
    comp = components(links)
    seen = [tried]
    asked = raw.select(F.col("x").alias("node"), "hub")
    # near copies share many buckets: of buckets with the same nodes (by number and two hashes) one says it all
    every = crowd.select("key", F.col("x").alias("node")).union(crowd.select("key", F.col("hub").alias("node")).distinct())
    alike = every.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("h"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("g"))
    member = cut(every.join(alike.groupBy("n", "h", "g").agg(F.min("key").alias("key")).select("key"), "key"), "member")
    labelled = member.join(comp, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    done = [member]  # what labelled reads
    for turn in range(star_rounds + 1):
        tidy(raw.sparkSession)  # else the driver's heap grows with the jobs of a turn, and is not given back
        many = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo < hi and n > 2")
        open_ = cut(labelled.join(many.select("key", "n"), "key"), "open")
        # the largest component of a bucket is its base; nodes of the others are left
        size = open_.groupBy("key", "root").agg(F.count("*").alias("c"))
        base = size.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("base"))
        dealt = cut(open_.join(base, "key"), "dealt")
        rest = dealt.where("root <> base")
        release(open_, *done)
        done, labelled = [dealt], dealt.select("key", "node", "root")  # components only grow: a bucket that is settled stays so
        if rest.isEmpty():
            break
        if turn < star_rounds:
            # a new hub is linked to nodes that have more links than itself: to former hubs
            both = links.union(links.select("b", "a")).toDF("node", "other")
            degree = both.groupBy("node").agg(F.count("*").alias("d"))
            rank = both.join(degree, "node").join(degree.toDF("other", "e"), "other").groupBy("node").agg(F.sum(F.col("e") - F.col("d")).alias("rank"))
            scored = dealt.where("root = base").join(rank, "node", "left")
            hubs = scored.groupBy("key").agg(F.max_by("node", F.struct(F.coalesce("rank", F.lit(0)).alias("r"), F.xxhash64("node", F.lit(turn)).alias("h"))).alias("hub"))
            put = rest.join(hubs, "key")
            if settle is not None:
                put = cut(put.select("node", "hub").distinct(), "asked")
                asked = asked.union(put)
                seen.append(put)
            new = sift(order(put, "hub", "node"))
        elif settle is not None:
            more = settle(dealt, asked)
            if not more.isEmpty():
                links = links.union(more)
                last, (comp, moved) = comp, merged(comp, more)
                release(last, moved)
            break
        else:
            salts = f"cast(n div {SALTED} as int) + 1"  # a large bucket is dealt out to several tasks
            left = rest.select("key", F.col("node").alias("y"), F.col("root").alias("ry"), F.explode(F.expr(f"sequence(0, {salts} - 1)")).alias("salt")).join(marked("y", "ma"), "y")
            right = dealt.select("key", "node", "root", F.expr("root = base").alias("main"), F.expr(f"cast(pmod(xxhash64(node, 5), {salts}) as int)").alias("salt")).join(marked("node", "mb"), "node")
            new = order(left.join(right, ["key", "salt"]).where("ry <> root and (main or y < node)").where(near), "y", "node")
        new = cut(new.join(tried, ["a", "b"], "left_anti"), "tried")
        seen.append(new)
        if new.isEmpty():
            continue
        more = verify(new)
        links, tried = links.union(more), tried.union(new)
        if not more.isEmpty():
            last, (comp, moved) = comp, merged(comp, more)
            release(last)
            done.append(moved)
            labelled = relabelled(labelled, moved)
    release(*done, *seen)
    tidy(raw.sparkSession)
    return comp, links
