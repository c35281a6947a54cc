"""Fuzzy line deduplication: SimHash of normalised lines, pigeonhole blocks, edit similarity, connected groups.

A line is normalised by lower-casing A-Z and collapsing white space. Equal lines meet by hash, combined within every task first.
Distinct lines get a 64-bit SimHash of their word pairs, cut into RADIUS + 2 blocks (more of them for over 50 million lines, see block_keys);
lines within RADIUS bits agree in two blocks at least, so every pair of blocks is a key of the join. Pairs within RADIUS bits are verified by
edit similarity. Of each connected group one occurrence stays: the first by document id and line number.

That radius reaches a changed word only in long lines. By default (``radius=None``) candidates reach as far
as the edit similarity does: the SimHash takes words and REACH bits, which blocks can't serve, so keys are minima of hashes over a line's
words, each word weighing its length as it does in the edit distance. Of pairs that share two thirds of their
letters, BANDS keys of ROWS minima each miss some 5%, of those that share nine tenths, next to none. Buckets of up to CROWD lines are compared within a task, larger ones in rounds. Lines of fewer than ``min_words`` words then meet if they are equal.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .graph import PARTS, bucket_stars, merged, packed_buckets, roots, similarity_groups, stars
from .shared import BROADCAST_ROWS, cut, frees, fresh, release, small_batches

U = np.uint64
RADIUS, MIN_WORDS, SIMILARITY = 3, 5, 0.8
REACH, ROWS, BANDS = 20, 4, 14
#: The minima: a grid of ROWS * SPREAD; keys are its columns and diagonals, any two of which share one minimum at most.
SPREAD = 7
#: Of the minima, four bits each make a sketch; pairs in which more than APART of the minima differ are sifted out.
APART, NIBBLES = 15, 15
MARKS = [*(f"s{i}" for i in range(-(-ROWS * SPREAD // NIBBLES))), "n"]
WIDTH = BANDS + len(MARKS)
#: Lines that a task sorts at once; lines repeated within such a block are combined.
BLOCK = 60_000
_INV = pow(K._STEP, -1, 1 << 64)


def find_lines(raw: np.ndarray, off: np.ndarray) -> tuple[K.Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words, and of each line with a word: text number, line number, first word, word after the last, hash."""
    w = K.words(raw, off)
    ends = np.flatnonzero(raw == 10)
    edge = np.unique(np.concatenate([off, ends]))  # a line begins at a text's start or after a line's end
    a = np.unique(np.searchsorted(w.start, edge))
    a = a[a < len(w.start)]
    b = np.append(a, len(w.start))[1:]
    doc = np.searchsorted(off, w.start[a], "right") - 1
    number = np.searchsorted(ends, w.start[a]) - np.searchsorted(ends, off[doc])
    total = np.concatenate([np.zeros(1, U), np.cumsum(w.hash * K.powers(K._STEP, len(w.hash)))])
    h = K.mix((total[b] - total[a]) * K.powers(_INV, len(w.hash) + 1)[a] + (b - a).astype(U))
    return w, doc, number, a, b, h


def lines_of(raw: np.ndarray, off: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, line number, hash, SimHash) of the lines with ``min_words`` words or more."""
    w, doc, number, a, b, h = find_lines(raw, off)
    pairs = w.hash.copy()  # features: pairs of following words, for the commonest words alone would fill most fingerprints alike
    pairs[:-1] = K.mix(w.hash[:-1] * U(3) + w.hash[1:])
    pairs[a[b - a == 1]] = w.hash[a[b - a == 1]]
    long = b - a >= min_words
    return doc[long], number[long], h[long], K.simhash_spans(pairs, a[long], np.maximum(b - 1, a + 1)[long])


def signs(raw: np.ndarray, w: K.Words, a: np.ndarray, b: np.ndarray, marks: bool = False) -> np.ndarray:
    """The keys of lines of the words a[i] to b[i], one at least; with ``marks``, their sketch and length after them."""
    keys = np.zeros((len(a), WIDTH), U)
    if not len(a):
        return keys
    n = b - a
    first = np.concatenate([[0], np.cumsum(n)])
    take = np.arange(first[-1]) + np.repeat(a - first[:-1], n)
    own, length = w.hash[take], (w.end - w.start)[take].astype(U)
    if marks:
        letters = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        keys[:, -1] = np.add.reduceat((letters[w.end] - letters[w.start])[take] + 1, first[:-1]) - 1
    share = 1.0 / length
    least = np.empty((ROWS * SPREAD, len(a)), U)
    part, weighed = np.empty_like(own), np.empty(len(own))  # one piece of memory for all minima
    for j in range(ROWS * SPREAD):
        odd = U(int(K.mix(np.array([j + 1], U))[0]) | 1)
        np.multiply(own, odd, out=part)
        np.right_shift(part, U(12), out=part)
        np.multiply(part.view(np.int64), share, out=weighed)  # 52 bits: signed is the same, and faster
        least[j] = K.mix(np.minimum.reduceat(weighed, first[:-1]).view(U))
        if marks:
            keys[:, BANDS + j // NIBBLES] |= (least[j] & U(15)) << U(4 * (j % NIBBLES))
    for i in range(BANDS):
        for r in range(ROWS):
            keys[:, i] = K.mix(keys[:, i] + least[r * SPREAD + (i + r * (i // SPREAD)) % SPREAD])
        keys[:, i] = K.mix(keys[:, i] + U(i))
    return keys


def reach_of(raw: np.ndarray, off: np.ndarray, min_words: int, seen: set[int]) -> tuple[np.ndarray, ...]:
    """(text number, line number, hash, row of keys or -1, keys) of all lines with a word. Only lines whose hash is not in ``seen``, to which it is added, and of ``min_words`` words or more have keys."""
    w, doc, number, a, b, h = find_lines(raw, off)
    row, n = np.full(len(h), -1), b - a
    _, once = np.unique(h, return_index=True)
    new = np.array([i for i in once.tolist() if n[i] >= min_words and int(h[i]) not in seen], np.int64)
    seen.update(h[new].tolist())
    row[new] = np.arange(len(new))
    return doc, number, h, row, signs(raw, w, a[new], b[new])[:, :BANDS]


def _scan(docs: DataFrame, schema: str, read: Callable, block: Callable) -> DataFrame:
    """The rows that ``block`` makes of what ``read`` finds in pieces of the texts of ``docs`` (id, version, text), a block of lines at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, count, seen = [], 0, set()
        for batch in batches:
            raw, off = K.text_buffers(batch.column(2))
            ids, version, at = batch.column(0).to_numpy(), batch.column(1).to_numpy(), 0
            while at < len(ids):
                to = max(at + 1, int(np.searchsorted(off, off[at] + K.PIECE, "right")) - 1)
                doc, *rest = read(raw[off[at] : off[to]], off[at : to + 1] - off[at], seen)
                if len(doc):
                    got.append((ids[at + doc], version[at + doc], *rest))
                    count += len(doc)
                at = to
                if count >= BLOCK:
                    yield from block(got)
                    got, count, seen = [], 0, set()
        if got:
            yield from block(got)

    return docs.select("id", F.xxhash64("text").alias("version"), "text").mapInArrow(frees(run), schema)


def _occurrences(got: list[tuple]) -> tuple:
    """The columns (id, version, line, hash, ...) of a block in order of hash and occurrence; which rows are the first of their line, and which to keep: not the same occurrence again, as rows of one id and text give it."""
    ids, version, number, h, *rest = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.lexsort((number, version, ids, h))
    ids, version, number, h = ids[order], version[order], number[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    same = (ids == ids[lead]) & (version == version[lead]) & (number == number[lead])
    return [ids, version, number.astype(np.int32), h, *[c[order] for c in rest]], new, new | ~same


def scan_reach(docs: DataFrame, min_words: int) -> DataFrame:
    """scan_lines for all lines with a word, with the keys that reach_of gives instead of a SimHash (null for lines of fewer than ``min_words`` words and rows with ``again``)."""

    def read(raw: np.ndarray, off: np.ndarray, seen: set[int]) -> tuple:
        doc, number, h, row, keys = reach_of(raw, off, min_words, seen)
        has = row >= 0
        own = np.zeros((len(h), BANDS), U)
        own[has] = keys[row[has]]
        return doc, number, h, has, own

    def block(got: list[tuple]) -> Iterator[pa.RecordBatch]:
        (ids, version, number, h, has, own), new, keep = _occurrences(got)
        start = np.flatnonzero(new)
        there = np.flatnonzero(has)  # one occurrence of a line has its keys
        to = start[np.searchsorted(start, there, "right") - 1]
        own[to], has[to] = own[there], True
        has &= new
        for i in range(0, len(h), 20_000):
            s = slice(i, i + 20_000)
            k, none = keep[s], ~has[s][keep[s]]
            cols = [pa.array(c[s][k]) for c in (ids, version, number, K.signed(h), ~new)]
            keys = K.lists(pa.array(K.signed(own[s][k][~none].reshape(-1))), np.concatenate([[0], np.cumsum(np.where(none, 0, BANDS))]))
            yield pa.record_batch([*cols, keys], ["id", "version", "line", "hash", "again", "keys"])

    return _scan(docs, "id long, version long, line int, hash long, again boolean, keys array<long>", read, block)


def scan_lines(docs: DataFrame, min_words: int) -> DataFrame:
    """(id, version, line, hash, sim, again): the first occurrence of each line in a task's block of lines, and, with ``again``, those that follow it. The version is a hash of the text."""

    def block(got: list[tuple]) -> Iterator[pa.RecordBatch]:
        (ids, version, number, h, sim), new, keep = _occurrences(got)
        for i in range(0, len(h), 100_000):
            s = slice(i, i + 100_000)
            yield pa.record_batch([pa.array(c[s][keep[s]]) for c in (ids, version, number, K.signed(h), K.signed(sim), ~new)], ["id", "version", "line", "hash", "sim", "again"])

    return _scan(docs, "id long, version long, line int, hash long, sim long, again boolean", lambda raw, off, _: lines_of(raw, off, min_words), block)


def word_distance(u: list[str], v: list[str]) -> int:
    """At least the edit distance of the joined words: between the words that are single in both and in the same order, all is put anew."""
    once, there = Counter(u), Counter(v)
    at = {w: i for i, w in enumerate(v)}
    tops, ends, back = [], [], {}  # longest rising run of positions in v
    for i, w in enumerate(u):
        if once[w] == 1 and there.get(w) == 1:
            j = at[w]
            k = bisect_left(tops, j)
            back[i, j] = ends[k - 1] if k else None
            if k == len(tops):
                tops.append(j)
                ends.append((i, j))
            else:
                tops[k], ends[k] = j, (i, j)
    run, at_ = [], ends[-1] if ends else None
    while at_:
        run.append(at_)
        at_ = back[at_]
    cost, i, j = 0, 0, 0
    for p, q in [*reversed(run), (len(u), len(v))]:
        x, y = u[i:p], v[j:q]
        while x and y and x[-1] == y[-1]:
            x.pop(), y.pop()
        k = 0
        while k < min(len(x), len(y)) and x[k] == y[k]:
            k += 1
        cost += max(sum(map(len, x[k:])) + len(x) - k, sum(map(len, y[k:])) + len(y) - k)
        i, j = p + 1, q + 1
    return cost


#: Code points of pairs whose edit distances are counted together.
TOGETHER = 2_000_000
#: Length of texts for which whole changed words are tried before their edit distance is counted.
WORDY = 100


def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, t): the normalised lines that each row (want: array of line and hash, text) wants."""
    for batch in batches:
        hashes, texts = [], []
        for want, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = text.as_buffer().to_pybytes().split(b"\n")
            for w in want:
                hashes.append(w["hash"])
                texts.append(b" ".join(rows[w["line"]].lower().split()))  # of bytes, only A-Z and ASCII white space
        yield pa.record_batch([pa.array(hashes, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["hash", "t"])


def signed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, there, crowd, t, sim, *MARKS, keys): the normalised lines that each row (want: array of line, hash, there and crowd, text) wants, with their SimHash of words, marks and keys."""
    for batch in batches:
        want, texts = batch.column(0), []
        own, each = want.flatten(), want.value_lengths().to_pylist()
        line, at = own.field("line").to_pylist(), 0
        for n, text in zip(each, batch.column(1), strict=True):
            rows = text.as_buffer().to_pybytes().split(b"\n")
            texts += [b" ".join(rows[i].lower().split()) for i in line[at : at + n]]
            at += n
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        raw = np.frombuffer(b"".join(texts), np.uint8)
        w = K.words(raw, off, False)
        sim, keys = K.simhash_spans(w.hash, w.first[:-1], w.first[1:]), K.signed(signs(raw, w, w.first[:-1], w.first[1:], True))
        marks = [pa.array(np.ascontiguousarray(keys[:, BANDS + j])) for j in range(len(MARKS))]
        both = K.lists(pa.array(np.ascontiguousarray(keys[:, :BANDS]).reshape(-1)), np.arange(len(texts) + 1) * BANDS)
        cols = [own.field("hash"), own.field("there"), own.field("crowd"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(K.signed(sim)), *marks, both]
        yield pa.record_batch(cols, ["hash", "there", "crowd", "t", "sim", *MARKS, "keys"])


def _trim(x: str, y: str, similarity: float | None) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The code points of both, and the lengths of the common start and end; with ``similarity``, texts that reach it by changing whole words are common altogether."""
    least = min(len(x), len(y))
    p, q = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (x, y))
    apart = np.flatnonzero(p[:least] != q[:least])
    start = int(apart[0]) if len(apart) else least
    rest = least - start
    apart = np.flatnonzero(p[len(p) - rest :][::-1] != q[len(q) - rest :][::-1])
    end = int(apart[0]) if len(apart) else rest
    if similarity is not None and max(len(p), len(q)) - start - end > (1 - similarity) * max(len(x), len(y)) + 1e-9:
        u, v = x[start : len(x) - end].split(" "), y[start : len(y) - end].split(" ")
        most = (1 - similarity) * max(len(x), len(y)) + 1e-9
        if len(u) == len(v) and sum(max(len(m), len(n)) for m, n in zip(u, v, strict=True) if m != n) <= most or word_distance(u, v) <= most:
            start, end = least, max(len(x), len(y))
    return p, q, start, end


def trimmed(pairs: DataFrame, similarity: float | None = None) -> DataFrame:
    """(a, b, ta, tb, longer): ``pairs`` of texts without their common start and end, which leaves the edit distance as it is; ``longer`` is the greater length before that.

    With ``similarity``, texts that reach it by changing whole words are left empty, for they need no more counting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, longer = [], [], []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                _, _, start, end = _trim(x, y, similarity)
                left.append(x[start : max(start, len(x) - end)])
                right.append(y[start : max(start, len(y) - end)])
                longer.append(max(len(x), len(y)))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(longer, pa.int32())], ["a", "b", "ta", "tb", "longer"])

    return pairs.select("a", "b", "ta", "tb").mapInArrow(frees(run), "a long, b long, ta string, tb string, longer int")


def linked(pairs: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of those ``pairs`` (a, b, ta, tb) of texts whose edit similarity is ``similarity`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = _Near(similarity)
        for batch in batches:
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                near.add(a, b, x, y)
            yield from near.full()
        yield from near.full(0)

    return pairs.select("a", "b", "ta", "tb").mapInArrow(frees(run), "a long, b long")


class _Near:
    """Gathers pairs of texts and gives those (a, b) whose edit similarity is ``similarity`` or more, of many at once."""

    def __init__(self, similarity: float) -> None:
        self.similarity, self.open, self.held = similarity, [], 0

    def add(self, a: int, b: int, x: str, y: str) -> None:
        p, q, start, end = _trim(x, y, self.similarity if min(len(x), len(y)) >= WORDY else None)
        most = int(round(1 - self.similarity, 6) * max(len(x), len(y)) + 1e-9)
        p, q = p[start : max(start, len(p) - end)], q[start : max(start, len(q) - end)]
        if abs(len(p) - len(q)) <= most:
            self.open.append((a, b, p, q, most))
            self.held += len(p) + len(q)

    def full(self, least: int = TOGETHER) -> Iterator[pa.RecordBatch]:
        if not self.open or self.held < least:
            return
        distance = K.edit_distances([p for _, _, p, _, _ in self.open], [q for _, _, _, q, _ in self.open], [most for *_, most in self.open])
        good = [(a, b) for (a, b, _, _, most), d in zip(self.open, distance.tolist(), strict=True) if d <= most]
        self.open, self.held = [], 0
        yield pa.record_batch([pa.array([x[i] for x in good], pa.int64()) for i in (0, 1)], ["a", "b"])


#: Of a bucket's lines that no hub has settled, so many are held at once, each against the lines that stream by.
HELD = 500


def left_links(dealt: DataFrame, about: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: the links of lines of one bucket and different roots that no hub was compared with.

    ``dealt`` (key, node, root, base, n) as similarity_groups gives it, ``about`` (node, sim, *MARKS, keys, hubs, t) of its nodes: with the marks, all its keys in ``dealt``, the hubs it was compared with and the normalised line.
    A bucket's lines are dealt out by HELD to tasks, which hold them while those of its lines that are left stream by; a pair is compared in one of the buckets that it shares, chosen by a hash,
    first by the marks, then by edit similarity. Only links are given out; what is compared still grows with the square of the lines left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, group, own = _Near(similarity), None, []
        rows: list[dict] = []  # of groups whose pairs, rows[y] with rows[x], wait to be sifted together, for most groups are small
        ys: list[np.ndarray] = []
        xs: list[np.ndarray] = []

        def sift() -> Iterator[pa.RecordBatch]:
            y, x = np.concatenate(ys), np.concatenate(xs)
            column = lambda c: np.array([r[c] for r in rows], np.int64)
            node, root, n = column("node"), column("root"), column("n")
            keep = (root[y] != root[x]) & (np.array([r["main"] for r in rows])[x] | (node[y] < node[x]))
            keep &= np.minimum(n[y], n[x]) >= similarity * np.maximum(n[y], n[x]) - 2
            y, x = y[keep], x[keep]
            sim = column("sim").view(U)
            keep = np.bitwise_count(sim[y] ^ sim[x]) <= REACH
            y, x = y[keep], x[keep]
            differ = np.zeros(len(y), np.int64)
            for c in MARKS[:-1]:
                mark = column(c).view(U)
                d = mark[y] ^ mark[x]
                differ += np.bitwise_count((d | (d >> U(1)) | (d >> U(2)) | (d >> U(3))) & U(0x111111111111111))
            y, x = y[differ <= APART], x[differ <= APART]
            # of the keys that both have, the one least by a hash of key and pair
            most = max(len(r["keys"]) for r in rows)
            keys = np.array([r["keys"] + r["keys"][:1] * (most - len(r["keys"])) for r in rows], np.int64).view(U)
            salt, least = K.mix(node[x].view(U) ^ node[y].view(U)), np.full(len(y), ~U(0))
            for k in range(most):
                both = (keys[x] == keys[y, k][:, None]).any(axis=1)
                least = np.where(both, np.minimum(least, K.mix(keys[y, k] ^ salt)), least)
            keep = least == K.mix(column("key").view(U)[y] ^ salt)
            for a, b in zip(y[keep].tolist(), x[keep].tolist(), strict=True):
                r, o = rows[a], rows[b]
                if o["node"] not in r["hubs"] and r["node"] not in o["hubs"]:
                    near.add(min(r["node"], o["node"]), max(r["node"], o["node"]), r["t"], o["t"])
                    yield from near.full()

        def compare(wait: list[dict]) -> Iterator[pa.RecordBatch]:
            nonlocal rows, ys, xs
            for i in range(0, len(wait), 200) if own else ():
                part, at = wait[i : i + 200], len(rows)
                rows += own + part
                ys.append(np.repeat(np.arange(at + len(own), len(rows)), len(own)))
                xs.append(np.tile(np.arange(at, at + len(own)), len(part)))
                if len(rows) >= 2000 or len(own) * len(part) >= 50_000:
                    yield from sift()
                    rows, ys, xs = [], [], []

        for batch in batches:
            wait: list[dict] = []
            for r in batch.to_pylist():
                r["hubs"] = set(r["hubs"] or ())
                if group != (r["key"], r["salt"]):
                    yield from compare(wait)
                    wait, own, group = [], [], (r["key"], r["salt"])
                (wait if r["late"] else own).append(r)
            yield from compare(wait)
        if rows:
            yield from sift()
        yield from near.full(0)

    salts = f"cast(n div {HELD} as int) + 1"
    here = dealt.select("key", F.expr(f"cast(pmod(xxhash64(node, 5), {salts}) as int)").alias("salt"), F.lit(False).alias("late"), "node", "root", F.expr("root = base").alias("main"))
    by = dealt.where("root <> base").select("key", F.explode(F.expr(f"sequence(0, {salts} - 1)")).alias("salt"), F.lit(True).alias("late"), "node", "root", F.lit(False).alias("main"))
    rows = here.union(by).join(about, "node").select("key", "salt", "late", "node", "root", "main", "sim", *MARKS, "keys", "hubs", "t")
    # so many tasks as asked for: adaptive execution would make few of them, for the rows are few and the work is not
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "salt").sortWithinPartitions("key", "salt", "late")
    return rows.mapInArrow(frees(run), "a long, b long")


#: A bucket of more lines is not compared in one task.
CROWD = 2000
#: Bytes of lines that are packed, and entries that are compared, at once.
PACK, CHUNK = 32_000_000, 40_000
#: Pairs that are sifted, and whose edit distances are counted, at once.
SIFTED, COUNTED = 400_000, 4000
#: Words that a walk passes over in both lines to meet again.
STEPS = [(1, 1), (1, 0), (0, 1), (2, 2), (1, 2), (2, 1), (2, 0), (0, 2), (3, 3)]


def walked(u: list[str], v: list[str], most: int) -> bool:
    """Whether a walk along the words of both shows that the joined words are within the edit distance ``most``: what lies between words that are equal is put anew, but for its common start and end. If not, they may still be."""
    i, j, m, n = 0, 0, len(u), len(v)
    while True:
        while i < m and j < n and u[i] == v[j]:
            i += 1
            j += 1
        left, right = m - i, n - j
        if not left and not right:
            return True
        for s, t in STEPS:
            if s < left and t < right and u[i + s] == v[j + t] or s == left and t == right:
                break
        else:
            s, t = min(left, 4), min(right, 4)
        x, y = (u[i], v[j]) if s == t == 1 else (" ".join(u[i : i + s]), " ".join(v[j : j + t]))
        least, k = min(len(x), len(y)), 0
        while k < least and x[k] == y[k]:
            k += 1
        e = 1
        while e <= least - k and x[-e] == y[-e]:
            e += 1
        most -= max(len(x), len(y)) - k - e + 1 + (s == 0 or t == 0)  # a space goes too
        if most < 0:
            return False
        i, j = i + s, j + t


def _few(u: np.ndarray, v: np.ndarray, most: int) -> np.ndarray:
    """Of pairs of roots u < v some: each two roots once, and of each v ``most`` at most."""
    order = np.lexsort((u, v))
    u, v = u[order], v[order]
    other = np.ones(len(v), bool)
    other[1:] = (v[1:] != v[:-1]) | (u[1:] != u[:-1])
    order, v = order[other], v[other]
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    return order[np.arange(len(v)) - np.maximum.accumulate(np.where(new, np.arange(len(v)), 0)) < most]


def _bucket_pairs(key: np.ndarray, at: np.ndarray, keys: np.ndarray, sim: np.ndarray, marks: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (x < y, distinct) of lines ``at`` that share a bucket, ``key`` in order, and pass the marks; each in the bucket of the first of ``keys`` (a column for each band) that both have."""
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    size, n, out = np.diff(np.append(start, len(key))), marks[:, -1], []

    def sift(x: np.ndarray, y: np.ndarray, bucket: np.ndarray) -> None:
        keep = (np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - 2) & (np.bitwise_count(sim[x] ^ sim[y]) <= REACH)
        x, y, bucket = x[keep], y[keep], bucket[keep]
        differ = np.zeros(len(x), np.int64)
        for c in range(len(MARKS) - 1):
            d = marks[x, c].view(U) ^ marks[y, c].view(U)
            differ += np.bitwise_count((d | (d >> U(1)) | (d >> U(2)) | (d >> U(3))) & U(0x111111111111111))
        x, y, bucket = x[differ <= APART], y[differ <= APART], bucket[differ <= APART]
        keep = keys[x, (keys[x] == keys[y]).argmax(axis=1)] == bucket
        out.append((np.minimum(x, y)[keep], np.maximum(x, y)[keep]))

    for s in np.unique(size[size > 1]).tolist():
        i, j = np.triu_indices(s, 1)
        have, step = start[size == s], max(1, SIFTED // len(i))
        for b in range(0, len(have), step):
            some = have[b : b + step, None]
            for c in range(0, len(i), SIFTED):
                x, y = at[some + i[c : c + SIFTED]], at[some + j[c : c + SIFTED]]
                sift(x.reshape(-1), y.reshape(-1), np.repeat(key[some[:, 0]], x.shape[1]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def near_in_buckets(t: pa.Table, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): links of the lines of whole buckets (key, node, sim, *MARKS, keys as bytes, t) that join all that are joined by the near pairs that the marks let pass.

    Pairs of lines that are joined already are left out: walks along the words join most, a few pairs of each line at first, and edit distances those that are left."""
    column = lambda c: t.column(c).to_numpy()
    node, row, at = np.unique(column("node"), return_index=True, return_inverse=True)
    key = column("key")
    order = np.lexsort((at, key))
    key, at = key[order], at[order]
    once = np.ones(len(key), bool)  # a text that is there twice gives its lines twice
    once[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1])
    key, at, own = key[once], at[once], t.take(pa.array(row))
    marks = np.stack([own.column(m).to_numpy() for m in MARKS], axis=1)
    keys = np.frombuffer(b"".join(own.column("keys").to_pylist()), np.int64).reshape(-1, BANDS)
    x, y = _bucket_pairs(key, at, keys, own.column("sim").to_numpy().view(U), marks, similarity)
    some, at = np.unique(np.concatenate([x, y]), return_inverse=True)  # only they need their words
    x, y, node = at[: len(x)], at[len(x) :], node[some]
    texts = own.column("t").take(pa.array(some))
    length = pc.utf8_length(texts).to_numpy().astype(np.int64)
    most = (round(1 - similarity, 6) * np.maximum(length[x], length[y]) + 1e-9).astype(np.int64)
    own = texts.to_pylist()
    words = [t.split(" ") for t in own]
    root, links = np.arange(len(some)), []

    def walks(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        return np.array([walked(words[i], words[j], k) for i, j, k in zip(a.tolist(), b.tolist(), most.tolist(), strict=True)], bool)

    def measured(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        code = {i: np.frombuffer(own[i].encode("utf-32-le", "surrogatepass"), np.uint32) for i in np.unique([a, b]).tolist()}
        return K.edit_distances([code[i] for i in a.tolist()], [code[i] for i in b.tolist()], most.tolist()) <= most

    for test in (walks, measured):
        wait = np.arange(len(x))  # pairs that this test has not seen
        for few in (1, 4, None):
            u, v = np.minimum(root[x[wait]], root[y[wait]]), np.maximum(root[x[wait]], root[y[wait]])
            wait, u, v = wait[u != v], u[u != v], v[u != v]
            pick = np.arange(len(wait)) if few is None else _few(u, v, few)
            for i in range(0, len(pick), COUNTED):
                p = wait[pick[i : i + COUNTED]]
                p = p[root[x[p]] != root[y[p]]]
                p = p[test(x[p], y[p], most[p])]
                if len(p):
                    links.append(p)
                    ends, top = roots(root[x[p]], root[y[p]])
                    to = np.arange(len(root))
                    to[ends] = top
                    root = to[root]
            wait = np.delete(wait, pick)
    p = np.concatenate([*links, np.zeros(0, np.int64)])
    return node[x[p]], node[y[p]]


def bucket_links(texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: links that join the lines of ``texts`` (hash, there, t, sim, *MARKS, keys) that near pairs of the buckets ``there`` join.

    Lines go to the shuffle once for each bucket, packed by part of the buckets; a task holds whole parts, CHUNK entries and more, and no pairs leave it but links."""
    count = min(PARTS * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 65_535)
    names = ["key", "node", "sim", *MARKS, "keys", "t"]
    schema = pa.schema([(c, pa.binary(8 * BANDS) if c == "keys" else pa.string() if c == "t" else pa.int64()) for c in names])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            part = (rows.column(0).to_numpy().view(U) % U(count)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            rows, part = rows.take(pa.array(order)), part[order]
            edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])).tolist()
            for i in range(0, len(edge) - 1, 50):
                some = edge[i : i + 51]
                data = [rows.slice(a, b - a).serialize().to_pybytes() for a, b in zip(some[:-1], some[1:], strict=True)]
                yield pa.record_batch([pa.array(part[some[:-1]]), pa.array(data, pa.binary())], ["part", "data"])

        for b in batches:
            there, keys = b.column(1), b.column(b.num_columns - 1)
            take = pa.array(np.repeat(np.arange(b.num_rows), there.value_lengths().fill_null(0).to_numpy()))
            fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * BANDS), b.num_rows, [None, pa.py_buffer(np.ascontiguousarray(keys.flatten().to_numpy()))])
            mine = [b.column(0), *b.columns[3:-1], fixed, b.column(2)]
            if len(take):
                held.append(pa.RecordBatch.from_arrays([there.flatten(), *[c.take(take) for c in mine]], schema=schema))
                size += held[-1].nbytes
            if size >= PACK:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, last = [], 0, None

        def out() -> pa.RecordBatch:
            a, b = near_in_buckets(pa.Table.from_batches(held).combine_chunks(), similarity)
            return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if part != last and count >= CHUNK:
                    yield out()
                    held, count = [], 0
                last = part
                held.append(pa.ipc.read_record_batch(pa.py_buffer(data.as_buffer().to_pybytes()), schema))
                count += held[-1].num_rows
        if held:
            yield out()

    packed = texts.where("size(there) > 0").select("hash", "there", "t", "sim", *MARKS, "keys").mapInArrow(frees(pack), "part int, data binary")
    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(frees(run), "a long, b long")


def block_keys(radius: int = RADIUS, count: int = 0) -> str:
    """SQL: the keys of a SimHash ``sim``, one for each ``agree`` of radius + agree blocks, for within ``radius`` bits so many agree.

    ``agree`` is two, or as many more as keys need to have log2(count) bits, so that unrelated ones of ``count`` fingerprints seldom share a key."""
    agree = 2
    while 64 * agree < (radius + agree) * np.log2(max(count, 2)) and agree < 6:
        agree += 1
    edges = np.linspace(0, 64, radius + agree + 1).astype(int)
    masks = [((1 << int(hi)) - 1) ^ ((1 << int(lo)) - 1) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    groups = [sum(some) for some in combinations(masks, agree)]
    keys = [f"xxhash64({i}, sim & {m - (1 << 64) if m >> 63 else m}L)" for i, m in enumerate(groups)]
    return "array(" + ", ".join(keys) + ")"


def removals(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, radius: int | None = RADIUS) -> DataFrame:
    """(id, version, removed): for each document that loses lines, their numbers (from 0) in order. ``docs``: (id, text); rows of one id and different texts, told apart by version, are different documents."""
    small_batches(docs.sparkSession)
    docs = docs.where("id is not null")
    scan = cut(scan_lines(docs, min_words) if radius is not None else scan_reach(docs, min_words), "lines")
    occur = scan.where("not again")
    # dealt out before the minimum of structs, which needs a sort: one instead of two, for within a block few lines repeat
    first = occur.repartition("hash").groupBy("hash").agg(F.min(F.struct("id", "version", "line")).alias("first"), F.count("*").alias("times"), *([F.max("sim").alias("sim")] if radius is not None else []))
    first = cut(first, "first")

    def fetch(lines: DataFrame, run: Callable, schema: str) -> DataFrame:
        """What ``run`` makes of the texts and their wanted ``lines`` (id, version, and what it takes of each)."""
        want = lines.groupBy("id", "version").agg(F.collect_list(F.struct(*[c for c in lines.columns if c not in ("id", "version")])).alias("want"))
        few = lines.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        texts = docs.withColumn("version", F.xxhash64("text")).join(F.broadcast(want) if few else want, ["id", "version"])
        return texts.select("want", "text").mapInArrow(frees(run), schema)

    def compared(pairs: DataFrame, every: DataFrame) -> DataFrame:
        return pairs.join(every.toDF("a", "ta"), "a").join(every.toDF("b", "tb"), "b")

    if radius is None:
        comp, places = _reached(occur, first, fetch, compared, similarity)
    else:

        def verify(near: DataFrame) -> DataFrame:
            wanted = near.select(F.col("a").alias("hash")).union(near.select("b")).distinct()
            lines = cut(first.select("hash", "first.*").join(wanted, "hash"), "want")
            # a text that is there twice gives its lines twice; they, not texts, go to the shuffle
            texts = cut(fetch(lines, picked, "hash long, t string").dropDuplicates(["hash"]), "texts")
            out = cut(linked(compared(near, texts), similarity), "links")
            release(lines, texts)
            return out

        keys = first.select(F.explode(F.expr(block_keys(radius, first.count()))).alias("key"), F.col("hash").alias("node"))
        raw, marks = bucket_stars(keys), first.select(F.col("hash").alias("node"), F.col("sim").alias("m"))
        comp, links = similarity_groups(raw, marks, f"bit_count(ma ^ mb) <= {radius}", verify, 2)
        places = first.select("hash", "first")
        release(raw, links)
    rooted = places.join(comp.withColumnRenamed("node", "hash"), "hash").select("hash", "root", "first")
    kept = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("keep")), "root").select("hash", "keep")
    keep = first.join(kept, "hash", "left").where("times > 1 or keep is not null").select("hash", F.coalesce("keep", "first").alias("keep"))
    place = ["id", "version", "line"]
    gone = occur.join(keep, "hash").where(F.struct(*place) != F.col("keep")).select(*place)
    gone = scan.where("again").select(*place).union(gone)
    gone = cut(gone.groupBy("id", "version").agg(F.sort_array(F.collect_set("line")).alias("removed")), "gone")
    release(scan, first, comp, *([places] if radius is None else []))
    return gone


def _reached(occur: DataFrame, first: DataFrame, fetch: Callable, compared: Callable, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The components (node, root) of near lines that share a key, and where each of the lines that share one first occurs (hash, first); both are written.

    The texts of such lines are read once. Buckets of up to CROWD lines are compared within a task each; those of larger ones in rounds over all tasks, as similarity_groups does."""
    met = cut(packed_buckets(occur.where("size(keys) > 0").select(F.col("hash").alias("node"), "keys")), "met")
    crowd = F.col("n") > CROWD
    buckets = met.groupBy("node").agg(F.collect_list(F.when(~crowd, F.col("key"))).alias("there"), F.max(crowd).alias("crowd"))
    places = cut(first.select("hash", "first").join(buckets.withColumnRenamed("node", "hash"), "hash"), "places")
    schema = "hash long, there array<long>, crowd boolean, t string, sim long, " + ", ".join(f"{m} long" for m in MARKS) + ", keys array<long>"
    texts = cut(fetch(places.select("hash", "first.*", "there", "crowd"), signed_texts, schema), "texts")
    small = cut(bucket_links(texts, similarity), "links")
    raw = cut(stars(met.where(crowd), "xxhash64(node)"), "stars")
    # a text that is there twice gives its lines twice
    about = cut(texts.where("crowd").selectExpr("hash", "t", f"struct({', '.join(('sim', *MARKS))}) as m").dropDuplicates(["hash"]), "marks")
    every, marks = about.select("hash", "t"), about.select(F.col("hash").alias("node"), "m")

    def verify(near: DataFrame) -> DataFrame:
        own = every
        if near.limit(BROADCAST_ROWS // 2 + 1).count() <= BROADCAST_ROWS // 2:
            own = every.join(F.broadcast(near.select(F.col("a").alias("hash")).union(near.select("b")).distinct()), "hash")
        return cut(linked(compared(near, own).where(f"least(length(ta), length(tb)) >= {similarity:.6f} * greatest(length(ta), length(tb)) - 1e-9"), similarity), "links")

    def settle(dealt: DataFrame, asked: DataFrame) -> DataFrame:
        keyed = cut(dealt.groupBy("node").agg(F.collect_set("key").alias("keys")), "keyed")
        hubs = asked.join(keyed.select("node"), "node", "left_semi").groupBy("node").agg(F.collect_set("hub").alias("hubs"))
        own = keyed.join(every.withColumnRenamed("hash", "node"), "node").join(marks.select("node", "m.*"), "node").join(hubs, "node", "left")
        own = cut(own, "about")
        out = cut(left_links(dealt, own, similarity), "links")
        release(keyed, own)
        return out

    bits = [f"(ma.{c} ^ mb.{c})" for c in MARKS[:-1]]
    differ = " + ".join(f"bit_count(({x} | shiftright({x}, 1) | shiftright({x}, 2) | shiftright({x}, 3)) & {0x111111111111111}L)" for x in bits)
    close = f"least(ma.n, mb.n) >= {similarity:.6f} * greatest(ma.n, mb.n) - 2 and bit_count(ma.sim ^ mb.sim) <= {REACH} and {differ} <= {APART}"
    rounds, links = similarity_groups(raw, marks, close, verify, 2, settle)
    comp, moved = merged(rounds, small)
    release(met, texts, small, raw, about, rounds, moved, links)
    return comp, places.select("hash", "first")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, radius: int | None = None, id_col: str = "doc_id", text_col: str = "text", removed_col: str = "removed_lines") -> DataFrame:
    """``docs`` with the removed lines taken out of the text, and their numbers (array<int>) in ``removed_col``, which replaces a column of that name.

    Lines end at ``\\n``. Lines of ``min_words`` words or more link if their edit similarity (1 - distance / longer length, of the normalised lines) is ``similarity`` or more
    and their SimHashes of words differ in REACH bits at most; candidates come from minima of word hashes. Equal lines always link, short ones too; lines without a word stay. With a ``radius``, SimHashes of word pairs
    within that many bits give the candidates, and lines of fewer than ``min_words`` words stay. Of equal occurrences the smallest document id, then the smaller hash of the text, then the line number decides.
    Null texts stay null, rows with a null id stay as they are and take no part. Rows of equal id and text are one document for what counts as an occurrence, rows of equal id and different texts are
    different ones. Other columns are kept, whatever their names. An empty table gives an empty table."""
    own = docs.drop(removed_col)
    src = own.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    number, version, lost = fresh(own.columns, "id", "version", "lost")
    gone = removals(src, min_words, similarity, radius).toDF(number, version, lost)
    joined = own.join(gone.hint("merge"), (F.col(f"`{id_col}`").cast("long") == F.col(number)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(version)), "left")
    rest = F.expr(f"""aggregate(array(split(`{text_col}`, '\\n', -1)), cast(array() as array<string>),
      (a, x) -> transform(array_except(sequence(0, size(x) - 1), {lost}), i -> get(x, i)))""")
    text = F.when(F.col(lost).isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(rest, "\n"))
    none = F.expr("cast(array() as array<int>)")
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in own.columns], F.coalesce(lost, none).alias(removed_col))
