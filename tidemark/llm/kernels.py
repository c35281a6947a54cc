"""Vectorised text kernels over Arrow string columns (numpy, no loop over words).

A word is ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Hashes are 64-bit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text that are worked on at once; a longer word or document extends a piece.
PIECE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_P = 0x2545F4914F6CDD1D
_P_INV = pow(_P, -1, 1 << 64)
_STEP = 0xD6E8FEB86659FD93
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1024)
        have = np.full(size, U(base), U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offsets, data = col.buffers()
    n = len(col)
    off = np.frombuffer(offsets, np.int64, n + 1, col.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


@dataclass
class Words:
    """Words of a batch: ``hash[i]`` is the i-th word; document d has words ``first[d]:first[d+1]``."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(raw: np.ndarray, off: np.ndarray, lower: bool = True, boundary: np.ndarray | None = None) -> Words:
    """Words with byte positions. ``boundary``: bytes that separate words (bool table of 256), white space if None."""
    table = _SPACE if boundary is None else boundary
    edges = off[:-1][np.diff(off) > 0]
    hashes, starts, ends = [], [], []
    at, n = 0, len(raw)
    while at < n:
        to = min(n, at + PIECE)
        if to < n:  # end the piece at a boundary
            k = np.searchsorted(edges, to, "right") - 1
            edge = int(edges[k]) if k >= 0 else 0
            gap = np.flatnonzero(table[raw[at:to]])
            cut = max(edge, at + int(gap[-1]) + 1 if len(gap) else 0)
            while cut <= at:  # one word longer than a piece
                more = min(n, to + PIECE)
                gap = np.flatnonzero(table[raw[to:more]])
                k = np.searchsorted(edges, to, "right")
                edge = int(edges[k]) if k < len(edges) else n
                cut = min(edge, to + int(gap[0]) + 1 if len(gap) else n + 1)
                if cut > more:
                    cut, to = at, more
                    if more >= n:
                        cut = n
            to = cut
        part = raw[at:to]
        inside = ~table[part]
        before = np.empty(len(part), bool)
        before[0] = False
        before[1:] = inside[:-1]
        here = edges[np.searchsorted(edges, at) : np.searchsorted(edges, to)] - at
        before[here] = False
        s = np.flatnonzero(inside & ~before)
        after = np.empty(len(part), bool)
        after[-1] = False
        after[:-1] = inside[1:]
        last = here[here > 0] - 1
        after[last] = False
        e = np.flatnonzero(inside & ~after) + 1
        if len(s):
            pw = powers(_P, len(part) + 1)
            total = np.empty(len(part) + 1, U)
            total[0] = 0
            np.cumsum(_TABLE[_LOWER[part] if lower else part] * pw[1:], out=total[1:])
            hashes.append(mix((total[e] - total[s]) * powers(_P_INV, len(part) + 1)[s]))
            starts.append(s + at)
            ends.append(e + at)
        at = to
    if not hashes:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, U), none, none, np.zeros(len(off), np.int64))
    h, s, e = np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)
    return Words(h, s, e, np.searchsorted(s, off, "left"))


def shingles(w: Words, k: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): all k-word shingles in order; document d has hashes ``first[d]:first[d+1]``.

    With fewer than k words, a document's whole sequence is one shingle (if ``whole``); without words it has none."""
    n = w.counts
    have = np.where(n >= k, n - k + 1, np.where((n > 0) & whole, 1, 0))
    first = np.concatenate([[0], np.cumsum(have)])
    out = np.zeros(first[-1], U)
    if len(w.hash) >= k:
        step = [U(pow(_STEP, j, 1 << 64)) for j in range(k)]
        size = len(w.hash) - k + 1
        acc = np.zeros(size, U)
        for j in range(k):
            acc += w.hash[j : j + size] * step[j]
        long = n >= k
        keep = np.ones(size, bool)  # positions whose shingle stays in its document
        for j in range(1, k):
            bad = w.first[1:-1] - j
            keep[bad[(bad >= 0) & (bad < size)]] = False
        at = np.ones(first[-1], bool)
        at[first[:-1][~long & (have > 0)]] = False
        pick = keep if long.all() else keep & np.repeat(long, n)[:size]
        out[at] = acc[pick]
    for d in np.flatnonzero((n < k) & (have > 0)):
        own = w.hash[w.first[d] : w.first[d + 1]]
        out[first[d]] = (own * powers(_STEP, len(own))).sum(dtype=U)
    return mix(out), first


def distinct_sorted(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's hashes sorted and without repeats."""
    h = h.copy()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a > 1:
            h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = h[1:] != h[:-1]
    keep[first[:-1][first[:-1] < first[1:]]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return h[keep], total[first]


def segment_sum(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of x[first[d]:first[d+1]], modulo 2**64 for unsigned x."""
    total = np.concatenate([np.zeros(1, x.dtype), np.cumsum(x, dtype=x.dtype)])
    return total[first[1:]] - total[first[:-1]]


# Bits of a byte spread over eight byte lanes of a 64-bit word.
_SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], U)
_LANES = U(0x0101010101010101)


def simhash_spans(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit SimHash of the hashes h[start:end] (unit weights, majority of each bit; a tie gives 0).

    Bit counts of eight bits are packed in the byte lanes of one word, so that a
    difference of prefix sums counts them for spans of up to 127 hashes; longer spans are added up in pieces."""
    n = end - start
    out = np.zeros(len(start), U)
    short = np.flatnonzero(n <= 127)
    long = np.flatnonzero(n > 127)
    view = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)
    half = (n // 2).astype(U)
    pieces = -(-n[long] // 127)
    head = np.concatenate([[0], np.cumsum(pieces)])[:-1]
    cuts = np.repeat(start[long] - head * 127, pieces) + np.arange(pieces.sum()) * 127
    to = np.minimum(cuts + 127, np.repeat(end[long], pieces))
    for byte in range(8):
        total = np.concatenate([np.zeros(1, U), np.cumsum(_SPREAD[view[:, byte]])])
        if len(short):
            lanes = total[end[short]] - total[start[short]]
            lanes = (lanes + (U(127) - half[short]) * _LANES) & U(0x8080808080808080)
            bits = ((lanes >> U(7)) * U(0x0102040810204080)) >> U(56)
            out[short] |= bits << U(8 * byte)
        if len(long):
            lanes = total[to] - total[cuts]
            count = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int32), head, axis=0)
            out[long] |= np.packbits(count > half[long, None].astype(np.int32), axis=1, bitorder="little")[:, 0].astype(U) << U(8 * byte)
    return out


def edit_distances(left: list[np.ndarray], right: list[np.ndarray], most: list[int] | None = None) -> np.ndarray:
    """The edit distance of each pair of texts (arrays of code points), of many pairs at once, by Myers' bit-parallel columns in blocks of 64 rows.

    In one step a block of every pair takes the column after its last one, each block one column behind the block above, so that the carries of the step before are at hand.
    With ``most``, only blocks on paths that cost so much at most are worked on: a distance up to ``most`` is exact, of others only that they are greater."""
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(left, right, strict=True)]
    m, n = (np.array([len(p[i]) for p in pairs], np.int64) for i in (0, 1))
    k = n if most is None else np.minimum(np.array(most, np.int64), n)
    out = n.copy()
    order = np.flatnonzero((m > 0) & (n - m <= k))
    # a like number of blocks, and of them like bands
    order = order[np.lexsort(((k - n + m)[order], np.ceil(np.log2(m[order] / 64 + 1) * 4)))]
    at = 0
    while at < len(order):
        to = at + 1  # a group: some 8,000 blocks, few enough for tables of 4 MB with an alphabet of 64
        high = -(-m[order[at]] // 64)
        while to < len(order) and (to - at + 1) * (high := max(high, -(-m[order[to]] // 64))) <= 8192:
            to += 1
        own = order[at:to]
        out[own] = _edit_columns([pairs[i] for i in own], m[own], n[own], k[own])
        at = to
    return out


def _edit_columns(pairs: list[tuple[np.ndarray, np.ndarray]], m: np.ndarray, n: np.ndarray, k: np.ndarray) -> np.ndarray:
    count, high = len(pairs), int(-(-m.max() // 64))
    every = np.concatenate([c for p in pairs for c in p])
    there = np.zeros(int(every.max()) + 1, np.int64)
    there[every] = 1
    letters = int(there.sum())
    ids = (np.cumsum(there) - 1)[every]
    if letters * high * count > 4_000_000 and count > 1:  # many letters: smaller groups
        half = count // 2
        return np.concatenate([_edit_columns(pairs[:half], m[:half], n[:half], k[:half]), _edit_columns(pairs[half:], m[half:], n[half:], k[half:])])
    size, last = high * count, (m - 1) // 64
    steps = int((n + last).max())
    where = np.full((steps + high, count), letters * size, np.int64)  # no letter before and after a text
    same = np.zeros((letters + 1) * size, U)  # by letter, block and pair: rows that have it
    i = 0
    for p, (x, y) in enumerate(pairs):
        rows = np.arange(len(x))
        np.bitwise_or.at(same, ids[i : i + len(x)] * size + (rows >> 6) * count + p, U(1) << (rows & 63).astype(U))
        i += len(x)
        where[: len(y), p] = ids[i : i + len(y)] * size
        i += len(y)
    own, lanes = np.arange(size).reshape(high, count), np.arange(count)
    up, down = np.full((high, count), ~U(0)), np.zeros((high, count), U)  # where the rows of a column rise, and where they fall
    rise, fall = np.ones((high + 1, count), U), np.zeros((high + 1, count), U)  # what the block above hands down
    # a path that costs k at most keeps within (k - (n - m)) / 2 diagonals of the two through the corners: of all pairs the widest
    below = (k - (n - m)) // 2
    above, below = int((n - m + below).max()), int(below.max())
    score = np.zeros((high, count), np.int64)  # of a block's last row, of a pair's last block that of the text's
    one, bit, tall = U(1), ((m - 1) & 63).astype(U), np.full((high, count), 64, np.int64)
    tall[last, lanes] = ((m - 1) & 63) + 1
    shift = np.full((high, count), U(63))
    shift[last, lanes] = bit
    end = n + last
    out, begun, h0 = n + 1, 0, 0
    for s in range(steps):
        h = min(high, s + 1, max((s + below) // 65 + 1, begun))  # blocks that have begun
        g = min(max(0, -((above + 63 - s) // 65)), h - 1)  # blocks that are done
        for b in range(begun, h):
            score[b] = tall[b] + (score[b - 1] - rise[b].astype(np.int64) + fall[b].astype(np.int64) if b else 0)
        begun = h
        if g > h0:
            h0 = g  # whose first carry is still that of the block above
        elif h0:  # what is above counts as risen, which is no less than it is
            rise[h0], fall[h0] = one, 0
        eq = same[where[s - h + 1 : s - h0 + 1][::-1] + own[h0:h]]
        pv, mv, pin, min_ = up[h0:h], down[h0:h], rise[h0:h], fall[h0:h]
        xv = eq | mv
        eq |= min_
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        score[h0:h] += ((ph >> shift[h0:h]) & one).view(np.int64) - ((mh >> shift[h0:h]) & one).view(np.int64)
        hand_up, hand_down = ph >> U(63), mh >> U(63)
        ph, mh = (ph << one) | pin, (mh << one) | min_
        up[h0:h], down[h0:h] = mh | ~(xv | ph), ph & xv
        rise[h0 + 1 : h + 1], fall[h0 + 1 : h + 1] = hand_up, hand_down
        done = np.flatnonzero(end == s + 1)
        if len(done):
            out[done] = score[last[done], done]
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(flat: pa.Array, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), flat)
