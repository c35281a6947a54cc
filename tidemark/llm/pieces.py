"""SentencePiece encoding and decoding: best-scored segmentation by a max-plus parallel scan.

The pieces and scores of a model file are a unigram lattice: of all ways to cut a text into pieces, the one with the
highest sum of scores is taken (ranks, which models of merges have as scores, count as unigram log-probabilities by Zipf's law). A document over CHUNK characters is split into chunks. A chunk's transfer matrix holds, for every
number of its first characters that a piece of the chunk before already covers (state in) and every number of
characters of the next chunk that its own last piece covers (state out), the best score between. Matrices combine
associatively under (max, +); the chain of best states is found from them alone, and each chunk is then backtraced on its own.
Of equal segmentations that with the longest last piece is taken, then that with the longest one before it, and so on; a chunk's ranks carry
this order of its paths, so where a text is cut changes no id. Since no piece of the vocabulary goes on past a space, most of a text is words,
each of which is looked up once a batch.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import kernels as K
from .shared import cut, frees, fresh, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 1 << 15
#: Words whose pieces a worker remembers, twice.
MEMORY = 60_000
#: Bytes of text and ids that are worked on at once; a longer text extends them.
TEXT, IDS = 1 << 20, 1 << 17
SPACE = "▁"
_NEVER = -np.inf


class Vocabulary:
    """Pieces, scores and bytes of a model file with identity normalisation, a dummy prefix and byte fallback."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        size = m.get_piece_size()
        plain = [i for i in range(size) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        scores = [m.get_score(i) for i in plain]
        if all(s == int(s) for s in scores):  # ranks, as in a model of merges: the share of a piece falls as one over its rank
            scores = [-math.log(2 - s) for s in scores]
        # multiples of 2**-20, so that sums are exact in any order
        self.piece = {m.id_to_piece(i): (i, round(s * 2**20) / 2**20) for i, s in zip(plain, scores, strict=True)}
        self.longest = max(map(len, self.piece))
        self.byte = {int(m.id_to_piece(i)[3:5], 16): i for i in range(size) if m.is_byte(i)}
        self.unknown = min(s for _, s in self.piece.values()) - 10.0  # a character that no piece has: its bytes
        self.bytes = [b""] * size
        for p, (i, _) in self.piece.items():
            self.bytes[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte.items():
            self.bytes[i] = bytes([b])
        self.unk = m.unk_id()
        self.bytes[self.unk] = " ⁇ ".encode()
        # no piece goes over a place between two characters that no piece has side by side; seen in the bytes of UTF-8, which can only miss such places
        self.joined = np.zeros((256, 256), bool)
        self.joined[:, 0x80:0xC0] = True  # inside a character
        for p in self.piece:
            raw = np.frombuffer(p.replace(SPACE, " ").encode(), np.uint8)
            self.joined[raw[:-1], raw[1:]] = True
        self.root: dict[str, list] = {}  # by character: [following characters, id or -1, score]
        self.memory: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.score = np.zeros(size)  # of each id; the first byte of a character that no piece has stands for all of it
        for i, score in self.piece.values():
            self.score[i] = score
        for b, i in self.byte.items():
            self.score[i] = 0.0 if 0x80 <= b < 0xC0 else self.unknown
        self.length = np.array([len(x) for x in self.bytes] + [0])
        self.begin = np.concatenate([[0], np.cumsum(self.length)])
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)

    def __getstate__(self):
        return self.__dict__ | {"memory": {}, "older": {}, "root": {}}

    def tree(self) -> dict[str, list]:
        if not self.root:
            for p, (i, score) in self.piece.items():
                below = self.root
                for c in p:
                    node = below.setdefault(c, [{}, -1, 0.0])
                    below = node[0]
                node[1:] = i, score
        return self.root

    def options(self, text: str, i: int) -> Iterator[tuple[int, tuple[int, ...], float]]:
        """(length, ids, score) of the pieces at text[i:], short to long."""
        got, below = False, self.tree()
        for j in range(i, len(text)):
            node = below.get(text[j])
            if node is None:
                break
            below, piece, score = node
            if piece >= 0:
                got |= j == i
                yield j - i + 1, (piece,), score
        if not got:
            yield 1, tuple(self.byte[b] for b in text[i].encode()), self.unknown

    def word(self, text: str) -> tuple[bytes, float]:
        """(ids as little-endian int32, score) of the best segmentation; of equal ones that with the longest last piece."""
        root, unknown, n = self.tree(), self.unknown, len(text)
        best, came, piece = [_NEVER] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            own, j, single, below = best[i], i, False, root
            while j < n:
                node = below.get(text[j])
                if node is None:
                    break
                j += 1
                below, found, score = node
                if found >= 0:
                    if j == i + 1:
                        single = True
                    score += own
                    if score > best[j]:
                        best[j], came[j], piece[j] = score, i, found
            if not single and own + unknown > best[i + 1]:
                best[i + 1], came[i + 1], piece[i + 1] = own + unknown, i, -1
        out, at = [], n
        while at:
            if piece[at] >= 0:
                out.append(piece[at])
            else:
                out += [self.byte[b] for b in reversed(text[at - 1].encode())]
            at = came[at]
        out.reverse()
        return array("i", out).tobytes(), best[n]

    def known(self, word: bytes) -> bytes:
        """The ids of a word that no piece crosses."""
        x = self.memory.get(word)
        if x is None:
            if len(self.memory) >= MEMORY:  # words that come again move from the older half
                self.older, self.memory = self.memory, {}
            x = self.older.get(word)
            if x is None:
                x = self.word(word.decode().replace(" ", SPACE))[0]
            self.memory[word] = x
        return x

    def prepare(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def word_starts(self, raw: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where words begin: at ``first``, and where no piece goes over."""
        start = np.ones(len(raw), bool)
        start[1:] = ~self.joined[raw[:-1], raw[1:]]
        start[first] = True
        return np.flatnonzero(start)

    def look_up(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word) of the words that begin at ``starts`` and cover ``raw``."""
        edges = np.append(starts, len(raw)).astype(np.int64)
        all_words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
        code = all_words.indices.to_numpy()
        found = [self.known(w) for w in all_words.dictionary.to_pylist()]
        count = np.array([len(x) // 4 for x in found], np.int64)
        ids = np.frombuffer(b"".join(found), "<i4")
        n = count[code]
        return ids[_spans((np.cumsum(count) - count)[code], n)], n

    def encode(self, col: pa.Array) -> pa.Array:
        """The ids of each text; of null, null."""
        out = []
        if pc.any(pc.match_substring(col, SPACE)).as_py():
            col = pc.replace_substring(col, SPACE, " ")  # the two are one character to the pieces
        raw, off = K.text_buffers(col)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(off, off[at] + TEXT, "right")) - 1)
            own, edges = raw[off[at] : off[to]], off[at : to + 1] - off[at]
            some = np.diff(edges) > 0
            own, edges = np.insert(own, edges[:-1][some], 32), edges + np.concatenate([[0], np.cumsum(some)])  # the dummy prefix
            if len(own):
                starts = self.word_starts(own, edges[:-1][some])
                ids, n = self.look_up(own, starts)
                first = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, edges)]
            else:
                ids, first = np.zeros(0, np.int32), edges
            out.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids)))
            at = to
        got = pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))
        return pc.if_else(col.is_valid(), got, None) if col.null_count else got

    def decode(self, col: pa.Array) -> pa.Array:
        """The text of each row of ids, null of null. Invalid bytes become U+FFFD, ids that the vocabulary lacks the sign for the unknown; null ids are left out. One leading space, the dummy prefix, goes."""
        out, at = [], 0
        size, edges = len(self.bytes), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(col), 0).to_numpy())])
        while at < len(col):
            part = col.slice(at, max(1, int(np.searchsorted(edges, edges[at] + IDS, "right")) - 1 - at))
            at += len(part)
            flat = part.flatten()
            count = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(part), 0).to_numpy())])
            ids = flat.fill_null(-1).to_numpy().astype(np.int64)
            ids = np.where((ids >= 0) & (ids < size) | (flat.is_null().to_numpy(zero_copy_only=False)), ids, self.unk)
            n = self.length[ids]
            raw = self.flat[_spans(self.begin[:-1][ids], n)]
            off = np.concatenate([[0], np.cumsum(n)])[count]
            lead = np.diff(off) > 0
            lead[lead] = raw[off[:-1][lead]] == 32
            keep = np.ones(len(raw), bool)
            keep[off[:-1][lead]] = False
            raw, off = raw[keep], off - np.concatenate([[0], np.cumsum(lead)])
            text = pa.Array.from_buffers(pa.large_string(), len(part), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])
            try:
                text.validate(full=True)
            except pa.ArrowInvalid:
                text = pa.array([raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:], strict=True)], pa.large_string())
            out.append(pc.if_else(part.is_valid(), text, None) if part.null_count else text)
        return pa.concat_arrays(out).cast(pa.string()) if out else pa.array([], pa.string())

    # -- chunks of a giant text
    def split(self, text: str, size: int) -> tuple[int, int]:
        """Where a chunk's first and last inner cut are; (size, size) if it has none.

        ``text`` has the chunk's ``size`` characters and up to longest - 1 more."""
        raw = np.frombuffer(text.replace(SPACE, " ").encode(), np.uint8)
        if not len(raw):
            return size, size
        spots = np.cumsum((raw & 0xC0) != 0x80)[self.word_starts(raw, np.zeros(1, int))] - 1
        spots = spots[(spots >= self.longest) & (spots <= size)]
        return (int(spots[0]), int(spots[-1])) if len(spots) else (size, size)

    def matrix(self, text: str, size: int) -> tuple[np.ndarray, np.ndarray, str, int, int, bytes]:
        """A chunk's transfer matrix best[s, e], from character s to character size + e by pieces that begin before ``size``; the rank[s, e] of
        that path among those to e; and what the backtrace needs: the characters before the first and after the last inner cut, the numbers of these cuts, the ids between."""
        w = self.longest
        lo, hi = self.split(text, size)
        inner = lo < size  # else no inner cut, or one at the chunk's end
        best, came = self._steps(text[:lo] if inner else text, lo, np.arange(w), True)
        if not inner:
            ranks = np.array([self._ranks(came, size + e, w) for e in range(w)]).T
            return self._fit(best[size : size + w].T, w), ranks, text, -1, hi, b""
        raw = np.frombuffer(text[lo:hi].replace(SPACE, " ").encode(), np.uint8)
        ids, score = b"", 0.0
        if len(raw):
            flat, _ = self.look_up(raw, self.word_starts(raw, np.zeros(1, int)))
            ids, score = flat.astype("<i4").tobytes(), self.score[flat].sum()
        tail = self._steps(text[hi:], size - hi, np.zeros(1, int), False)[0]
        m = self._fit(best[lo][:, None] + score + tail[size - hi : size - hi + w].T, w)
        return m, np.repeat(self._ranks(came, lo, w)[:, None], w, axis=1), text[:lo] + text[hi:], lo, hi, ids

    def _ranks(self, came: list[dict], at: int, w: int) -> np.ndarray:
        """For each start, how many starts have a path to ``at`` that goes before its own: one with an earlier last cut, then an earlier one before that, and so on."""
        paths = []
        for s in range(w):
            cuts, i = [], at
            while i < len(came) and s in came[i]:
                i = came[i][s][0]
                cuts.append(i)
            paths.append((cuts, s))
        out = np.zeros(w, int)
        out[[s for _, s in sorted(paths)]] = np.arange(w)
        return out

    def trace(self, rest: str, lo: int, middle: bytes, size: int, hi: int, s: int, e: int) -> bytes:
        """The ids of a chunk on the best path from state s to state e."""
        if lo < 0:
            return self._trace(self._steps(rest, size, np.arange(self.longest), True)[1], size + e, s)[0]
        first = self._trace(self._steps(rest[:lo], lo, np.arange(self.longest), True)[1], lo, s)[0]
        return first + middle + self._trace(self._steps(rest[lo:], size - hi, np.zeros(1, int), True)[1], size - hi + e, 0)[0]

    @staticmethod
    def _fit(m: np.ndarray, w: int) -> np.ndarray:
        out = np.full((w, w), _NEVER)
        out[:, : m.shape[1]] = m
        return out

    def _steps(self, text: str, size: int, starts: np.ndarray, keep: bool):
        """best[position, start]; came[position]: (from, ids) for each start, if ``keep``."""
        n = len(text)
        best = np.full((n + 1, len(starts)), _NEVER)
        came: list[dict[int, tuple]] = [{} for _ in range(n + 1)] if keep else []
        for j, s in enumerate(starts.tolist()):
            if s <= n:
                best[s, j] = 0.0
        for i in range(min(size, n)):
            row = best[i]
            if row.max() == _NEVER:
                continue
            for length, ids, score in self.options(text, i):
                new = row + score
                better = new > best[i + length]
                if better.any():
                    best[i + length][better] = new[better]
                    if keep:
                        for j in np.flatnonzero(better).tolist():
                            came[i + length][j] = (i, ids)
        return best, came

    @staticmethod
    def _trace(came: list[dict], at: int, start: int) -> tuple[bytes, int]:
        """From ``at`` back to where the path of the given start began."""
        j, out = start, []
        while j in came[at]:
            at, ids = came[at][j]
            out.append(ids)
        return np.array([i for ids in reversed(out) for i in ids], "<i4").tobytes(), at


def plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (max, +) product."""
    return (a[:, :, None] + b[None]).max(axis=1)


def states(matrices: list[np.ndarray], ranks: list[np.ndarray]) -> list[tuple[int, int]]:
    """(state in, state out) of each chunk on the best path from state 0 to state 0, by an inclusive scan from the left; of equal ones, those of the least rank."""
    n = len(matrices)
    prefix = list(matrices)
    step = 1
    while step < n:  # after each turn, prefix[i] is the product of twice as many matrices
        prefix = [plus(prefix[i - step], prefix[i]) if i >= step else prefix[i] for i in range(n)]
        step *= 2
    out, e = [], 0
    for i in range(n - 1, -1, -1):
        before = prefix[i - 1][0] if i else np.where(np.arange(len(matrices[0])) == 0, 0.0, _NEVER)
        total = before + matrices[i][:, e]
        best = np.flatnonzero(total == total.max())
        s = int(best[ranks[i][best, e].argmin()])
        out.append((s, e))
        e = s
    return out[::-1]


def _spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... up to n[0] of them, then those of start[1], and so on."""
    out = np.repeat(start - (np.cumsum(n) - n), n)
    out += np.arange(len(out))
    return out


def _ids(flat: list[bytes | None]) -> pa.Array:
    n = np.concatenate([[0], np.cumsum([len(x) // 4 if x is not None else 0 for x in flat])])
    values = pa.array(np.frombuffer(b"".join(x for x in flat if x is not None), "<i4"))
    mask = pa.array([x is None for x in flat], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(n.astype(np.int32)), values, mask=mask)


def encode(docs: DataFrame, path: str = MODEL, text_col: str = "text", out_col: str = "tokens", chunk: int = CHUNK, decoded_col: str | None = None) -> DataFrame:
    """``docs`` with the ids of every whole text in ``out_col`` (array<int>), and what they decode to in ``decoded_col`` if one is named; these replace columns of these names.

    A null text has null ids, an empty one none. ``chunk``, the characters that one task takes at once, changes no id. Repeated rows, null ids and other columns, whatever
    their names, are kept as they are; row order isn't. An empty table gives an empty table."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    vocabulary = spark.sparkContext.broadcast(Vocabulary(path))  # a vocabulary's size
    src = docs.drop(out_col, decoded_col) if decoded_col else docs.drop(out_col)
    at = src.columns.index(text_col)
    full = src.withColumn(out_col, F.lit(None).cast("array<int>")).schema
    both = StructType([*full, StructField(decoded_col, StringType())]) if decoded_col else full
    size = F.coalesce(F.length(F.col(f"`{text_col}`")), F.lit(0))

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for b in batches:
            ids = v.encode(b.column(at))
            back = [v.decode(ids)] if decoded_col else []
            yield pa.record_batch([*b.columns, ids, *back], both.names)

    short = src.where(size <= chunk).mapInArrow(frees(direct), both)
    giant = src.where(size > chunk)
    if giant.isEmpty():
        return short
    (key,) = fresh(src.columns, "row")
    giant = cut(giant.withColumn(key, F.monotonically_increasing_id()), "giant")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = v.prepare(text)
                for c in range(0, len(text), chunk):
                    yield pa.record_batch([pa.array([row], pa.int64()), pa.array([c // chunk], pa.int32()), pa.array([min(chunk, len(text) - c)], pa.int32()), pa.array([text[c : c + chunk + v.longest - 1]])], ["row", "chunk", "size", "text"])

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for b in batches:
            for row, c, n, text in zip(*[x.to_pylist() for x in b.columns], strict=True):
                m, ranks, rest, lo, hi, middle = v.matrix(text, n)
                yield pa.record_batch([pa.array([row], pa.int64()), *[pa.array([x], pa.int32()) for x in (c, n, lo, hi)], pa.array([rest]), *[pa.array([x], pa.binary()) for x in (middle, m.tobytes(), ranks.astype(np.uint8).tobytes())]], ["row", "chunk", "size", "lo", "hi", "rest", "middle", "matrix", "ranks"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = giant.select(key, f"`{text_col}`").mapInArrow(frees(split), "row long, chunk int, size int, text string").repartition(tasks, "row", "chunk")
    chunks = cut(pieces.mapInArrow(frees(transfer), "row long, chunk int, size int, lo int, hi int, rest string, middle binary, matrix binary, ranks binary"), "chunks")

    def chain(key_: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        flat = [np.frombuffer(x, float) for x in t.column("matrix").to_pylist()]
        w = int(len(flat[0]) ** 0.5)
        path_ = states([x.reshape(w, w) for x in flat], [np.frombuffer(x, np.uint8).reshape(w, w) for x in t.column("ranks").to_pylist()])
        return pa.table({"row": t.column("row"), "chunk": t.column("chunk"), "s": pa.array([s for s, _ in path_], pa.int32()), "e": pa.array([e for _, e in path_], pa.int32())})

    ways = chunks.select("row", "chunk", "matrix", "ranks").groupBy("row").applyInArrow(chain, "row long, chunk int, s int, e int")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for b in batches:
            d = b.to_pydict()
            ids = [v.trace(*x) for x in zip(*[d[c] for c in ("rest", "lo", "middle", "size", "hi", "s", "e")], strict=True)]
            yield pa.record_batch([b.column("row"), b.column("chunk"), _ids(ids)], ["row", "chunk", "ids"])

    traced = chunks.drop("matrix", "ranks").join(ways, ["row", "chunk"]).mapInArrow(frees(trace), "row long, chunk int, ids array<int>")
    whole = traced.groupBy("row").agg(F.flatten(F.expr("transform(array_sort(collect_list(struct(chunk, ids))), x -> x.ids)")).alias(out_col))
    long = giant.join(whole.withColumnRenamed("row", key), key).select(*[f"`{c}`" for c in full.names])
    return short.unionByName(decode(long, path, out_col, decoded_col) if decoded_col else long)


def decode(docs: DataFrame, path: str = MODEL, ids_col: str = "tokens", out_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of every array of ids in ``out_col``, which replaces a column of that name; null ids give null, null elements are left out,
    ids that the vocabulary lacks give the sign for the unknown. A text with U+2581 comes back with a space for it. Rows and other columns are kept; an empty table gives an empty table."""
    spark = docs.sparkSession
    small_batches(spark)
    vocabulary = spark.sparkContext.broadcast(Vocabulary(path))
    src = docs.drop(out_col)
    at = src.columns.index(ids_col)
    full = src.withColumn(out_col, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for b in batches:
            yield pa.record_batch([*b.columns, v.decode(b.column(at))], [*b.schema.names, out_col])

    return src.mapInArrow(frees(run), full)
