"""Kernels and the text operators against brute force on small fixtures."""

import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import decontaminate, kernels as K, lines, ngram_join
from tidemark.llm.graph import components, packed_buckets, packed_stars
from tidemark.llm.shared import release


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(text, k):
    w = tokens(text)
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([tuple(w)] if w else [])


RNG = random.Random(3)
TEXTS = [None, "", " ", "a", "A b", " x\ty  z ", "éÉ q w e r t", "w" * 100, " " * 50] + [" ".join(RNG.choice(["aa", "B", "cc", "DD", "é", "ff"]) for _ in range(RNG.randint(0, 400))) for _ in range(30)]


@pytest.mark.parametrize("piece", [1 << 21, 16, 64])
def test_words_shingles_and_simhash(piece, monkeypatch):
    monkeypatch.setattr(K, "PIECE", piece)
    raw, off = K.text_buffers(pa.array(TEXTS, pa.string()))
    w, data, names = K.words(raw, off), raw.tobytes(), {}
    for d, t in enumerate(TEXTS):
        got = [data[w.start[i] : w.end[i]].lower() for i in range(w.first[d], w.first[d + 1])]
        assert got == [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
    for k in (1, 4, 5):
        h, first = K.shingles(w, k)
        names = {}
        for d, t in enumerate(TEXTS):
            own = grams(t, k)
            assert first[d + 1] - first[d] == len(own)
            for g, x in zip(own, h[first[d] : first[d + 1]], strict=True):
                assert names.setdefault(g, x) == x
        assert len(set(names.values())) == len(names)
    sim = K.simhash_spans(w.hash, w.first[:-1], w.first[1:])
    for d in range(len(TEXTS)):
        own = w.hash[w.first[d] : w.first[d + 1]]
        want = sum(1 << b for b in range(64) if len(own) and int(((own >> np.uint64(b)) & np.uint64(1)).sum()) > len(own) // 2)
        assert int(sim[d]) == want


def near_copies(n=60, seed=5):
    rng = random.Random(seed)
    out = [(900, None), (901, ""), (902, "one two"), (903, "One  two"), (None, "one two")]
    for i in range(n):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 6, 12, 40, 150]))]
        for j in range(rng.choice([1, 2, 4])):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                own[rng.randrange(len(own))] = f"x{rng.randint(0, 99)}"
            out.append((i * 10 + j, " ".join(own)))
    base = [f"h{i}" for i in range(60)]
    for i in range(70):  # one large group
        own = list(base)
        own[rng.randrange(60)] = f"y{i}"
        out.append((2000 + i, " ".join(own)))
    return out + [out[7], (3000, out[7][1])]


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_jaccard_join_is_exact(spark, k, percent):
    rows = near_copies()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, `id` string")
    got = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(df, k, percent)["groups"].collect() if r.id is not None}
    sets = {i: set(grams(t, k)) for i, t in rows if i is not None}
    ids, root = sorted(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    assert got == {i: (len(sets[i]), find(i)) for i in ids}
    empty = df.where("false")
    assert ngram_join.jaccard_join(empty, k, percent)["groups"].count() == 0


def test_jaccard_join_gives_all_links(spark):
    base = [f"h{i}" for i in range(60)]
    rows = [(5000 + i, " ".join(base[:at] + [f"y{i}"] + base[at + 1 :])) for i, at in enumerate([0, 1, 2, 58, 59] * 4)] + near_copies(12)
    rows = [r for r in rows if r[0] is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = ngram_join.jaccard_join(df, 5, 80, all_links=True)
    names = {r.id: r["class"] for r in out["members"].collect() if r["class"] is not None}
    sets = {names[i]: set(grams(t, 5)) for i, t in rows if i in names}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    got = [(r.a, r.b) for r in out["links"].collect()]
    assert len(want) > 100 and len(got) == len(set(got)) and set(got) == want


def test_leaks_match_all_windows(spark):
    rng = random.Random(1)
    items = [(i, " ".join(f"b{rng.randint(0, 300)}" for _ in range(rng.choice([2, 8, 20, 35])))) for i in range(25)]
    items += [(90, None), (91, ""), (92, items[0][1])]
    docs = []
    for i, t in items[:25]:
        w = t.split()
        noise = lambda: " ".join(f"b{rng.randint(0, 300)}" for _ in range(12))
        docs += [f"{noise()} {t} {noise()}", f"{noise()} {' '.join(w[1:])} z", " ".join(w[:-1]), f"{noise()} {' '.join(w[: len(w) // 2] + ['q'] + w[len(w) // 2 + 1 :])}", noise()]
    docs += [None, "", docs[0], docs[0].upper()]

    def brute(text):
        w, out = tokens(text), set()
        for i, t in items:
            x = tokens(t)
            if x:
                want = Counter(grams(t, 5))
                for s in range(max(1, len(w) - len(x) + 1)):
                    own = Counter(grams(" ".join(w[s : s + len(x)]), 5))
                    if own and sum((own & want).values()) >= 0.8 * sum((own | want).values()) - 1e-9:
                        out.add(i)
        return sorted(out)

    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, items int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.id: r.items for r in decontaminate.find_leaks(df, bench).collect()}
    assert got == {i: brute(t) for i, t in enumerate(docs)}
    kept = decontaminate.remove_leaks(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, x in got.items() if not x}
    assert decontaminate.find_leaks(df, bench.where("false")).where("size(items) > 0").count() == 0
    assert decontaminate.find_leaks(df.where("false"), bench).count() == 0


def test_line_groups_match_all_pairs(spark):
    rng = random.Random(2)
    base = [" ".join(f"w{rng.randint(0, 999)}" for _ in range(rng.randint(4, 60))) for _ in range(40)]
    docs = []
    for i in range(60):
        own = []
        for _ in range(rng.randint(0, 6)):
            line = rng.choice(base).split()
            if rng.random() < 0.4:
                line[rng.randrange(len(line))] = rng.choice(["q", "W7", "zz"])
            own.append(rng.choice([" ", "  "]).join(line).upper() if rng.random() < 0.2 else " ".join(line))
        docs.append((i, "\n".join(own)))
    docs += [(100, None), (101, ""), (None, docs[0][1]), docs[3]]
    df = spark.createDataFrame([(i, t, i) for i, t in docs], "doc_id long, text string, line long")
    got = {r.doc_id: (r.text, list(r.removed_lines)) for r in lines.dedup_lines(df, radius=lines.RADIUS).collect() if r.doc_id is not None}

    occurrences = sorted((i, n, tuple(tokens(x))) for i, t in dict(d for d in docs if d[0] is not None).items() for n, x in enumerate((t or "").split("\n")) if len(tokens(x)) >= 5)
    distinct = sorted({x for _, _, x in occurrences})
    raw, off = K.text_buffers(pa.array([" ".join(x) for x in distinct]))
    sims = lines.lines_of(raw, off, 1)[3]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for j in range(i + 1, len(distinct)):
            if int(sims[i] ^ sims[j]).bit_count() <= 3:
                x, y = " ".join(a), " ".join(distinct[j])
                if distance(x, y) <= 0.2 * max(len(x), len(y)):
                    root[find(a)] = find(distinct[j])
    first = {}
    for i, n, x in occurrences:
        first.setdefault(find(x), (i, n))
    gone = {}
    for i, n, x in occurrences:
        if first[find(x)] != (i, n):
            gone.setdefault(i, []).append(n)
    for i, t in docs:
        if i is not None:
            want = gone.get(i, [])
            text = t if not want else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want)
            assert got[i] == (text, want)
    assert any(gone.values())
    assert lines.dedup_lines(df.where("false")).count() == 0


def test_line_dedup_reaches_the_edit_similarity(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 10)))
    common = [word() for _ in range(30)]
    texts = []
    for size in [5, 7, 10, 15, 25, 40, 80, 200] * 12:
        base = [rng.choice(common) if rng.random() < 0.4 else word() for _ in range(size)]
        texts.append(" ".join(base))
        for share in (0, 0.05, 0.1, 0.15):  # one changed word at least, up to about the stated similarity
            own = list(base)
            for i in rng.sample(range(size), max(1, int(share * size))):
                own[i] = word()
            texts.append(" ".join(own))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id for r in lines.dedup_lines(df, radius=None).collect() if r.removed_lines}
    pairs = spark.createDataFrame([(i, j, texts[i], texts[j]) for g in range(0, len(texts), 5) for i in range(g, g + 5) for j in range(i + 1, g + 5)], "i int, j int, x string, y string")
    near = [(r.i, r.j) for r in pairs.where("levenshtein(x, y) <= 0.2 * greatest(length(x), length(y)) + 1e-9").collect()]
    root = list(range(len(texts)))
    for i, j in near:
        a, b = sorted((root[i], root[j]))
        root = [a if x == b else x for x in root]
    want = {i for i, x in enumerate(root) if x != i}
    assert len(want) > 300 and got <= want  # bases are unrelated: only copies of one base are near
    assert len(got) >= 0.97 * len(want), (len(got), len(want))
    short = [i for i in want if len(texts[i].split()) <= 15]
    assert len(got & set(short)) >= 0.9 * len(short), (len(got & set(short)), len(short))


def test_equal_short_lines_go(spark):
    df = spark.createDataFrame([(1, "see also\n\nA  b c"), (2, "See  Also\n\nsee alsp\na b d"), (2, "See  Also\n\nsee alsp\na b d"), (3, "a b c\na b c\n"), (4, None), (None, "see also")], "doc_id long, text string")
    got = {(r.doc_id, r.text) for r in lines.dedup_lines(df, radius=None).collect()}
    assert got == {(1, "see also\n\nA  b c"), (2, "\nsee alsp\na b d"), (3, ""), (4, None), (None, "see also")}
    assert lines.dedup_lines(df.where("false"), radius=None).count() == 0


def test_only_lines_that_meet_have_marks(spark, monkeypatch):
    rng, marked, groups = random.Random(5), [], lines.similarity_groups
    line = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(150)) + " of some words"
    texts = [line() for _ in range(40)]
    texts.append(texts[0] + "s")
    monkeypatch.setattr(lines, "similarity_groups", lambda raw, marks, *rest: marked.append((marks.count(), raw.select("hub").union(raw.select("x")).distinct().count())) or groups(raw, marks, *rest))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert [r.doc_id for r in lines.dedup_lines(df, radius=None).collect() if r.removed_lines] == [40]
    [(marks, met)] = marked
    assert marks == met < len(texts)


def test_lines_that_no_hub_settles_are_compared_without_making_pairs(spark, monkeypatch):
    rng, made, verify = random.Random(4), [], lines.linked
    words, texts = [f"w{i}x" for i in range(12)], []
    for i in range(45):  # the words in any order: all keys and marks alike, most lines far apart
        own = rng.sample(words, 12)
        texts.append(" ".join(own))
        if i % 5 == 0:
            own[3], own[4] = own[4], own[3]
            texts.append(" ".join(own))
    n, df = len(texts), spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(lines, "linked", lambda pairs, *rest: made.append(pairs.count()) or verify(pairs, *rest))
    monkeypatch.setattr(lines, "HELD", 7, raising=False)
    got = {r.doc_id for r in lines.dedup_lines(df, radius=None).collect() if r.removed_lines}
    roots = list(range(n))
    for b in range(n):
        for a in range(b):
            if _distance(texts[a], texts[b]) <= 0.2 * max(len(texts[a]), len(texts[b])) + 1e-9:
                roots = [roots[a] if r == roots[b] else r for r in roots] if roots[a] < roots[b] else [roots[b] if r == roots[a] else r for r in roots]
    assert got == {i for i in range(n) if roots[i] != i} and len(got) >= 9
    assert sum(made) <= 3 * n, "only hubs are compared by pairs"


def test_trimmed_keeps_the_edit_distance(spark):
    pairs = [("", ""), ("abc", "abc"), ("aaa", "aa"), ("xaby", "xacby"), ("éa𝄞b", "éc𝄞b"), ("abab", "ab"), ("", "q"), ("one two three", "one too three")]
    df = spark.createDataFrame([(i, i, x, y) for i, (x, y) in enumerate(pairs)], "a long, b long, ta string, tb string")
    got = {r.a: r for r in lines.trimmed(df).selectExpr("*", "levenshtein(ta, tb) AS d").collect()}
    want = {r.a: r.d for r in df.selectExpr("a", "levenshtein(ta, tb) AS d").collect()}
    assert {i: r.d for i, r in got.items()} == want
    assert all(got[i].longer == max(map(len, p)) for i, p in enumerate(pairs))
    assert (got[7].ta, got[7].tb) == ("w", "o")


@pytest.mark.parametrize("count", [0, 1 << 30, 1 << 39, 1 << 60])
def test_block_keys_meet(spark, count):
    rng = random.Random(count)
    pairs = []
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for bit in rng.sample(range(64), rng.randint(0, lines.RADIUS)):
            y ^= 1 << bit
        pairs.append(tuple(v - (1 << 64) if v >> 63 else v for v in (x, y)))
    keys = lines.block_keys(lines.RADIUS, count)
    df = spark.createDataFrame(pairs, "a long, b long")
    both = df.selectExpr("a as sim", "b").selectExpr(f"{keys} as ka", "b as sim").selectExpr("ka", f"{keys} as kb")
    assert both.where("not arrays_overlap(ka, kb)").count() == 0
    assert both.selectExpr("size(ka) as n").first().n == (10 if not count else {1 << 30: 20, 1 << 39: 56, 1 << 60: 84}[count])


def _near_lines(rng, groups, size, words):
    """Lines of ``groups`` groups of ``size``, in which words of a chain are changed, misspelt, added and lost, and the first of each component of near lines."""
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
    texts = []
    for _ in range(groups):
        own = [word() for _ in range(words)]
        for _ in range(size):
            texts.append(" ".join(own))
            i = rng.randrange(len(own))
            own[i : i + 1] = rng.choice([[word()], [own[i][1:] + "x"], [own[i], word()], [own[i], "y" + own[i]] if len(own) <= words else []])
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b - b % size, b):
            if root[a] != root[b] and _distance(texts[a], texts[b]) <= 0.2 * max(len(texts[a]), len(texts[b])) + 1e-9:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return texts, root


def test_lines_of_small_buckets_go_through_no_rounds(spark, monkeypatch):
    texts, root = _near_lines(random.Random(12), 12, 5, 14)
    df = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3])], "doc_id long, text string").repartition(3)
    want, crowds, groups = {i for i, r in enumerate(root) if r != i}, [], lines.similarity_groups
    monkeypatch.setattr(lines, "similarity_groups", lambda raw, marks, *rest: crowds.append((raw.select("key").distinct().count(), marks.count(), raw.select("hub").union(raw.select("x")).distinct().count())) or groups(raw, marks, *rest))
    found = lambda: {r.doc_id for r in lines.dedup_lines(df, radius=None).collect() if r.removed_lines}
    assert found() == want and len(want) >= 40
    assert crowds == [(0, 0, 0)]
    for most in (4, 1):  # buckets of more lines do: some, and all of them
        monkeypatch.setattr(lines, "CROWD", most)
        assert found() == want
        assert crowds[-1][0] > (crowds[-2][0] if most == 1 else 0) and crowds[-1][1] == crowds[-1][2] > 0


def test_pairs_of_buckets_are_those_that_pass_the_marks_once():
    texts, _ = _near_lines(random.Random(13), 20, 6, 12)
    texts = list(dict.fromkeys(texts))
    raw = "".join(texts).encode()
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    w = K.words(np.frombuffer(raw, np.uint8), off)
    own = K.signed(lines.signs(np.frombuffer(raw, np.uint8), w, w.first[:-1], w.first[1:], True))
    assert own[:, -1].tolist() == [len(t) for t in texts]
    assert (lines.signs(np.frombuffer(raw, np.uint8), w, w.first[:-1], w.first[1:])[:, : lines.BANDS] == own[:, : lines.BANDS].view(np.uint64)).all()
    keys, marks, sim = own[:, : lines.BANDS], own[:, lines.BANDS :], K.simhash_spans(w.hash, w.first[:-1], w.first[1:])
    entries = sorted((int(k), i) for i in range(len(texts)) for k in keys[i])
    x, y = lines._bucket_pairs(*(np.array(c) for c in zip(*entries, strict=True)), keys, sim, marks, 0.8)
    want = set()
    for b in range(len(texts)):
        for a in range(b):
            apart = sum((int(marks[a, c]) >> 4 * i & 15) != (int(marks[b, c]) >> 4 * i & 15) for c in range(len(lines.MARKS) - 1) for i in range(lines.NIBBLES))
            near = min(len(texts[a]), len(texts[b])) >= 0.8 * max(len(texts[a]), len(texts[b])) - 2
            if (keys[a] == keys[b]).any() and near and bin(int(sim[a] ^ sim[b])).count("1") <= lines.REACH and apart <= lines.APART:
                want.add((a, b))
    assert sorted(zip(x.tolist(), y.tolist(), strict=True)) == sorted(want) and len(want) > 100


def test_a_walk_along_the_words_takes_no_pair_that_is_not_near():
    rng = random.Random(14)
    for _ in range(600):
        u, v = ([rng.choice(["a", "ab", "b", "bab", "abba"]) for _ in range(rng.randint(0, 9))] for _ in range(2))
        d = _distance(" ".join(u), " ".join(v))
        assert d == 0 or not lines.walked(u, v, d - 1)
    line = "one two three four five six seven eight nine ten".split()
    for other, cost in ((line, 0), ([*line[:3], "fear", *line[4:]], 2), (line[:3] + line[4:], 5), ([*line, "more"], 5), (["new", *line], 4), (line[2:], 8)):
        assert lines.walked(line, other, cost) and lines.walked(other, line, cost) and (cost == 0 or not lines.walked(line, other, cost - 1))


def test_packed_stars_are_those_of_the_buckets(spark, monkeypatch):
    monkeypatch.setattr("tidemark.llm.graph.PACKED", 7)  # a bucket lies in several packed rows
    rng, keys = random.Random(8), [random.Random(i).getrandbits(63) - (1 << 62) for i in range(300)]
    rows = [(node, rng.sample(keys[:3] if node % 5 == 0 else keys, 2)) for node in range(-60, 60)]
    rows += [*rows[:9], (500, None), (501, [])]
    want = {}
    for node, some in rows:
        for key in some or ():
            want.setdefault(key, set()).add(node)
    want = {key: nodes for key, nodes in want.items() if len(nodes) > 1}
    got, place = {}, {}
    for r in packed_stars(spark.createDataFrame(rows, "node long, keys array<long>").repartition(3)).collect():
        got.setdefault(r.key, []).append((r.hub, r.x))
        assert r.alone == (len(want[r.key]) == 2)
        place.setdefault(r.key, r.hub)
    assert {key: sorted([hub for hub, _ in some][:1] + [x for _, x in some]) for key, some in got.items()} == {key: sorted(nodes) for key, nodes in want.items()}
    assert all(hub == place[key] for key, some in got.items() for hub, _ in some)
    order = {node: int(K.mix(np.array([node]).view(np.uint64))[0]) for nodes in want.values() for node in nodes}
    assert all(place[key] == min(nodes, key=order.get) for key, nodes in want.items())
    assert packed_stars(spark.createDataFrame(rows[-2:], "node long, keys array<long>")).count() == 0


def test_the_same_node_twice_makes_no_bucket(spark):
    rows = spark.createDataFrame([(1, [10, 11]), (1, [10, 11]), (2, [11, 12])], "node long, keys array<long>").repartition(2)
    assert sorted(map(tuple, packed_buckets(rows).collect())) == [(11, 1, 2), (11, 2, 2)]


def test_components_and_release(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(40)] + [(500, 400 + i) for i in range(60)] + [(7000 + rng.randint(0, 80), 7000 + rng.randint(0, 80)) for _ in range(50)] + [(9000, 9000), (9001, None)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    out = components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted((r.node, r.root) for r in out.collect()) == sorted((x, find(x)) for x in root)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    folder = out.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    release(out, spark.range(1))
    assert not os.path.exists(folder)


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("few", [True, False])
def test_links_put_into_components_give_those_of_all(spark, monkeypatch, few):
    from tidemark.llm import graph

    if not few:
        monkeypatch.setattr(graph, "broadcast_if_small", lambda df: df)
    rng = random.Random(9)
    old = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(120)]
    more = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(60)] + [(1000, 1001), (1001, 1002)]
    frame = lambda rows: spark.createDataFrame([tuple(sorted(r)) for r in rows], "a long, b long")
    comp = components(frame(old))
    out, moved = graph.merged(comp, frame(more))
    want = {tuple(r) for r in components(frame(old + more)).collect()}
    assert sorted(map(tuple, out.collect())) == sorted(want)
    before = dict(map(tuple, comp.collect()))
    assert {(before.get(n, n), r) for n, r in want if before.get(n, n) != r} == {tuple(r) for r in moved.collect()}


def test_few_links_are_joined_without_rounds(spark, monkeypatch):
    from tidemark.llm import graph

    names, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name="cut": names.append(name) or cut(df, name))
    rng = random.Random(10)
    old = [(i, i + 1) for i in range(50)] + [(900, 800 + i) for i in range(40)] + [(rng.randint(-300, 700), rng.randint(-300, 700)) for _ in range(150)] + [(-2, -2)]
    more = [(rng.randint(-400, 1000), rng.randint(-400, 1000)) for _ in range(60)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")

    def found():
        comp = components(frame([*old, *old[:9], (5, None)]).repartition(3))
        return [sorted(map(tuple, x.collect())) for x in (comp, *graph.merged(comp, frame(more).repartition(3)), *graph.merged(comp, frame([])), *graph.merged(components(frame([])), frame(more)))]

    at_once = found()
    assert "star" not in names and "joined" in names
    monkeypatch.setattr(graph, "AT_ONCE", 0)
    assert found() == at_once and "star" in names


def test_texts_are_read_once_for_all_rounds(spark, monkeypatch):
    names, cut = [], lines.cut
    monkeypatch.setattr(lines, "cut", lambda df, name="cut": names.append(name) or cut(df, name))
    base = [f"{x}{i}" for i, x in enumerate("amber birch cedar dune ember fjord grove heron inlet jetty kelp larch".split())]
    rows = [(i, " ".join(w if (i * 5 + j) % 17 else f"{w}{i}" for j, w in enumerate(base))) for i in range(40)]
    docs = spark.createDataFrame(rows + rows[:3], "id long, text string")
    assert lines.removals(docs, radius=None).count() > 0
    assert names.count("texts") == 1 and names.count("links") > 0


def test_edit_distances_of_many_pairs_at_once():
    rnd = random.Random(9)
    texts = []
    for n in (0, 1, 5, 63, 64, 65, 127, 128, 129, 200, 300) * 4:
        x = "".join(rnd.choice("ab cdeé\U0001f600" if n % 2 else "xy ") for _ in range(n))
        y = list(x)
        for _ in range(rnd.choice((0, 1, 3, n // 4, n))):
            at = rnd.randrange(len(y) + 1)
            y[at : at + rnd.choice((0, 1, 2))] = rnd.choice(("", "q", "ab"))
        texts.append((x, "".join(y)))
    code = lambda s: np.array([ord(c) for c in s], np.uint32)
    got = K.edit_distances([code(x) for x, _ in texts], [code(y) for _, y in texts])
    assert got.tolist() == [_distance(x, y) for x, y in texts]
    assert K.edit_distances([], []).tolist() == []


def test_edit_distances_within_a_bound():
    rng, left, right, most, true = random.Random(6), [], [], [], []
    for n in (1, 5, 64, 65, 128, 129, 200) * 6:
        a = [rng.randrange(97, 101) for _ in range(n)]
        b = a[:]
        for _ in range(rng.randrange(n // 4 + 2)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(2)] = [rng.randrange(97, 101)] * rng.randrange(2)
        d = _distance("".join(map(chr, a)), "".join(map(chr, b)))
        for k in {0, max(d - 1, 0), d, d + 1, n // 5}:
            left.append(np.array(a, np.uint32)), right.append(np.array(b, np.uint32)), most.append(k), true.append(d)
    true, bound = np.array(true), np.array(most)
    for got in (K.edit_distances(left, right, most), np.concatenate([K.edit_distances([x], [y], [k]) for x, y, k in zip(left, right, most, strict=True)])):
        assert (got[true <= bound] == true[true <= bound]).all() and (got > bound)[true > bound].all()


def test_linked_pairs_are_those_of_the_edit_similarity(spark):
    rnd = random.Random(3)
    line = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) for _ in range(rnd.randint(5, 60)))
    rows = []
    for i in range(300):
        x = line()
        y = list(x)
        for _ in range(int(len(x) * rnd.uniform(0, 0.35))):
            y[rnd.randrange(len(y))] = rnd.choice("abcdefgh ")
        rows.append((i, 1000 + i, x, "".join(y)))
    df = spark.createDataFrame(rows, "a long, b long, ta string, tb string")
    want = {r.a for r in df.where("levenshtein(ta, tb) <= floor(0.2 * greatest(length(ta), length(tb)) + 1e-9)").select("a").collect()}
    assert 50 < len(want) < 250
    assert {r.a for r in lines.linked(df, 0.8).collect()} == want
    long = df.selectExpr("a", "b", "repeat(concat(ta, ' '), 40) AS ta", "repeat(concat(tb, ' '), 40) AS tb").where(f"length(ta) >= {lines.WORDY}").limit(40)
    want = {r.a for r in long.where("levenshtein(ta, tb) <= floor(0.2 * greatest(length(ta), length(tb)) + 1e-9)").select("a").collect()}
    assert 0 < len(want) < 40 and {r.a for r in lines.linked(long, 0.8).collect()} == want


def test_word_distance_is_no_less_than_the_edit_distance():
    rng = random.Random(8)
    for _ in range(300):
        u = [str(rng.randint(0, 30)) for _ in range(rng.randint(0, 15))]
        v = [x for x in u if rng.random() > 0.1] + [rng.choice(["q", "zz"])] * rng.randint(0, 1)
        assert lines.word_distance(u, v) >= _distance(" ".join(u), " ".join(v))
    assert lines.word_distance(["a", "b", "c"], ["a", "c"]) == 2


def test_line_recall_against_edit_similarity_alone(spark):
    """Pairs of a line and a changed one, each alone in its group: the truth is the edit similarity, no fingerprint takes part."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    found, near = {}, {}
    rows, of = [], {}
    for low, high in ((5, 10), (10, 20), (20, 40), (40, 80)):
        for _ in range(150):
            line = [word() for _ in range(rng.randint(low, high))]
            other = list(line)
            for _ in range(rng.randint(1, max(1, len(line) // 8))):
                k, how = rng.randrange(len(other)), rng.random()
                if how < 0.5:
                    other[k] = word()
                elif how < 0.7:
                    other.insert(k, word())
                elif how < 0.9:
                    del other[k]
                else:
                    other[k] += "x"
            a, b = " ".join(line), " ".join(other)
            if a != b and len(other) >= 5 and _distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9:
                of[len(rows) + 1] = low
                near[low] = near.get(low, 0) + 1
                rows += [(len(rows), a), (len(rows) + 1, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for r in lines.dedup_lines(df).collect():
        if r.removed_lines:
            assert r.doc_id % 2 == 1  # the first of a pair stays, and unrelated lines don't link
            found[of[r.doc_id]] = found.get(of[r.doc_id], 0) + 1
    assert {low: round(found.get(low, 0) / n, 2) for low, n in near.items() if found.get(low, 0) < 0.9 * n} == {}


def test_repeated_ids_and_clashing_columns(spark):
    line = "one line of seven different words here"
    rows = [(1, "only\nshort", 1, "x"), (1, f"{line}\nand some other words stand on this line", 2, "y"), (2, line, 3, "z"), (2, line, 4, "z"), (None, line, 5, "n"), (3, "é É Z\né É z\nÉ É Z", 6, "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id long, __lost string")
    got = {r["__id"]: (r.text, list(r.removed_lines)) for r in lines.dedup_lines(df).collect()}
    assert got[1] == ("only\nshort", []) and got[2] == (rows[1][1], []) and got[5] == (line, [])
    assert got[3] == got[4] == ("", [0])
    assert got[6] == ("é É Z\nÉ É Z", [1])  # A-Z alone are lowered
