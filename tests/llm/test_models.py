"""Classifiers by held-out accuracy; searches, pieces, personal data and chats against brute force."""

import hashlib
import random
import re
from functools import reduce

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, language, pieces, pii, quality, queries, topk, toxicity
from tidemark.llm.learn import held

SMALL = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    out = queries.op4_language_id(spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    rows = out.join(docs, "doc_id").where("held_out and lang is not null").collect()
    assert len(rows) > 100 and sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (None, "the of and"), (5, "x" * 100_000)], "doc_id long, text string")
    model = language.train(spark.read.parquet(f"{SMALL}/documents.parquet"))
    got = {r.id: (r.lang_pred, r.score, r.rejected) for r in language.identify(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0, True) and None in got and len(got) == 5
    assert language.keep_identified(odd, model).columns == odd.columns
    none = language.Model([], [])
    assert {r.lang_pred for r in language.identify(odd, none).collect()} == {"und"}


@pytest.mark.parametrize("module,query,label,mod,rest", [(toxicity, queries.op7_toxicity, "toxic", 4, 2), (quality, queries.op8_quality, "quality", 5, 0)])
def test_scores_held_out(spark, module, query, label, mod, rest):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = query(spark, SMALL).join(labels, "doc_id").collect()
    own = [r for r in rows if r.held_out]
    assert own and sum(r.predicted == r[label] for r in own) / len(own) > 0.85
    assert all(0 <= r.score <= 1 and (r.score >= 0.3) == bool(r.predicted) for r in rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "a"), (4, "word " * 20_000)], "doc_id long, text string")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = module.train(docs, labels, learn=held(F.col("doc_id"), mod) != rest)
    scores = {r.id: r.score for r in quality.score(odd, model).collect()}
    assert len(scores) == 4 and scores[1] == scores[2]
    assert {r.score for r in quality.score(odd, module.train(docs, labels.where("false"))).collect()} <= {0.0, 0.5}


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400, None), (401, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (500, rows[3][1]), (501, rows[3][1]), (600, [1.0, 2.0]), (700, []), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = topk.top_k(df, df.where("vec_id % 100 = 0"), 10).collect()
    good = {i: [int(np.floor(1024 * float(x))) for x in v] for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in good if i % 100 == 0):
        best = sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:10]
        want |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert topk.top_k(df.where("false"), df, 10).count() == 0 and topk.top_k(df, df.where("false"), 10).count() == 0


def test_top_k_refuses_what_it_cannot_add_exactly(spark):
    df = spark.createDataFrame([(i, [1e13, 1.0, float(i)]) for i in range(20)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="exact"):
        topk.top_k(df, df.where("vec_id = 0"), 3).collect()


def test_top_k_takes_queries_of_another_table(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(size=6).tolist()) for i in range(60)]
    queries = [(1000 + i, (5 + rng.normal(size=6)).tolist()) for i in range(20)] + vectors[:3] + [(3000, vectors[5][1]), (7, [9.0] * 6)]
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in topk.top_k(frame(vectors), frame(queries), 5).collect()}
    scaled = lambda v: [int(np.floor(1024 * x)) for x in v]
    want = set()
    for q, v in queries:
        best = sorted((-sum(a * b for a, b in zip(scaled(v), scaled(w), strict=True)), i) for i, w in vectors if i != q)[:5]
        want |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    assert got == want and len(got) == 5 * len(queries)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary()


def _encode(v, *texts):
    return v.encode(pa.array(texts, pa.string())).to_pylist()


def test_no_chunk_size_changes_an_id(vocabulary):
    v, rng = vocabulary, random.Random(4)
    for text in ("Hello wide world " * 20, "abc" * 300, "a" * 200, "日本語" * 99, " " * 200, "x\n" * 150, "".join(rng.choice("ab é\n") for _ in range(700)), "".join(rng.choice("aab") for _ in range(300))):
        own = v.prepare(text)
        whole, best = v.word(own)  # one lattice of the whole text
        whole = np.frombuffer(whole, "<i4").tolist()
        assert _encode(v, text) == [whole]
        for chunk in (16, 17, 40, 333):
            parts = [(own[c : c + chunk + v.longest - 1], min(chunk, len(own) - c)) for c in range(0, len(own), chunk)]
            own_parts = [v.matrix(t, n) for t, n in parts]
            matrices = [x[0] for x in own_parts]
            ways = pieces.states(matrices, [x[1] for x in own_parts])
            ids = np.frombuffer(b"".join(v.trace(rest, lo, middle, n, hi, *way) for (_, n), (_, _, rest, lo, hi, middle), way in zip(parts, own_parts, ways, strict=True)), "<i4").tolist()
            assert reduce(pieces.plus, matrices)[0, 0] == best
            assert ids == whole


def test_batches_match_single_lattices(vocabulary):
    v, rng = vocabulary, random.Random(5)
    texts = ["".join(rng.choice(["the", "Wort", " ", "  ", "\n", ",", "é", "▁", "7", "🙂", ".com", "x_y"]) for _ in range(rng.randint(0, 60))) for _ in range(200)] + [None, ""]
    want = [None if t is None else np.frombuffer(v.word(v.prepare(t))[0], "<i4").tolist() for t in texts]
    assert _encode(v, *texts) == want
    ids = pa.array([*want, [99999, 5], [None, 0], list(range(3, 259)), [v.byte[0xC3]]], pa.list_(pa.int32()))
    back = v.decode(ids).to_pylist()
    assert back[: len(texts)] == [t if t is None else t.replace("▁", " ") for t in texts]
    assert back[-1] == "\ufffd" and v.decode(ids.slice(3, 4)).to_pylist() == back[3:7]


def test_words_match_the_library(vocabulary):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(open(pieces.MODEL, "rb").read())
    model.trainer_spec.model_type = 1  # a unigram model of the same pieces
    for p in model.pieces:
        if p.piece in vocabulary.piece:
            p.score = vocabulary.piece[p.piece][1]
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    words = [w for w in open(__file__).read().split() if w.isascii()]
    same = [ids == library.encode(w) for w, ids in zip(words, _encode(vocabulary, *words), strict=True)]
    assert sum(same) / len(same) > 0.98  # the library adds in single precision


def test_round_trip(spark):
    texts = [None, "", " ", "  a  b ", "日本語 \n\n", "é \U0001f600", "x" * 3000, "one two " * 900, "one two " * 900]
    df = spark.createDataFrame([(i, t, "k", i) for i, t in enumerate(texts)], "doc_id long, text string, row string, __row int")
    rows = pieces.decode(pieces.encode(df, chunk=500)).collect()
    assert len(rows) == len(texts) and all(r.decoded == r.text and (r.tokens is None) == (r.text is None) and r.row == "k" and r["__row"] == r.doc_id for r in rows)
    once = pieces.encode(df, chunk=500, decoded_col="__row").collect()
    assert {(r.doc_id, r["__row"], len(r.tokens or [])) for r in once} == {(r.doc_id, r.text, len(r.tokens or [])) for r in rows}
    assert {r.doc_id: r.tokens for r in rows} == {r.doc_id: r.tokens for r in pieces.encode(df).collect()}
    assert pieces.encode(df.where("false")).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else 2 * int(c) // 10 + 2 * int(c) % 10 for i, c in enumerate(d[::-1])) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def test_personal_data(spark):
    rng = random.Random(1)
    texts = [None, "", "a@b", "a@b.c_d@e.f x", "a@b.c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.4", "é😀 x@y.com 4539 1488 0343 6467 +1 (555) 123-4567", "+1 + +12 345 678 901 23 -", "4539-1488-0343-6467-4539", "9" * 5000, "a" * 20000, "@" * 500, "1 " * 2000, "..@..", "a@b..c a@b.c.", "+1234567890123456 +123456789"]
    for i in range(60):  # 50 valid cards and 10 with a wrong check digit, in the same context
        n = "".join(rng.choice("0123456789") for _ in range(15))
        good = next(n + c for c in "0123456789" if luhn(n + c))
        texts.append(f"my card number {good if i < 50 else n + str((int(good[-1]) + 1) % 10)} is here")
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, key long")
    got = {r.doc_id: r for r in pii.digest(pii.extract(df)).collect()}
    for i, t in enumerate(texts):
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, t or "") if valid(k, m[0])]
        assert got[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert got[i].spans.startswith(",".join(spans))
        assert sum(got[i][f"n_{k}"] for k in PATTERNS) == len(spans)
    found = [i for i, r in got.items() if "ctx_card" in r.spans]
    assert found == list(range(len(texts) - 10, len(texts)))
    assert got[found[0]].spans == "ctx_card:15:31"
    assert pii.extract(df.where("false")).count() == 0


def _bootstrapped(texts, confidence=pii.CONFIDENCE, support=pii.SUPPORT, rounds=pii.ROUNDS):
    """The discovered spans of ASCII texts, found without Spark."""
    occur = []
    for i, t in enumerate(texts):
        base = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, t) if valid(k, m[0])]
        hits = list(re.finditer(pii.TOKEN, t))
        for n, m in enumerate(hits):
            before, after = t[hits[n - 1].end() if n else 0 : m.start()], t[m.end() : hits[n + 1].start() if n + 1 < len(hits) else len(t)]
            kind = next((k for k in PATTERNS for b in base if b[0] == k and b[1] < m.end() and b[2] > m.start()), None)
            lead = len(re.match(r"[^0-9A-Za-z+(]*", m[0])[0])
            core = re.match(r"[^0-9A-Za-z+(]*+(.*?)[^0-9A-Za-z]*$", m[0], re.S)
            core = core[1] if core else ""
            group = lambda p, x: (lambda g: re.sub(r"\s+", " ", g[1]).lower() if g else "")(re.search(p, x))
            left, right = group(r"(?<!\S)(\S++\s++\S++)\s++$", before), group(r"^\s++(\S++\s++\S++)", after)
            beside, behind, key = group(r"(?<!\S)(\S++)\s++$", before), group(r"^\s++(\S++)", after), group(r"^([^0-9@=:]{2,40}[=:])", m[0])
            patterns = [f"before {left}" if left else None, f"after {right}" if right else None, f"around {beside} _ {behind}" if beside and behind else None, f"key {key}" if key else None]
            if core:
                occur += [(i, m.start() + lead, m.start() + lead + len(core), core, kind, p) for p in patterns if p]
    kinds, edges = {}, {}
    for *_, core, kind, p in occur:
        edges.setdefault(p, {}).setdefault(core, set()).add(kind)
    edges = {p: {c: max((k for k in ks if k), default=None) for c, ks in own.items()} for p, own in edges.items()}
    for own in edges.values():
        for c, k in own.items():
            if k:
                kinds.setdefault(c, {})[k] = 1.0
    seeds, sure, scored = dict(kinds), dict(kinds), {}
    for _ in range(rounds):
        scored = {}
        for p, own in edges.items():
            for k in PATTERNS:
                known = [sure[c][k] for c in own if k in sure.get(c, {})]
                if sum(x >= confidence for x in known) >= support and sum(known) / len(own) >= confidence:
                    scored[p, k] = sum(known) / len(own)
        sure = dict(seeds)
        for c in {c for own in edges.values() for c in own} - set(seeds):
            for k in PATTERNS:
                left = [1.0000001 - scored[p, k] for p, own in edges.items() if c in own and own[c] is None and (p, k) in scored]
                if left:
                    sure.setdefault(c, {})[k] = 1 - float(np.prod(left))
    best = {}
    for (p, k), score in scored.items():
        best[p] = max(best.get(p, (0, "")), (score, k))
    out = {}
    for i, s, e, _, kind, p in occur:
        if kind is None and p in best:
            out[i, s, e] = max(out.get((i, s, e), (0, "")), best[p])
    return {(i, k, s, e) for (i, s, e), (_, k) in out.items()}


def test_bootstrapping_matches_brute_force(spark):
    rng = random.Random(3)
    name = lambda n=6: "".join(rng.choice("abcdefgh") for _ in range(n))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts = [f"you can write to {name()}@{name()}.org or call us today" for _ in range(30)]  # seeds without a digit
    texts += [f"you can write to {name()}(at){name()}{digits(1)}.org or call us today" for _ in range(6)]  # found in round one by either side
    texts += [f"please reach me under {x} at any time" for t in texts[30:36] for x in [t.split()[4]]]  # these back a pattern of their own
    texts += ["please reach me under nobody@home7 at any time"]  # found in round two only
    texts += [f"the card on file {digits(4)} {digits(4)} {digits(4)} {digits(4)} has expired now" for _ in range(3)]
    seed = lambda: next(n + c for n in [digits(15)] for c in "0123456789" if luhn(n + c))
    texts += [f"the card on file {' '.join(n[j : j + 4] for j in range(0, 16, 4))} has expired now" for n in (seed() for _ in range(20))]
    texts += [f"in {rng.randint(1900, 2020)} there were {rng.randint(1, 99)} people in the town of {name()}" for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.id, m["kind"], m["s"], m["e"]) for r in pii.extract(df).collect() for m in r.more}
    want = _bootstrapped(texts)
    assert got == want
    assert {i for i, *_ in want} >= {*range(30, 36), 42} and any(k == "card" and e - s == 19 for _, k, s, e in want)
    assert not {i for i, *_ in want} & set(range(len(texts) - 60, len(texts)))


def test_many_matches_and_repeated_rows(spark):
    long = " ".join(f"{i}.1.2.3" for i in range(256)) + " " + "word " * 3000
    rows = [(1, long, "x"), (1, long, "x"), (None, "7.7.7.7", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, cand string")
    out = pii.extract(df).collect()
    assert len(out) == 3 and [len(r.ip) for r in sorted(out, key=lambda r: len(r.ip))] == [1, 256, 256]
    spans = [(m.start(), m.end()) for m in re.finditer(PATTERNS["ip"], long)]
    assert [(x.s, x.e) for x in next(r.ip for r in out if r.id == 1)] == spans


def test_chats_collapse(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "ho"), (2, 0, "user", "hi"), (2, 1, "assistant", "ho"), (2, 2, "user", "<|im_end|>"), (3, 0, "user", "hi"), (3, 1, "assistant", "no"), (4, 0, "user", "hi"), (4, 1, "assistant", "no"), (5, None, None, None), (6, 0, "user", "hi"), (None, 0, "user", "x"), (3, 0, "user", "hi")]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, pos int")
    rows = {r.conv_id: (r.n_turns, r.n_same, r.rendered) for r in chat.collapse(df).collect()}
    assert set(rows) == {2, 3, 5} and rows[3][:2] == (2, 2) and rows[5][2] == "<|im_start|>\n<|im_end|>\n"
    assert rows[2][2].endswith("<|im_start|>user\n< |im_end|><|im_end|>\n")
    assert chat.collapse(df.where("false")).count() == 0
