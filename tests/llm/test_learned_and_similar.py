import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import minhash, topk, toxicity
from threadloom.llm.common import Scratch
from threadloom.llm.graph import components

from .fixtures import DDL, sentence, table, texts


def _bag(text):
    w = minhash.normal(text).split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def _jaccard(a, b):
    same = sum((a & b).values())
    return same / (a.total() + b.total() - same) if a and b else 0.0


def _classes(given, least=0.8):
    reps = {}
    for i, t in sorted((x for x in given if x[0] is not None), key=lambda x: x[0]):
        reps.setdefault(minhash.normal(t), i)
    ids, parent = sorted(set(reps.values())), {}
    bags = {i: _bag(t) for t, i in ((t, i) for t, i in reps.items()) for t in [t.decode()]}
    find = lambda x: x if parent.get(x, x) == x else find(parent[x])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if _jaccard(bags[a], bags[b]) >= least:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {(i, t): find(reps[minhash.normal(t)]) for i, t in given}


def test_bags_count_shingles():
    some = ["a b c d e f a b c d e", "one two", "", "x x x x x x x"]
    doc, sh, n = minhash.bags([minhash.normal(t) for t in some])
    for i, t in enumerate(some):
        assert sorted(n[doc == i].tolist()) == sorted(_bag(t).values())
        assert len(set(sh[doc == i].tolist())) == len(_bag(t))


def test_signatures_are_unbiased():
    rng = np.random.default_rng(5)
    pairs, want = [], []
    for _ in range(150):
        keys = rng.integers(0, 1 << 60, 60).astype(np.uint64)
        a, b = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
        pairs += [(keys, a), (keys, b)]
        want.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    doc = np.concatenate([np.full((a > 0).sum(), i) for i, (_, a) in enumerate(pairs)])
    sig = minhash.signatures(len(pairs), doc, np.concatenate([k[a > 0] for k, a in pairs]), np.concatenate([a[a > 0] for _, a in pairs]), 128)
    got = np.array([(sig[i] == sig[i + 1]).mean() for i in range(0, len(pairs), 2)])
    assert abs((got - np.array(want)).mean()) < 0.012


@pytest.mark.parametrize("stars,block,columns", [(True, 256, 2048), (True, 2, 16), (False, 4, 2048), (False, 8, 5)])
def test_near_duplicates(spark, monkeypatch, stars, block, columns):
    for name, v in (("BLOCK", block), ("COLUMNS", columns)):
        monkeypatch.setattr(minhash, name, v)
    if not stars:  # all links but those of buckets of two come from the comparison in blocks
        two = minhash._stars
        monkeypatch.setattr(minhash, "_stars", lambda cand, scratch: two(cand.where("n = 2"), scratch))
    rng = random.Random(3)
    base = sentence(rng, 120).split()
    given = []
    for i in range(25):  # copies with more and more changes
        w = list(base)
        for k in range(i // 5):
            w[(i * 17 + 31 * k) % 120] = f"new{i}{k}"
        given.append((500 + i, " ".join(w)))
    given += texts()
    rows = [("x", i, t, "", 0, 0, "", 0, "") for i, t in given]
    want = _classes(given)
    sizes = Counter(want[g] for g in given)
    for r in minhash.near_duplicates(table(spark, rows)).join(spark.createDataFrame(given, "doc_id long, text string").distinct(), "doc_id").collect():
        assert r.class_id == want[(r.doc_id, r.text or "")]
        assert r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id)
    assert minhash.near_duplicates(spark.createDataFrame([], DDL)).count() == 0


@pytest.mark.parametrize("fits", [True, False])
def test_bags_meet_their_blocks_without_a_shuffle_where_these_are_few(spark, monkeypatch, fits):
    told, two, broadcast = [], minhash._stars, minhash.maybe_broadcast
    monkeypatch.setattr(minhash, "_stars", lambda cand, scratch: two(cand.where("n = 2"), scratch))
    monkeypatch.setattr(minhash, "maybe_broadcast", lambda df, n, row_bytes: told.append((df.columns, n)) or broadcast(df, n, row_bytes, None if fits else -1))
    base = sentence(random.Random(8), 120).split()
    given = [(500 + i, " ".join([*base[:i], "new", *base[i + 1 :]])) for i in range(6)] + [(600, None), (600, ""), (601, "same"), (601, "same"), (None, "same")]
    want = _classes([g for g in given if g[0] is not None])
    got = minhash.near_duplicates(spark.createDataFrame(given, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got if r.doc_id is not None) == sorted((i, want[(i, t or "")]) for i, t in ((i, t or "") for i, t in given if i is not None))
    assert [(r.class_id, r.class_size) for r in got if r.doc_id is None] == [(None, 1)]
    assert [n for columns, n in told if columns == ["node", "component", "block"]] == [6]


def test_similarities_are_those_of_each_pair(monkeypatch):
    monkeypatch.setattr(minhash, "COLUMNS", 7)
    rng = np.random.default_rng(6)
    bags = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (30, 5, 60, 1, 0, 40)]
    got = minhash.similarities(bags[:4], bags[2:])
    for i, a in enumerate(bags[:4]):
        for j, b in enumerate(bags[2:]):
            assert got[i, j] == pytest.approx(len(set(a) & set(b)) / max(1, len(set(a) | set(b))))
    assert minhash.similarities([], bags).shape == (0, 6)


def test_an_id_with_two_texts_is_two_documents(spark):
    a, b, c = (" ".join(f"{x}{i * i % 97}" for i in range(60)) for x in "abc")
    df = spark.createDataFrame([(3, a), (5, a), (5, b), (5, b), (9, b + " more"), (7, c)], "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.class_size, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == [(3, 3, 2, True), (5, 3, 2, False), (5, 5, 3, True), (5, 5, 3, True), (7, 7, 1, True), (9, 5, 3, False)]


def test_null_ids_are_classes_of_their_own(spark):
    rows = [("x", None, "a b c", "", 0, 0, "", 0, ""), ("x", None, "a b c", "", 0, 0, "", 0, ""), ("x", 4, "a b c", "", 0, 0, "", 0, "")]
    got = [(r.doc_id, r.class_id, r.class_size) for r in minhash.near_duplicates(table(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(None, None, 1), (None, None, 1), (4, 4, 1)], key=str)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150)] + [(300, 300 + i) for i in range(1, 30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert {got[i] for i in range(41)} == {0} and got[150] == got[200] == 100 and {got[300 + i] for i in range(30)} == {300}


def _topk(vectors, queries, k, not_self=True):
    ok = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in sorted(set(queries) & set(ok)):
        scores = sorted((-sum(a * b for a, b in zip(ok[q], v, strict=False)), i) for i, v in ok.items() if i != q or not not_self)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_exact_topk(spark, monkeypatch):
    for name, v in (("BLOCK", 16), ("RANGE", 64), ("PACK", 3)):
        monkeypatch.setattr(topk, name, v)
    rng = np.random.default_rng(2)
    vectors = [(i, (rng.normal(size=8) / 3).tolist()) for i in range(300)]
    vectors += [(1000 + i, vectors[7][1]) for i in range(12)]  # ties
    vectors += [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (2004, []), (2005, [0.5, -2.0]), (2006, [1e6] * 8)]
    df = spark.createDataFrame([(v, i, "x") for i, v in vectors], "embedding array<double>, vec_id long, `w` string")
    queries = df.where("vec_id % 50 = 0 OR vec_id = 2005")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.exact_topk(df, queries).collect())
    assert got == _topk(vectors, [i for i, _ in vectors if i % 50 == 0 or i == 2005], 5)
    assert topk.exact_topk(df.limit(0), queries.limit(0)).count() == 0
    assert topk.exact_topk(df.where("vec_id < 3"), df.where("vec_id = 0")).count() == 2


def test_weights_travel_in_few_bytes():
    for top, size in ((127, 1), (128, 2), (-129, 2), (32768, 4), (-(1 << 31), 4), (1 << 31, 8), (-(1 << 63), 8)):
        m = np.array([[top, -1, 0], [3, 2, 1]], np.int64)
        raw = topk._narrow(m).tobytes()
        assert len(raw) == 6 * size and np.array_equal(topk._wide(raw, 2, 3), m)
    assert topk._wide(topk._narrow(np.zeros((2, 0), np.int64)).tobytes(), 2, 0).shape == (2, 0)


def test_packs_and_blocks_meet_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(topk, "RANGE", 64)
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(400)], "vec_id long, embedding array<double>")
    got = topk.exact_topk(df, df.where("vec_id % 50 = 0"))
    assert len(got.collect()) == 40
    plan = got._jdf.queryExecution().executedPlan().toString()  # the one that ran
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert plan.split("Initial Plan")[0].count("hashpartitioning(part#") == 2 == plan.split("Initial Plan")[0].count(", 7), REPARTITION_BY_NUM")


def test_scores_beyond_64_bits_are_cut(spark):
    df = spark.createDataFrame([(0, [1e18, 1.0]), (1, [1e18, 2.0]), (2, [-1e18, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r["rank"], r.vec_id, r.score) for r in topk.exact_topk(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(1, 1, (1 << 63) - 1), (2, 3, 65536), (3, 2, -(1 << 63) + 1)]


def test_blocks_below_the_bound_are_not_scored():
    v = np.zeros((256 * 8, 4), np.int64)
    v[:, 0] = np.repeat(np.arange(8), 256) * 100
    scores, ids, done = topk._search(np.array([[1, 0, 0, 0]]), np.array([-5]), v, np.arange(len(v)), 5, True)
    assert done == 1 and ids[0].tolist() == list(range(256 * 7, 256 * 7 + 5)) and set(scores[0]) == {700}


def _labelled(n=900, seed=4):
    rng = random.Random(seed)
    bad = ["vile", "grobstück", "zarnak"]
    docs, labels = [], []
    for i in range(n):
        w = sentence(rng, rng.randrange(5, 80)).split()
        y = int(rng.random() < 0.2)
        for _ in range(y * rng.randrange(1, 4)):
            w.insert(rng.randrange(len(w)), rng.choice([bad[0], bad[1] + rng.choice("abcdef"), bad[2] + str(rng.randrange(99)) + ","]))
        docs.append((i, " ".join(w)))
        labels.append((i, y))
    return docs, labels


def test_toxicity_looks_up_tokens_by_piece(monkeypatch):
    """Each new token of a piece is weighed once, with the others; all get what their features add up to one by one."""
    monkeypatch.setattr(toxicity, "CACHE", 9)
    monkeypatch.setattr(toxicity, "PIECE", 7)
    f = toxicity.Field(weights=np.random.default_rng(4).normal(0, 1, toxicity.SLOTS).astype(np.float32), bias=np.float64(-3.25))
    texts = ["", " \t\n", "Don't don't, _x_ ... İb ﬁ 日本語日本語 éa abcd abcde abcdef abcdefg abcdefgh", "a\x1cb same same same same same same same same\nsame", "... ___"]
    plain = lambda t: float(f.weights[[zlib.crc32(x.encode()) % toxicity.SLOTS for x in toxicity.features(toxicity._EDGE.sub("", t.lower()))]].sum() + f.bias)
    learned, tagger = [], toxicity.Tagger(f)
    monkeypatch.setattr(tagger, "_learn", lambda new, learn=tagger._learn: learned.append(list(new)) or learn(new))
    tokens = [w for t in texts for w in t.split()]
    assert list(tagger._emissions(iter(tokens))) == [plain(t) for t in tokens]
    assert len(learned) == -(-len(tokens) // 7) and all(len(set(x)) == len(x) <= 7 for x in learned) and len(tagger.known) <= 9
    got = list(tagger.tag(texts))
    assert [ls for ls, _ in got] == [[x.split() for x in t.split("\n")] for t in texts]
    assert [len(p) for _, p in got] == [len(t.split()) for t in texts]


def test_toxicity(spark):
    docs, labels = _labelled()
    more = [(5000, None), (5001, ""), (5002, " \n "), (5003, "plain " * 20000), (5003, "plain words")]
    df = table(spark, [("x", i, t, "", 0, 0, "", 0, "") for i, t in docs + more])
    lab = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    f = toxicity.train(df, lab)
    got = toxicity.score(df, f).collect()
    assert len(got) == len(docs) + len(more) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth, texts_ = dict(labels), dict(docs)
    out = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.predicted == truth[r.doc_id] for r in out) >= 0.97 * len(out)
    for r in got:
        for s in r.spans if r.doc_id in texts_ else []:
            assert any(b in texts_[r.doc_id][s.start : s.end] for b in ("vile", "grobst", "zarnak"))
    assert all(not r.predicted for r in got if r.doc_id >= 5000)
    assert toxicity.score(df.limit(0), f).count() == 0
    assert toxicity.score(df, toxicity.train(df, lab.limit(0))).where("predicted = 1").count() == 0


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    trans = rng.normal(size=(2, 2))
    e = rng.normal(size=7)
    lengths = np.array([4, 3])
    got = toxicity.marginals(e, lengths, trans)
    at = 0
    for n in lengths:
        z, on = 0.0, np.zeros(n)
        for path in np.ndindex(*(2,) * n):
            w = np.exp(sum(e[at + i] * s for i, s in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:], strict=False)))
            z += w
            on += w * np.array(path)
        assert np.allclose(got[at : at + n], on / z)
        at += n
