import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from threadloom.llm import align, common, lexical, mixing

from .fixtures import DDL, rows, sentence, sorted_rows, table, texts

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = ["a  b", " lead", "trail ", "tab\tx", "a\r\nb", "a\nb c\nd", "mark ▁ here", "<|endoftext|> <s> </s>", "naïve ﬁ ① 😀 日本", "x　y", "n\x00ul", "a \nb", "\n", "don't 12 345", "same word same word"]


def _tokens(text):
    """(bytes, id) of both sides, by the libraries on the whole text."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    if not _tokens.__dict__:
        _tokens.a, _tokens.b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
        _tokens.a.encode_special_tokens = True
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        _tokens.back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    a = [(bytes(_tokens.back[c] for c in _tokens.a.id_to_token(i)), i) for i in _tokens.a.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in _tokens.b.encode(text):
        p = _tokens.b.id_to_piece(i)
        b.append((bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode(), i))
    return a, b


def _aligned(docs):
    linked, per, groups = Counter(), [], []
    for _, text in docs:
        a, b = _tokens(text) if text else ([], [])
        want = (" " + text).encode()
        if not text or b"".join(x for x, _ in a) != want or b"".join(x for x, _ in b) != want:
            per.append((0, 0, 0, []))
            groups.append("")
            continue
        spans = []
        for side in (a, b):
            at, out = 0, []
            for x, i in side:
                out.append((at, at + len(x), i))
                at += len(x)
            spans.append(out)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        ends = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        parts = [";".join("|".join(",".join(str(t[2]) for t in side if s < t[1] <= e) for side in spans) for s, e in zip([0, *ends], ends, strict=False))]
        per.append((len(a), len(b), len(ends), links))
        groups.append(hashlib.sha256(parts[0].encode()).hexdigest())
        linked.update(links)
    most = defaultdict(int)
    for (_, j), n in linked.items():
        most[j] = max(most[j], n)
    return [(i, na, nb, n, len(links), sum(linked[p] == most[p[1]] for p in links), sum(linked[p] for p in links), g) for (i, _), (na, nb, n, links), g in zip(docs, per, groups, strict=True)]


COLS = "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"


@pytest.mark.parametrize("size", [common.BROADCAST_BYTES, -1])
def test_alignment_against_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(common, "BROADCAST_BYTES", size)
    given = [r for r in rows() if len(r[2] or "") < 3000] + [("x", 900 + i, t, "d", 1, 2, "s", 1, "en") for i, t in enumerate(ODD)]
    got = sorted_rows(align.align_tokens(table(spark, given), A, B), *COLS)
    assert got == sorted(_aligned(texts(given)), key=str)


def test_alignment_of_very_long_text_and_empty_table(spark):
    given = [("x", 1, "word " * 50_000 + "end", "d", 1, 2, "s", 1, "en"), ("x", 2, "w" * 20_000, "d", 1, 2, "s", 1, "en"), ("x", None, "a", "d", 1, 2, "s", 1, "en")]
    got = {r.doc_id: r for r in align.align_tokens(table(spark, given), A, B, full=True).collect()}
    assert got[1].n_a == len(_tokens(given[0][2])[0]) and got[1].n_groups == got[1].groups.count(";") + 1
    assert got[2].n_b == len(_tokens(given[1][2])[1]) and got[None].n_links == 1
    assert not align.align_tokens(table(spark, []), A, B).collect()


def test_labels_and_links():
    marks = align.labels(np.array([1, 2, 3]), np.array([2, 1, 1, 2]))
    assert marks.tolist() == [1, 2, 3, 2, 0, 3]
    assert align.spans(marks) == [(2, 2), (1, 2)] and align.written(align.spans(marks), list("123"), list("4567")) == ["1,2|4,5", "3|6,7"]
    assert [(x >> 32, x & 0xFFFFFFFF) for x in align.links(marks, np.array([1, 2, 3]), np.array([4, 5, 6, 7])).tolist()] == [(1, 4), (2, 4), (2, 5), (3, 6), (3, 7)]


def _mix(docs, block=16, shard=8192):
    """(id, size, source_size, target): by repeated sharing."""
    words = [(i, s, len(re.findall(mixing.WORD, t or ""))) for i, t, s in docs]
    size = Counter()
    for _, s, n in words:
        size[s] += n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full = set()
    while True:
        left, open_ = sum(size.values()) - 3 * sum(size[s] for s in full), sum(weight[s] for s in size if s not in full)
        target = {s: 3 * size[s] if s in full else left * weight[s] / open_ for s in size}
        above = {s for s in size if target[s] > 3 * size[s]}
        if not above:
            return words, size, target
        full |= above


def _docs(given):
    return [(r[1], r[2], r[6]) for r in given]


@pytest.mark.parametrize("block,shard", [(16, 8192), (1, 8192), (5, 7)])
def test_mix(spark, block, shard):
    rng = random.Random(3)
    more = [("x", 2000 + i, sentence(rng, rng.randrange(1, 40)), "d", 1, 2, f"m{i % 9}" if i > 60 else "hot", 1, "en") for i in range(150)]
    given = rows() + more
    got = mixing.mix(table(spark, given), block=block, shard=shard).collect()
    words, size, target = _mix(_docs(given))
    assert sorted((r.doc_id, r.size, r.source_size) for r in got) == sorted((i, n, size[s]) for i, s, n in words)
    taken = Counter()
    for r in got:
        assert math.isclose(r.target, target[r.source], rel_tol=1e-12)
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size + sum(x.end - x.first for x in r.extra)
        assert all(0 <= x.first < x.end <= r.size for x in r.extra)
        taken[r.source] += r.taken
    for s in size:
        shards = math.ceil(sum(x == s for _, x, _ in words) / shard)
        assert abs(taken[s] - target[s]) <= block * (1 + 3 * shards)
    again = mixing.mix(table(spark, given[::-1]).repartition(3), block=block, shard=shard)
    assert sorted_rows(again, "doc_id", "size", "taken", "source") == sorted(((r.doc_id, r.size, r.taken, r.source) for r in got), key=str)


def test_mix_of_little(spark):
    assert not mixing.mix(table(spark, [])).collect()
    empty = [("x", i, t, "d", 1, 2, s, 1, "en") for i, t, s in ((1, None, None), (2, "", "a"), (None, " \n", "a"))]
    assert [(r.size, r.target, r.taken) for r in mixing.mix(table(spark, empty)).collect()] == [(0, 0.0, 0)] * 3
    one = [("x", 1, "a b c " * 30, "d", 1, 2, None, 1, "en")]
    assert [(r.size, r.target, r.taken) for r in mixing.mix(table(spark, one)).collect()] == [(90, 90.0, 90)]


def test_highest_quotients(spark):
    rng = random.Random(5)
    parties = [(g, k, rng.choice([0.0, 1.0, 7.5, 100.0 * rng.random(), 3.0]), {0: 50, 1: 3, 2: 0, 3: 1000}[g]) for g in range(4) for k in range(17)]
    got = {(r.g, r.k): r.quota for r in mixing.apportion(spark.createDataFrame(parties, "g int, k int, v double, seats long"), "g", "k", "v", "seats", common.Scratch(spark, "test")).collect()}
    for g in range(4):
        some = [(k, v, s) for g_, k, v, s in parties if g_ == g]
        quotients = sorted((-v / (2 * n + 1), k, n) for k, v, s in some if v for n in range(s + 1))[: some[0][2]]
        want = Counter(k for _, k, _ in quotients)
        assert [got[g, k] for k, _, _ in some] == [want[k] for k, _, _ in some]


def test_mix_is_native(spark):
    plan = mixing.mix(table(spark))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def _ranked(docs, queries, k=10):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda t: [x for x in re.split(r"[\x00-\x2f:-@\[-`{-\x7f]+", (t or "").translate(low)) if x]
    bags = [(i, Counter(cut(t))) for i, t in docs]
    n_docs, length = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in queries:
        scored = []
        for i, b in bags:
            n, score = sum(b.values()), 0
            for t in cut(text):
                if b[t]:
                    m = 25 + 75 * n * n_docs // length
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize("size,k", [(common.BROADCAST_BYTES, 10), (common.BROADCAST_BYTES, 1), (-1, 3)])
def test_search_against_all_scores(spark, monkeypatch, size, k):
    monkeypatch.setattr(common, "BROADCAST_BYTES", size)
    rng = random.Random(9)
    given = rows() + [("x", None, "river1 stone2 only", "d", 1, 2, "s", 1, "en")]
    queries = [(i, sentence(rng, rng.randrange(1, 30))) for i in range(12)] + [(50, None), (51, "!!"), (52, "absent zzz"), (53, rows()[7][2]), (54, "THE the word same"), (55, "über ÜBER 日本")]
    items = spark.createDataFrame([*queries, (None, "the")], "item_id long, text string").withColumns({"TEXT2": common.F.lit(1)})
    got = sorted_rows(lexical.search(table(spark, given), items, k=k), "item_id", "rank", "doc_id", "score")
    assert got == sorted(_ranked(texts(given), queries, k), key=str)


def test_search_in_empty_tables(spark):
    items = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert not lexical.search(table(spark, []), items).collect() and not lexical.search(table(spark), items.limit(0)).collect()
    assert DDL
