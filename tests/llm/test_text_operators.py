import base64
import hashlib
import json
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from threadloom.llm import bpe, dac, exact, html, lines, packing, substrings

from .fixtures import DDL, rows, sorted_rows, table, texts

P = pytest.importorskip("public_tokenizers")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda b: hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


@pytest.mark.parametrize("bits,keep", [(256, "max"), (256, "min"), (8, "max")])
def test_exact_dedup(spark, bits, keep):
    groups = defaultdict(list)
    for i, t in texts():
        groups[t.translate(LOWER)].append(i)
    want = []
    for i, t in texts():
        g = groups[t.translate(LOWER)]
        k = max(g) if keep == "max" else min(g)
        want.append((i, k, len(g), i == k, sha(t.translate(LOWER))))
    got = sorted_rows(exact.exact_dedup(table(spark), digest_bits=bits, keep=keep), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == sorted(want, key=str)


def test_exact_dedup_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(exact, "BROADCAST_BYTES", -1)
    got = {r.doc_id: r.group_size for r in exact.exact_dedup(table(spark)).collect()}
    assert got[200] == 2 and got[307] == 2 and got[300] == 3 and got[5] == 1


def test_exact_dedup_is_native(spark):
    plan = exact.exact_dedup(table(spark))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def _tiktoken():
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f.read().splitlines() if x)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_round_trip(spark):
    enc = _tiktoken()
    df = bpe.encode_decode(table(spark), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, full=True)
    want = []
    for i, t in texts():
        ids = enc.encode_ordinary(t)
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(t)))
    got = df.collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got), key=str) == sorted(want, key=str)
    by_id = dict(texts())
    for r in got:
        t = by_id[r.doc_id]
        assert bytes(r.decoded) == t.encode() and all(0 <= a <= b <= len(t) for a, b in zip(r.starts, r.ends, strict=True))
        if t:
            assert r.starts[0] == 0 and r.ends[-1] == len(t)


@pytest.mark.parametrize("text", ["", " ", "a  b", "it's don't", " x\n\n y", "１２ ½ ǅ", "a b", "\x1c!\x1c", "<|endoftext|> z", "aaaa" * 99])
def test_codec_matches_libraries(text):
    c = bpe.codec(bpe.load_spec(P.path("byte_bpe_50k.json")))
    assert c.encode(text) == c.encode_whole(text)
    multi = bpe.codec(bpe.load_spec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN))
    assert np.frombuffer(multi.encode(text), "<u4").tolist() == _tiktoken().encode_ordinary(text)


def _specs():
    return [bpe.load_spec(P.path("byte_bpe_50k.json")), bpe.load_spec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)]


@pytest.mark.parametrize("which", [0, 1])
def test_codec_matches_library_on_many_texts(monkeypatch, which):
    rng = random.Random(which)
    c = bpe.codec(_specs()[which])
    some = ["a", "Be", "é", "ª", "²", "½", "1", "１", "日", "e\u0301", "\u0301", "'s", "'", ".", ",", "!?", "$$$", "€", "_", "-", "\n", "\n", "\n\n", "\r\n", "\t", "\x1c", "\x85", "\xa0", "\u2028", "\0", "<|endoftext|>", *" " * 12]
    texts_ = ["".join(rng.choice(some) for _ in range(rng.randrange(12))) for _ in range(4000)]
    texts_ += ["\n".join(" ".join(rng.choice(["stone", "Paper", "grün", "x²", "4"]) + rng.choice(["", "", ".", ",***"]) for _ in range(5)) for _ in range(3)) for _ in range(300)]
    for chunk in (1, 300, 1 << 22):
        monkeypatch.setattr(bpe, "CHUNK", chunk)
        c.pieces.clear()
        got = list(bpe.encoded(c, pa.array(["skipped", None, *texts_]).slice(1)))
        assert got == [b"", *map(c.encode_whole, texts_)]


@pytest.mark.parametrize("which", [0, 1])
def test_codec_reuses_words_across_lines_and_marks(which):
    c = bpe.Codec(_specs()[which])
    sent = []
    c._encode, real = lambda parts: sent.extend(parts) or real(parts), c._encode
    texts_ = ["x stone paper", "x paper, stone.\nPaper stone!!\nPaper stone."]
    assert c.encode_many(pa.array(texts_)) == list(map(c.encode_whole, texts_))
    assert sorted(sent) == ["\nPaper", "paper", "stone"]
    assert sorted(c.pieces) == ["\nPaper", "paper", "paper,", "stone", "stone!!", "stone."]


def test_codec_keeps_pieces_apart_from_added_tokens():
    spec = json.loads(_specs()[0])
    spec["added_tokens"].append(spec["added_tokens"][0] | {"id": 50257, "content": "stone paper"})
    c = bpe.Codec(json.dumps(spec))
    texts_ = ["x stone", "x paper", "x stone paper"]
    for given in (texts_, texts_[2:] + texts_):
        c.pieces.clear()
        assert c.encode_many(pa.array(given)) == list(map(c.encode_whole, given))


def test_codec_cuts_only_where_the_file_does():
    spec = json.loads(_specs()[0])
    spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"}, "behavior": "Isolated", "invert": False}, spec["pre_tokenizer"] | {"use_regex": False}]}
    c = bpe.Codec(json.dumps(spec))
    texts_ = ["x stone.\nPaper stone,\n1 a\nb", "x stone paper"]
    assert not c.lines
    assert c.encode_many(pa.array(texts_)) == list(map(c.encode_whole, texts_))


def test_token_files(spark, monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want, at = {}, 0
    unique = [r for r in rows() if r[1] != 307]
    for i, text in sorted(texts(unique)):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        at += len(ids)
    monkeypatch.setattr(dac, "SEGMENT", 300)
    to = f"{spark.conf.get('spark.checkpoint.dir')}/tokens-test"
    dac.write_tokens(table(spark, unique), P.path("byte_bpe_50k.json"), to, partitions=3)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32, r.ids) for r in dac.read_tokens(spark, to, full=True).collect()}
    assert got == want


def test_codes_give_any_token():
    rng = np.random.default_rng(0)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = rng.choice([0, 5, 255, 256, 70_000, 2**31], n).astype(np.uint32)
        r = dac.Reader(dac.pack(ids))
        assert [r.get(i) for i in range(n)] == ids.tolist()
        for a, b in ((0, n), (n // 3, n // 2), (n, n)):
            assert r.slice(a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(IndexError):
        dac.Reader(dac.pack(np.array([1]))).get(1)


def _lines_by_hand(given, min_docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    n = Counter(k for _, t in given for k in {key(x) for x in t.split("\n")} if k)
    out = []
    for i, t in given:
        kept = [x for x in t.split("\n") if n[key(x)] < min_docs]
        out.append((i, len(t.split("\n")), len(t.split("\n")) - len(kept), sha("\n".join(kept)), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("most_bytes,log_bits", [(1 << 20, 20), (-1, 20), (1 << 20, 3)])
def test_drop_lines(spark, most_bytes, log_bits):
    df = lines.drop_lines(table(spark).repartition(3), most_bytes=most_bytes, log_bits=log_bits, carry=["lang", "row"])
    assert sorted_rows(df, "doc_id", "n_lines", "n_dropped", "kept_sha256", "text") == _lines_by_hand(texts(), 10)
    assert {r["row"]["row"] for r in df.collect()} == {2}


def test_drop_lines_merges_filters_of_neighbouring_tasks(spark):
    """The first merge leaves a sixteenth of the pieces, and at most GROUPS of each, however many tasks there are."""
    assert [len({lines._group(t) for t in range(n)}) for n in (1, 16, 17, 32, 4096, 100_000)] == [1, 1, 2, 2, 256, lines.GROUPS]
    assert max(Counter(lines._group(t) for t in range(100_000)).values()) <= 16 * 25
    given = texts() + [(None, "null id\nCOMMON line"), (None, None), *((400 + i, f"twelve\nonly {i}") for i in range(12))]
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(40)
    got = sorted_rows(lines.drop_lines(df, log_bits=20), "doc_id", "n_lines", "n_dropped", "kept_sha256", "text")
    assert got == _lines_by_hand([(i, t or "") for i, t in given], 10)


@pytest.mark.parametrize("most_bytes", [1 << 20, -1])
def test_drop_lines_keeps_first(spark, most_bytes):
    given = [("x", i, "a\nSAME\nb" if i else "SAME\nsame", "", 0, 0, "", 0, "") for i in range(12)]
    got = {r.doc_id: r.text for r in lines.drop_lines(table(spark, given), keep_first=True, most_bytes=most_bytes).collect()}
    assert got[0] == "SAME" and got[1] == "a\nb"


def _substrings_by_hand(given, k=50):
    first = {}
    docs = [(i, t.encode()) for i, t in given]
    for i, t in docs:
        for p in range(len(t) - k + 1):
            first[t[p : p + k]] = min(i, first.get(t[p : p + k], i))
    out = []
    for i, t in docs:
        gone = bytearray(len(t))
        for p in range(len(t) - k + 1):
            if first[t[p : p + k]] < i:
                gone[p : p + k] = b"\1" * k
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), sum(gone), sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1])), sha(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk,part,hot", [(1 << 19, 1 << 24, 512), (3000, 1000, 512), (3000, 1000, 2), (1 << 19, 1 << 24, 4)])
def test_remove_repeats(spark, monkeypatch, chunk, part, hot):
    for name, v in (("CHUNK", chunk), ("PART", part), ("RUN", 9000), ("BUCKET", 4000), ("HOT", hot)):
        monkeypatch.setattr(substrings, name, v)
    df = substrings.remove_repeats(table(spark).repartition(3), carry=["row"])
    assert sorted_rows(df, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == _substrings_by_hand(texts())
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in df.collect())


def test_a_string_in_several_spans_of_a_document(spark, monkeypatch):
    rng = random.Random(3)
    passage = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 5) for _ in range(30))
    other = lambda n: " ".join("".join(rng.choice("ijklmnopq") for _ in range(5)) for _ in range(n))
    given = [(i, " ".join([other(9), passage, other(9), passage, other(9)][: 2 + i % 4])) for i in range(40)]
    for name, v in (("RUN", 1500), ("BUCKET", 4000), ("HOT", 2)):
        monkeypatch.setattr(substrings, name, v)
    df = substrings.remove_repeats(spark.createDataFrame(given, "doc_id long, text string").repartition(3))
    assert sorted_rows(df, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == _substrings_by_hand(given)


def test_loser_tree_merges_without_reading_known_prefixes():
    rng = random.Random(5)
    for n in (1, 2, 3, 7, 12):
        runs = []
        for _ in range(n):
            some = sorted({bytes([(m := rng.randrange(12))]) + bytes(rng.choice(b"ab") for _ in range(m)) for _ in range(rng.randrange(1, 40))})
            runs.append(([0] + [len(os.path.commonprefix([a, b])) for a, b in zip(some, some[1:], strict=False)], some))
        want = sorted(x for _, r in runs for x in r)
        place, got, last = [0] * n, [], b""
        for r, know in zip(*substrings.merge(runs), strict=True):
            x = runs[r][1][place[r]]
            place[r] += 1
            assert know == len(os.path.commonprefix([last, x]))
            got.append(x)
            last = x
        assert got == want


def test_front_coding_round_trip():
    texts_ = [(0, 0, ("the same words again and again in every line of it " * 3).encode()), (1, 0, ("another text with the same words again and again in every line of it " * 2).encode())]
    s = substrings.spans(texts_, 50)
    rows_ = np.unique(substrings.suffixes(s, np.arange(len(s.key)), 50), axis=0)
    text = b"".join(t for _, _, t in texts_)
    spans_ = {(text[a:b], c - a) for a, b, c in zip(s.lo.tolist(), s.hi.tolist(), s.seed.tolist(), strict=True)}
    whole = [r[: substrings.HEAD + r[5]].tobytes() + r[substrings.HEAD + 50 : substrings.HEAD + 50 + r[6]].tobytes() for r in rows_]
    assert {(w[substrings.HEAD + w[5] :][::-1] + w[substrings.HEAD : substrings.HEAD + w[5]], w[6]) for w in whole} == spans_
    shared, back = substrings.front_decode(substrings.front_code(rows_, 50))
    assert back == whole and shared == [0] + [len(os.path.commonprefix([a, b])) for a, b in zip(whole, whole[1:], strict=False)]


def test_remove_repeats_wants_whole_numbers_as_ids(spark):
    with pytest.raises(TypeError):
        substrings.remove_repeats(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_remove_repeats_cuts_characters(spark):
    passage = "é" * 30
    given = [("x", 1, "x" + passage, "", 0, 0, "", 0, ""), ("x", 2, passage + "tail", "", 0, 0, "", 0, ""), ("x", None, "null id " * 9, "", 0, 0, "", 0, ""), ("x", 3, "null id " * 9, "", 0, 0, "", 0, "")]
    got = {r.doc_id: r.kept for r in substrings.remove_repeats(table(spark, given), keep="text").collect()}
    assert got == {1: "x" + passage, 2: "tail", None: "null id " * 9, 3: ""}


def test_packing(spark):
    given = rows()
    for capacity, limit in ((64, 2), (1000, 16)):
        got = packing.pack(table(spark, given), capacity=capacity, source_limit=limit, shard=40).collect()
        n = {}
        for i, t in texts(given):
            n[i] = n.get(i, 0) + len(re.findall(r"[^ \t\n\x0b\x0c\r]+", t))
        bins = defaultdict(list)
        for r in got:
            bins[r.bin].append(r)
        by_id = {r[1]: r for r in given}
        for b in bins.values():
            b.sort(key=lambda r: r.bin_offset)
            assert sum(r.n_tokens for r in b) <= capacity
            assert all(x.bin_offset + x.n_tokens <= y.bin_offset for x, y in zip(b, b[1:], strict=False))
            assert len({by_id[r.doc_id][2] or "" for r in b}) == len(b)
            assert max(Counter(by_id[r.doc_id][6] for r in b).values()) <= limit
        total = Counter()
        for r in got:
            total[r.doc_id] += r.n_tokens
        assert total == Counter(n)
        again = packing.pack(table(spark, given[::-1]).repartition(5), capacity=capacity, source_limit=limit, shard=40).collect()
        assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_best_fit_takes_the_tightest_free_bin():
    # bins left after the first three: 4, 3 and 2; the cluster of the last is in the bin with 2 left
    out = packing.best_fit([(8, 0, 1, 1), (7, 1, 2, 2), (6, 2, 3, 3), (2, 3, 1, 4)], 10, 1)
    assert [b for b, _ in out] == [0, 1, 2, 1]


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li>Home</li></ul></nav>
<div class="ad">Buy</div><article><header><h1>Big&nbsp;&amp; News</h1></header><p>One <b>bo</b>ld<br>line.<p>Two<aside>side</aside></p>
<section class="comments"><p>first!</p></section></article><footer>&copy; x</footer></body></html>"""


def test_blocks():
    assert html.blocks(PAGE) == (["Big & News", "One bold line.", "Two"], True)
    assert html.blocks("") == ([], False)
    assert html.blocks("<article>a<p>b &lt;c&gt; <img alt='>'>d</article") == (["a", "b <c> d"], True)
    assert html.blocks("<main>x <!-- <p>no --> y<form>q</form></main>") == (["x y"], True)
    assert html.blocks("<p>plain</p>text<div id=sidebar>no</div>") == (["plain", "text"], False)


def test_main_text(spark):
    foot = "<p>This site keeps all of its rights and asks you to read the terms of use</p>"
    plain = [(10 + i, f"http://h.example/{i}", f"<p>{' '.join(f'story{i}word{k}' for k in range(20))}</p>{foot}", "x") for i in range(3)]
    other = [(20, "http://other.example/1", foot, "x"), (21, None, None, "x"), (22, "http://h.example/9", "", "x"), (1, "http://a.example", PAGE, "x")]
    df = spark.createDataFrame(plain + other, "page_id long, url string, html string, `TEXT` string")
    got = {r.page_id: (r.text, r.n_chars) for r in html.main_text(df).collect()}
    want = {1: "Big & News One bold line. Two", 20: "This site keeps all of its rights and asks you to read the terms of use", 21: "", 22: ""}
    want |= {i: h.split("</p>")[0][3:] for i, _, h, _ in plain}
    assert got == {k: (v, len(v)) for k, v in want.items()}
    assert html.main_text(df.limit(0)).count() == 0


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DDL)
    assert exact.exact_dedup(empty).count() == 0
    assert bpe.encode_decode(empty, P.path("byte_bpe_50k.json")).count() == 0
    assert dac.token_files(empty, P.path("byte_bpe_50k.json")).count() == 0
    assert lines.drop_lines(empty).count() == 0
    assert substrings.remove_repeats(empty).count() == 0
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("inside", ['<span class="share">x</span>', '<i aria-hidden="true"></i>', '<a class="nav-link" href="/">x</a>', "<span hidden>x <span>y</span> <b>z</b></span>", '<a role="menu"><div>x</div></a>'])
def test_html_text_after_dropped_inline_elements(inside):
    found, main = html.blocks(f"<article><p>A {inside} B</p><p>C</p></article>")
    assert " ".join(found) == "A B C" and main
    assert " ".join(html.blocks(f"<article><p>wo{inside}rd</p></article>")[0]) in ("word", "wo rd")


def test_html_dropped_inline_elements_end_with_their_block():
    assert html.blocks("<article><div>A <span hidden>x</div>B</article>") == (["A", "B"], True)
    assert html.blocks("<article>wo<i hidden></i>rd <span><span class=share>x</span>y</span></article>") == (["word y"], True)


def test_html_pages_with_equal_text_keep_it(spark):
    text = " ".join(f"w{i}" for i in range(20))
    pages = [(1, "http://h/a", f"<p>{text}</p>"), (2, "http://h/b", f"<div>{text}</div>"), (3, "http://g/a", f"<p>{text}</p>"), (4, "http://g/b", f"<p>{text}</p><p>other</p>")]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: text, 2: text, 3: "", 4: "other"}


def test_added_tokens_are_one_id(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    given = ["<|endoftext|>", "a <|endoftext|> z", "a<|endoftext|>z <|endoftext|>", "plain <|endoftext|", " <|endoftext|>  x"]
    c = bpe.codec(bpe.load_spec(P.path("byte_bpe_50k.json")))
    want = [t.encode(x, add_special_tokens=False).ids for x in given]
    assert [np.frombuffer(x, "<u4").tolist() for x in c.encode_many(given)] == want and want[0] == [50256]
    rows_ = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    crc = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in dac.token_files(rows_, P.path("byte_bpe_50k.json")).collect()}
    assert crc == {i: (len(x) + 1, zlib.crc32(np.array([*x, 0], "<u4").tobytes())) for i, x in enumerate(want)}
