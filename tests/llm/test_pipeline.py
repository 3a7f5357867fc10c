import os
from collections import Counter

import pytest

import corpus_pipeline as cp
from threadloom.llm import lines, queries

from .fixtures import DDL, rows
from .test_learned_and_similar import _classes as near_classes

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def documents(spark):
    """The rows of the small table in the columns of documents, and some more: one clashes with the text."""
    return spark.createDataFrame(rows(), DDL)


@pytest.mark.parametrize("stage", [s for _, s in cp.STAGES[1:-1]])
def test_stages_return_the_columns_of_documents(spark, stage):
    docs = documents(spark)
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    assert out.count() <= docs.count()
    assert stage(spark, docs.limit(0), SF).count() == 0
    if "n_chars" in out.columns and stage is not cp.drop_near_duplicates:
        assert all(r.n_chars == len(r.text or "") for r in out.collect())


def test_all_stages_take_clashing_columns(spark):
    docs = documents(spark)
    clean = cp.drop_toxic(spark, docs, SF)
    assert clean.columns == docs.columns and clean.count() > 0.9 * docs.count()
    packed = cp.pack(spark, docs, SF)
    assert sorted({r.doc_id for r in packed.collect()}) == sorted({r[1] for r in rows()})
    assert cp.pack(spark, docs.limit(0), SF).count() == 0 and cp.drop_toxic(spark, docs.limit(0), SF).count() == 0


def _chain(docs):
    """The stages after toxicity on (id, source, text) in plain Python: what is left, by id."""
    keys = lambda t: {k for x in t.encode().split(b"\n") if (k := lines.line_key(x))}
    n = Counter(k for _, _, t in docs for k in keys(t))
    docs = [(i, s, "\n".join(x for x in t.split("\n") if n[lines.line_key(x.encode())] < 10)) for i, s, t in docs]
    classes = near_classes([(i, t) for i, _, t in docs])
    docs = [d for d in docs if classes[d[0], d[2]] == d[0]]
    first = {}
    for i, _, t in docs:
        b = t.encode()
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(i, first.get(b[p : p + 50], i))
    out = {}
    for i, _, t in docs:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        out[i] = bytes(c for c, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_run_is_the_chain_of_plain_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    sf = tmp_path / "sf"
    table = spark.read.parquet(f"{SF}/documents.parquet")
    table.write.parquet(str(sf / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(sf / "labels.parquet"))
    clean = cp.drop_toxic(spark, table, SF).collect()
    want = _chain([(r.doc_id, r.source, r.text or "") for r in clean])
    tok = Tokenizer.from_file(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    sizes = {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in want.items()}
    got = cp.run(spark, str(sf)).collect()
    total = Counter()
    for r in got:
        total[r.doc_id] += r.n_tokens
    assert dict(total) == sizes
    sources, bins = {r.doc_id: r.source for r in clean}, {}
    for r in got:
        bins.setdefault(r.bin, []).append(r)
    for rs in bins.values():
        assert sum(r.n_tokens for r in rs) <= 8192 and max(Counter(sources[r.doc_id] for r in rs).values()) <= 16
        assert len({want[r.doc_id] for r in rs}) == len(rs)
        end = 0
        for r in sorted(rs, key=lambda r: (r.bin_offset, r.n_tokens)):
            assert r.bin_offset == end
            end += r.n_tokens


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = cp.drop_toxic(spark, docs, SF)
    assert clean.columns == docs.columns and 0 < clean.count() <= docs.count()
    packed = cp.run(spark, SF).collect()
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in packed} <= ids and len({r.doc_id for r in packed}) > 0.7 * len(ids)


def test_near_duplicates_keep_one(spark):
    docs = documents(spark)
    left = [r.doc_id for r in cp.drop_near_duplicates(spark, docs, SF).collect()]
    assert left.count(307) == 1 and sum(100 <= i < 300 for i in left) == 1 and len([i for i in left if i < 60]) == 60


def test_texts_of_repeated_ids_stay_unless_they_have_a_copy(spark):
    a, b, c = (" ".join(f"{x}{i * i % 97}" for i in range(60)) for x in "abc")
    given = [(1, a), (5, a), (5, b), (5, b), (-3, c), (7, c), (None, a), (8, None), (8, "")]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    got = [tuple(r) for r in cp.drop_near_duplicates(spark, docs, SF).collect()]
    assert {x for x in got if x[1]} == {(1, a), (5, b), (-3, c), (None, a)} and len([x for x in got if x[1]]) == 4


def test_queries_are_registered():
    import __spark_entry__ as e

    assert set(queries.QUERIES) <= set(e.queries()) and "pipeline" in e.queries()
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))


def test_texts_do_not_go_along_twice(spark, monkeypatch):
    """What a stage carries is neither the text nor its length, and cut texts come back some rows at a time."""
    from threadloom.llm import lines, substrings

    seen = []
    for module, name in ((lines, "drop_lines"), (substrings, "remove_repeats")):
        whole = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, whole=whole, **k: seen.append(len(k["carry"])) or whole(*a, **k))
    docs = spark.createDataFrame([(1, "x" * 60 + "\n", "a", 61), (2, "y" + "x" * 60, "b", 61)], "doc_id long, text string, source string, n_chars long")
    got = [sorted(map(tuple, stage(spark, docs, "").collect())) for stage in (cp.drop_common_lines, cp.drop_repeated_substrings)]
    assert seen == [2, 2]
    assert got == [[(1, "x" * 60 + "\n", "a", 61), (2, "y" + "x" * 60, "b", 61)], [(1, "x" * 60 + "\n", "a", 61), (2, "y", "b", 1)]]
    import pyarrow as pa

    n = 2 * substrings.ROWS + 1
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([f"text {i}" for i in range(n)]), pa.array([b""] * n, pa.binary()), pa.array([None] * n, pa.int32())], ["id", "text", "found", "row"])
    out = list(substrings._cut(50, "text")(iter([batch])))
    assert [b.num_rows for b in out] == [substrings.ROWS, substrings.ROWS, 1] and [t for b in out for t in b.column(5).to_pylist()] == batch.column(1).to_pylist()
