"""Exports cut by many tasks give what a JSON parser gives."""

import json
import random

import pytest

from threadloom.sources import export, export_scan


def _value(rng, depth=0):
    texts = ['a "quoted" \\ text', "} ] { [", '\\"', "日本語 }{", "\n\t", "", '"conversations": [', "\\\\", "x" * 70, "😀}"]
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind < 2:
        return rng.choice(texts)
    if kind == 2:
        return rng.choice([1, -2.5, None, True])
    if kind == 3:
        return rng.choice([[], {}])
    if kind == 4:
        return [_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(texts) + str(i): _value(rng, depth + 1) for i in range(rng.randrange(4))}


def _conversation(rng, n):
    out = {"id": f"k{rng.randrange(n)}", "mapping": {"r": {"id": "r", "x": _value(rng)}}, "title": rng.choice(["}", "T"]), "conversations": _value(rng)}
    for k in rng.sample(list(out), rng.choice([0, 0, 0, 1])):
        del out[k]
    return out


def _files(rng, folder):
    """Files by name, and the objects that each holds."""
    objects = {}
    for i in range(8):
        some = [rng.choice([_conversation(rng, 30)] * 8 + [{}, {"a": {"b": 1}}]) for _ in range(rng.randrange(9))]
        other = [5, "}", None, [{"id": "inner", "mapping": {}}]]
        listed = [x for s in some for x in ([s, rng.choice(other)] if rng.random() < 0.3 else [s])]
        form = i % 4
        value = listed if form < 2 else {"about": [{"id": "no", "mapping": {}}], "conversations": listed, "after": [{"id": "no2", "mapping": {}}]} if form == 2 else _conversation(rng, 30) | {"conversations": "none"}
        name = f"f{i}.json"
        (folder / name).write_text(json.dumps(value, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5) + rng.choice(["", "\n"]))
        objects[name] = [value] if form == 3 else some
    (folder / "notes.txt").write_text("[{}]")
    (folder / "empty.json").write_text("")
    (folder / "number.json").write_text("12")
    return objects


@pytest.mark.parametrize("block,sent", [("150", 16 << 20), ("500", 0), ("128m", 16 << 20)])
def test_elements_as_of_a_parser(spark, tmp_path, monkeypatch, block, sent):
    monkeypatch.setattr(export_scan, "BROADCAST_BYTES", sent)
    objects = _files(random.Random(len(block)), tmp_path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = export_scan.scan_elements(spark, str(tmp_path)).collect()
        elements = export.read_elements(spark, str(tmp_path))
        read = elements.collect()
        counts = export.load_counts(spark, str(tmp_path), elements).first()
        if block == "150":
            assert export_scan._rows(spark, str(tmp_path)).rdd.getNumPartitions() > 20
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    by = {n: [json.loads(r.text) for r in sorted(got, key=lambda r: r.pos) if r.file.endswith("/" + n)] for n in objects}
    assert by == objects and len(got) == sum(map(len, objects.values()))
    seen, want = set(), []
    for name in sorted(objects):
        for x in objects[name]:
            fit = bool(x.get("id")) and isinstance(x.get("mapping"), dict)
            want.append("no_conversation" if not fit else "repeated" if x["id"] in seen else None)
            seen |= {x["id"]} if fit else set()
    assert [r.skip_reason for r in sorted(read, key=lambda r: (r.file, r.pos))] == want
    assert counts.asDict() == {"files": 9, "skipped_files": 1, "elements": len(want), "no_conversation": want.count("no_conversation"), "repeated": want.count("repeated"), "conversations": want.count(None)}


def test_a_file_that_breaks_off(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id":"a","mapping":{}},{"id":"b"')
    (tmp_path / "b.json").write_text('[{"id":"c","mapping":{}},{"id":"d","mapping":{}')
    assert [r.external_id for r in export.read_exports(spark, str(tmp_path)).orderBy("file", "pos").collect()] == ["a", "c"]
