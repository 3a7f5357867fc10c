"""Export files of any size, cut into their conversations by many tasks.

An export is one JSON document: an array of conversations, {"conversations": [...]}, or one conversation. Spark's text reader splits it
at "}" into rows, in blocks of the file, wherever the file lies. What a row means depends on what stands before it: whether it begins in a
string, and how deep. So the blocks are read twice:

1. each block tells how it changes that state, for a beginning in a string and outside of one (only a quote changes between the two);
   the changes are added up over a file's blocks, a row a block;
2. with its own beginning known, each block gives the elements that it has as a whole, and pieces of those that other blocks go on with;
   pieces are put together by element.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import kept

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"?|[{}\[\]]', re.S)
_REST = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
_KEY = re.compile(r'"conversations"\s*:\s*\Z')
#: Largest estimated size of the blocks' states, in bytes, that are sent to every task.
BROADCAST_BYTES = 16 << 20


def _outside(row: str, in_string: bool) -> tuple[list[str], bool]:
    """The parts of a row that are in no string, and whether its end is in one."""
    if "\\" in row:
        row = row.replace("\\\\", "").replace('\\"', "")
    parts = row.split('"')
    return parts[1::2] if in_string else parts[0::2], in_string ^ (len(parts) % 2 == 0)


def _deeper(parts: list[str]) -> int:
    return sum(p.count("{") + p.count("[") - p.count("]") for p in parts)


class Cutter:
    """Walks the rows of one block. kind: the file's first character; "{*" if it is an object that holds an array of conversations, "{?"
    while that isn't known."""

    def __init__(self, in_string: bool, depth: int, kind: str, inside: bool):
        self.in_string, self.depth, self.kind, self.inside = in_string, depth, kind, inside
        self.base = {"[": 1, "{": 0, "{*": 2}.get(kind, -1)
        self.parts: list[str] | None = [] if self._element() and depth > self.base else None  # of the element that is open
        self.begun = self.parts is None  # here, not in an earlier block
        self.opened: bool | None = None  # what the last bracket of an array of conversations did
        self.holds = False  # whether such an array begins here
        self.done: list[tuple[int, str, str]] = []
        self.n = 0

    def _element(self) -> bool:
        return self.base >= 0 and (self.kind != "{*" or self.inside)

    def _give(self, piece: str) -> None:
        self.done.append((self.n, piece, "".join(self.parts)))
        self.n, self.parts, self.begun = self.n + 1, None, True

    def _leave(self) -> None:
        if self.depth <= 1 and (self.inside or self.kind == "{?"):
            self.inside = self.opened = False

    def row(self, text: str, closed: bool) -> None:
        """A row; closed: a "}" follows it."""
        at = 0
        if self.parts is not None and self.begun or self.parts is None and self.depth - text.count("]") > 2:  # nothing can begin here
            out, self.in_string = _outside(text, self.in_string)
            self.depth += _deeper(out)
            self._leave()
        else:
            rest = _REST.match(text) if self.in_string else None
            self.in_string = self.in_string and not rest
            for m in () if self.in_string else _TOKEN.finditer(text, rest.end() if rest else 0):
                t = m[0]
                if t == "{":
                    if self.parts is None and self._element() and self.depth == self.base:
                        self.parts, at = [], m.start()
                    self.depth += 1
                elif t == "[":
                    if self.depth == 1 and self.kind[:1] == "{" and _KEY.search(text, 0, m.start()):
                        self.inside = self.opened = self.holds = True
                    self.depth += 1
                elif t == "]":
                    self.depth -= 1
                    self._leave()
                    if self.parts is not None and self.depth <= self.base:  # what went on from an earlier block is an array
                        self.parts, self.begun = None, True
                elif len(t) == 1 or not (t.endswith('"') and _closes(t)):
                    self.in_string = True
        if self.parts is not None:
            self.parts.append(text[at:] + "}" * closed)
        if closed and not self.in_string:
            self.depth -= 1
            if self.parts is not None and self.depth == self.base:
                self._give("whole" if self.begun else "end")

    def finish(self) -> None:
        if self.parts is not None:
            self._give("begin" if self.begun else "middle")


def _closes(token: str) -> bool:
    """Whether a token's last quote isn't escaped."""
    body = token[1:-1]
    return (len(body) - len(body.rstrip("\\"))) % 2 == 0


def _rows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    text = spark.read.option("lineSep", "}").option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).text(paths)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), "value")


def _walk(batches: Iterator[pa.RecordBatch], begin, step, drain) -> Iterator:
    """Rows of one block after the other: each block's state as begin makes it, rows with None instead of True for the last of a block,
    and what drain gives at the end of each batch (False) and block (True)."""
    at, before, state = None, None, None
    for batch in batches:
        col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        heads = zip(col["file"].to_pylist(), col["block"].to_pylist(), col["value"].to_pylist(), strict=True)
        for i, (file, block, text) in enumerate(heads):
            if (file, block) != at:
                if at is not None:
                    step(state, before, None)
                    yield at, drain(state, True)
                at, state = (file, block), begin({c: x[i].as_py() for c, x in col.items() if c != "value"})
            else:
                step(state, before, True)
            before = text
        if at is not None:
            yield at, drain(state, False)
    if at is not None:
        step(state, before, None)
        yield at, drain(state, True)


def _table(rows: list[tuple], fields: dict[str, pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, fields.values(), strict=True)], list(fields))


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def step(s: dict, text: str, closed: bool | None) -> None:
        s["first"] = s["first"] or text.lstrip()[:1]
        s["bytes"] += 1 + (len(text) if text.isascii() else len(text.encode()))
        for start in (False, True):
            out, s["in"][start] = _outside(text, s["in"][start])
            s["deeper"][start] += _deeper(out) - (not s["in"][start])  # only the file's last row may have no "}", and nothing follows it

    begin = lambda x: {"size": x["size"], "bytes": 0, "first": "", "in": [False, True], "deeper": [0, 0]}
    walked = _walk(batches, begin, step, lambda s, end: end and (s["size"], s["bytes"], s["in"][0], *s["deeper"], s["first"]))
    fields = {"file": pa.string(), "block": pa.int64(), "size": pa.int64(), "bytes": pa.int64(), "odd": pa.bool_(), "from_outside": pa.int64(), "from_string": pa.int64(), "first": pa.string()}
    yield _table([(f, b, *x) for (f, b), x in walked if x], fields)


def _cutter(x: dict) -> tuple[Cutter, bool]:
    return Cutter(x["in_string"], x["depth"], x["kind"], x["inside"]), x["closed"]


def _step(held: tuple[Cutter, bool], text: str, closed: bool | None) -> None:
    held[0].row(text, held[1] if closed is None else closed)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [(f, b, *x) for (f, b), x in _walk(batches, _cutter, _step, lambda held, end: end and (held[0].opened, held[0].holds)) if x]
    yield _table(got, {"file": pa.string(), "block": pa.int64(), "opened": pa.bool_(), "holds": pa.bool_()})


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def drain(held: tuple[Cutter, bool], end: bool) -> list[tuple[int, str, str]]:
        if end:
            held[0].finish()
        done, held[0].done = held[0].done, []
        return done

    for (file, block), done in _walk(batches, _cutter, _step, drain):
        for i in range(0, len(done), 256):
            yield _table([(file, block + n, piece, text) for n, piece, text in done[i : i + 256]], {"file": pa.string(), "pos": pa.int64(), "piece": pa.string(), "text": pa.string()})


def _with(rows: DataFrame, state: DataFrame, n: int) -> DataFrame:
    """The rows of the blocks, in their order, with the state in which each block begins."""
    if n * 256 <= BROADCAST_BYTES:
        return rows.drop("size").join(F.broadcast(state), ["file", "block"])
    apart = rows.drop("size").withColumn("nth", F.monotonically_increasing_id()).join(state, ["file", "block"])
    return apart.repartition("file", "block").sortWithinPartitions("file", "block", "nth").drop("nth")


def scan_elements(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, pos, text): each object of an export's array, or the file's one object. pos ascends in the order of a file, from its bytes.

    Only *.json files below the paths are read. Elements that aren't objects are left out, and so is an element that its file breaks off.
    A file that is neither array nor object has none. A file without "}" may be empty. The same bytes give the same rows however the
    reader cuts the files into blocks.
    """
    rows = _rows(spark, paths)
    summary = "file string, block long, size long, bytes long, odd boolean, from_outside long, from_string long, first string"
    changes = kept(rows.mapInArrow(_changes, summary), "export_changes")
    order, whole = Window.partitionBy("file").orderBy("block"), Window.partitionBy("file")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum(F.col("odd").cast("int")).over(before), F.lit(0)) % 2 == 1
    # a file's last row has a "}" after it if the rows, each with one, add up to the file
    closed = (F.col("block") < F.max("block").over(whole)) | (F.sum("bytes").over(whole) == F.col("size"))
    state = changes.withColumns({"in_string": odd, "closed": closed, "kind": F.coalesce(F.min_by("first", "block").over(whole), F.lit(""))})
    state = state.withColumn("own", F.when(F.col("in_string"), F.col("from_string")).otherwise(F.col("from_outside")))
    state = kept(state.select("file", "block", "in_string", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("depth"), "kind", F.lit(False).alias("inside"), "closed"), "export_state")
    n = state.count()

    # files that are an object: where does their array of conversations begin and end
    objects = state.where("kind = '{'").withColumn("kind", F.lit("{?"))
    opened = kept(_with(rows, objects, n).mapInArrow(_opened, "file string, block long, opened boolean, holds boolean"), "export_arrays")
    inside = F.coalesce(F.last("opened", True).over(before), F.lit(False))
    has = F.coalesce(F.max("holds").over(whole), F.lit(False))
    wrapped = objects.drop("inside").join(opened, ["file", "block"], "left").withColumns({"inside": inside, "kind": F.when(has, "{*").otherwise("{")}).drop("opened", "holds")
    state = kept(state.where("kind <> '{'").unionByName(wrapped), "export_state")

    pieces = kept(_with(rows, state, n).mapInArrow(_pieces, "file string, pos long, piece string, text string"), "export_pieces")
    # an element goes on in the blocks after its beginning until its end; a piece that follows no beginning is of an array
    rest = pieces.where("piece <> 'whole'")
    part = rest.select("file", "pos", "piece")
    mark = F.when(F.col("piece") != "middle", F.struct("pos", "piece"))
    part = part.withColumn("mark", F.when(F.col("piece") == "begin", F.struct("pos", "piece")).otherwise(F.last(mark, True).over(Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))))
    part = part.where("mark.piece = 'begin'").select("file", "pos", F.col("mark.pos").alias("start"))
    joined = rest.join(part, ["file", "pos"]).groupBy("file", F.col("start").alias("pos")).agg(F.array_sort(F.collect_list(F.struct("pos", "piece", "text"))).alias("p"))
    ended = joined.where(F.exists("p", lambda x: x["piece"] == "end"))
    texts = ended.select("file", "pos", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    return pieces.where("piece = 'whole'").select("file", "pos", "text").unionByName(texts)


def _with(rows: DataFrame, state: DataFrame, n: int) -> DataFrame:
    """The rows of blocks with the state in which each begins; rows stay where they are, as only the states, one a block, are sent."""
    small = F.broadcast(state) if n * 256 <= 16 << 20 else state
    out = rows.join(small, ["file", "block"])
    return out if n * 256 <= 16 << 20 else out  # beyond that a join by a shuffle must keep the order


def file_counts(spark: SparkSession, path: str, like: str = "*.json") -> DataFrame:
    """One row: files below a path that are read, and those that are skipped for their name. No file is opened; files of 0 bytes are in neither count."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    named = F.regexp_extract("path", r"([^/]*)$", 1).like(like.replace("*", "%"))
    return files.agg(F.count_if(named).alias("files"), F.count_if(~named).alias("skipped_files"))
