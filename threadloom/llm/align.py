"""Alignment of two tokenizers over the same text, by strings of labels.

Each byte of a text gets a label: no token ends there, one of A, one of B, or one of both. A regular expression cuts the string behind each
label "both": a span is a group, and counting its labels gives the tokens of either side. Walking a group's labels gives its links, the pairs
of tokens that share bytes.

Where single white space (a space or a line feed) stands between other characters, both tokenizers end a token before it whatever stands
around, so each run with the white space before it is aligned once in a worker and kept. Any other text is aligned as a whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_chars, load_spec
from .common import Scratch, maybe_broadcast, pick, release_memory

#: Labels of a byte: no end, an end of A, of B, of both; and a group: all up to and with an end of both.
_, A_END, B_END, BOTH = b".abx"
GROUP = re.compile(rb"[.ab]*x")
#: Runs of characters with the white space before them; a text that they don't make up has other white space, and isn't cut.
RUN = re.compile(r"[ \n]?[^\s]+")
#: Runs that a worker keeps at most, about; when full, it starts anew. A larger dict would double.
CACHE = 640_000
#: Texts that are handled at once.
CHUNK = 256
#: Bits of B's id in the code of a pair, a fixed value of sentencepiece.
SHIFT = 32
_MARKS = bytes.maketrans(b"\0\1\2\3", b".abx")


def labels(a_lengths: np.ndarray, b_lengths: np.ndarray) -> np.ndarray:
    """A label for each byte of a text that both cut, from the lengths of their tokens: 0 no end, 1 of A, 2 of B, 3 of both."""
    out = np.zeros(int(a_lengths.sum()), np.uint8)
    out[np.cumsum(a_lengths) - 1] = 1
    out[np.cumsum(b_lengths) - 1] |= 2
    return out


def spans(marks: np.ndarray) -> list[tuple[int, int]]:
    """How many tokens of A and of B each group has: a span goes up to a label of both, and its labels are counted."""
    counts: dict[bytes, tuple[int, int]] = {}
    out = []
    for span in GROUP.findall(marks.tobytes().translate(_MARKS)):
        if span not in counts:
            counts[span] = (span.count(A_END) + span.count(BOTH), span.count(B_END) + span.count(BOTH))
        out.append(counts[span])
    return out


def links(marks: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The codes of all pairs of tokens that share bytes, in order. Each label ends a pair, of the tokens that are open there."""
    ends = marks[marks > 0]
    of = lambda side: np.cumsum(side) - side
    return a[of((ends & 1).astype(np.int64))] << SHIFT | b[of((ends >> 1).astype(np.int64))]


def written(groups: list[tuple[int, int]], a: list[str], b: list[str]) -> list[str]:
    out, i, j = [], 0, 0
    for n_a, n_b in groups:
        out.append(f"{a[i]}|{b[j]}" if n_a == n_b == 1 else ",".join(a[i : i + n_a]) + "|" + ",".join(b[j : j + n_b]))
        i, j = i + n_a, j + n_b
    return out


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array(list(map(len, lists)), np.int64)
    return np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum())), n


def _sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sum of each run of n values."""
    sums = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(n)
    return sums[ends] - sums[ends - n]


class Aligner:
    """Both vocabularies in one Python worker, and the alignments of runs: `number` has their places in the lists and arrays."""

    def __init__(self, spec: str, model: bytes):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(spec)
        self.a.encode_special_tokens = True
        back = {c: b for b, c in byte_chars().items()}
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values(), default=-1) + 1)
        for t, i in vocab.items():
            self.a_bytes[i] = bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
        self.b = SentencePieceProcessor(model_proto=model)
        byte = re.compile(r"<0x([0-9A-F]{2})>")
        piece = lambda i: bytes([int(m[1], 16)]) if self.b.IsByte(i) and (m := byte.fullmatch(self.b.IdToPiece(i))) else self.b.IdToPiece(i).replace("▁", " ").encode()
        self.b_bytes = [piece(i) for i in range(self.b.GetPieceSize())]
        self.a_length, self.b_length = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.decimal = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.mark = self.b.PieceToId("▁")
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[bytes | None] = []  # None: a side doesn't give the run back
        self.counts = np.zeros((4, 0), np.int32)  # tokens of A, of B, groups, links
        self.starts, self.codes = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def aligned(self, raws: list[str], a: list[list[int]], b: list[list[int]]) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
        """Counts of each text, all their link codes one after the other, and their groups; texts that a side doesn't give back have none."""
        bytes_ = [r.encode() for r in raws]
        (x, n_a), (y, n_b) = _flat(a), _flat(b)
        size = np.array(list(map(len, bytes_)), np.int64)
        same = lambda ids, of: b"".join(map(of.__getitem__, ids.tolist())) == b"".join(bytes_)
        if not (np.array_equal(_sums(self.a_length[x], n_a), size) and np.array_equal(_sums(self.b_length[y], n_b), size) and same(x, self.a_bytes) and same(y, self.b_bytes)):
            good = [b"".join(map(self.a_bytes.__getitem__, p)) == w == b"".join(map(self.b_bytes.__getitem__, q)) for w, p, q in zip(bytes_, a, b, strict=True)]
            keep = [i for i, ok in enumerate(good) if ok]
            counts, groups = np.zeros((4, len(raws)), np.int64), [None] * len(raws)
            some, codes, texts = self.aligned(*([z[i] for i in keep] for z in (raws, a, b))) if keep else (counts[:, :0], np.zeros(0, np.int64), [])
            counts[:, keep] = some
            for i, t in zip(keep, texts, strict=True):
                groups[i] = t
            return counts, codes, groups
        marks = labels(self.a_length[x], self.b_length[y])
        n, n_links = _sums(marks == 3, size), _sums(marks > 0, size)
        texts = written(spans(marks), *(list(map(self.decimal.__getitem__, z.tolist())) for z in (x, y)))
        ends = np.cumsum(n)
        groups = [";".join(texts[i:j]) for i, j in zip((ends - n).tolist(), ends.tolist(), strict=True)]
        return np.stack([n_a, n_b, n, n_links]), links(marks, x, y), groups

    def _encode(self, raws: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """B puts a space before what it encodes: that of the text itself, or one that goes again."""
        a = [e.ids for e in self.a.encode_batch_fast(raws, add_special_tokens=False)]
        b = self.b.encode([r.removeprefix(" ") for r in raws], num_threads=1)
        return a, [y if r[0] == " " else y[1:] if y[:1] == [self.mark] else [] for r, y in zip(raws, b, strict=True)]

    def learn(self, runs: list[str]) -> None:
        """Keeps the alignment of each run."""
        counts, codes, groups = self.aligned(runs, *self._encode(runs))
        self.number.update(zip(runs, range(len(self.groups), len(self.groups) + len(runs)), strict=True))
        self.groups += [g if g is None else g.encode() for g in groups]
        self.starts = np.concatenate([self.starts, (len(self.codes) + np.cumsum(counts[3]) - counts[3]).astype(np.int32)])
        self.counts, self.codes = np.concatenate([self.counts, counts.astype(np.int32)], 1), np.concatenate([self.codes, codes])

    def texts(self, some: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, bytes] | None]:
        """For each text its counts, its link codes in order and its groups; None: it has no tokens."""
        cut = [RUN.findall(" " + t) if t else [] for t in some]
        cut = [runs if t and sum(map(len, runs)) == len(t) + 1 else None for t, runs in zip(some, cut, strict=True)]
        if len(self.number) > CACHE:
            self.forget()
        new = set(chain.from_iterable(runs for runs in cut if runs)).difference(self.number)
        if new:
            self.learn(list(new))
        for t, runs in zip(some, cut, strict=True):
            if not t or "▁" in t:
                yield None
            elif runs is None:
                raw = [" " + t]
                counts, codes, groups = self.aligned(raw, *self._encode(raw))
                yield None if groups[0] is None else (counts[:, 0].tolist(), codes, groups[0].encode())
            else:
                at = list(map(self.number.__getitem__, runs))
                groups = list(map(self.groups.__getitem__, at))
                if None in groups:
                    yield None
                    continue
                at = np.array(at)
                counts = self.counts[:, at].astype(np.int64)
                n, first = counts[3], np.cumsum(counts[3]) - counts[3]
                codes = self.codes[np.repeat(self.starts[at] - first, n) + np.arange(int(n.sum()))]
                yield counts.sum(1).tolist(), codes, b";".join(groups)


_ALIGNERS: dict[str, Aligner] = {}


def aligner(spec: str, model: bytes) -> Aligner:
    """The worker's own aligner: made once, used by all its tasks."""
    key = hashlib.md5(spec.encode() + model).hexdigest()
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(spec, model)
    return _ALIGNERS[key]


def align_tokens(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """One row per input row: id, n_a, n_b, n_groups, n_links, n_best (links of a pair that is its B id's most frequent, ties included),
    count_sum (of the links' pairs, over all texts) and groups_sha256; with full=True also groups as written text.

    A is a tokenizers file and encodes a space and the text, B a sentencepiece model and encodes the text. Special tokens in texts are
    plain text. Texts that are null or empty, or that a side doesn't give back byte by byte (U+2581, which B reads as a space), have no
    tokens: zeros and an empty string, and count nowhere. Rows that repeat, in ids too, are rows of their own. An empty table gives an
    empty result; columns other than the two are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "align")
    with open(b_path, "rb") as f:
        held = spark.sparkContext.broadcast((load_spec(a_path), f.read()))
    rows = pick(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    names = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", *["groups"] * full]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = aligner(*held.value)
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK):
                some = batch.slice(i, CHUNK)
                counts, digests, codes, times, ends, groups = [], [], [], [], [0], []
                for got in side.texts(some.column(2).to_pylist()):
                    n, of, text = got or ([0] * 4, np.zeros(0, np.int64), b"")
                    pairs, n_of = np.unique(of, return_counts=True)
                    counts.append(n)
                    digests.append(hashlib.sha256(text).hexdigest() if got else "")
                    codes.append(pairs)
                    times.append(n_of)
                    ends.append(ends[-1] + len(pairs))
                    if full:
                        groups.append(text.decode())
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x), pa.int64())) for x in (codes, times)]
                numbers = [pa.array(x, pa.int64()) for x in zip(*counts, strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *numbers, pa.array(digests, pa.string()), *lists, *[pa.array(groups, pa.string())] * full], names)
        release_memory()

    schema = f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>" + ", groups string" * full
    aligned = scratch.keep(rows.select(F.monotonically_increasing_id().alias("row"), "id", "text").mapInArrow(run, schema))

    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    counts = scratch.keep(links.groupBy("pair").agg(F.sum("times").alias("n")))
    b = F.col("pair").bitwiseAND((1 << SHIFT) - 1)
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    n_b = most.count()
    pairs = scratch.keep(counts.join(maybe_broadcast(most, n_b, 32), b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    of = links.join(maybe_broadcast(pairs, pairs.count(), 48), "pair")
    sums = of.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    out = aligned.drop("pairs", "times").join(sums, "row", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")})
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * full)
