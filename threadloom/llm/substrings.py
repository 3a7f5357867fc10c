"""Removal of byte strings that an earlier document has, by a merge sort of suffixes that knows common prefixes.

Not every suffix takes part. In each string of k bytes one place is chosen by its content alone (the smallest hash of the
SEED bytes there), so equal strings choose the same place in them; neighbouring strings mostly share theirs. A record
stands for all strings that share a place: its span is all their bytes.

1. Filter: each task sends the sorted hashes of its seeds, each once; only places whose seed another document has too go on.
2. Merge sort: each task sorts its spans as suffixes from the seed on (then the bytes before it, backwards), keeps the smallest document
   of equal ones and sends front-coded runs by range of the seed: of each span the length of the prefix that it shares with the one
   before, and what follows. There a loser tree merges the runs. It knows how far each run's head agrees with the last one out, and only compares
   from there on. Spans that are equal, byte by byte, are covered but for the smallest document.
3. Where a seed has several different spans left (the ends of a passage, mostly), their strings are compared, byte by byte.

A seed of very many different spans, as at the ends of a passage that a third of all documents have, would meet in one task. Such seeds
are counted by the filter, and their strings go out one by one as 128-bit hashes, each once from a task with its smallest document, so they
are spread over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import BROADCAST_BYTES, Scratch, maybe_broadcast, pick, release_memory
from .hashing import BASE, Ranges, U, mix, words8

#: Bytes whose hash chooses a place. Bytes of text handled at once, and bytes whose records make one run.
SEED, CHUNK, RUN = 16, 1 << 16, 1 << 23
#: Bits of a position within a chunk and of a seed's hash.
POS, KEY = 26, 40
#: Bytes of text for each range of seeds, about.
BUCKET = 12 << 20
#: Different spans of a seed, over all tasks, from which on its strings go out one by one.
HOT = 512
#: A document of more bytes is handled in overlapping parts.
PART = 1 << 18
#: Rows that are cut and given back at once.
ROWS = 512
#: Stands for a null id: smaller than all others.
NULL_ID = -(1 << 63)


@dataclass
class Spans:
    """The spans of some documents: place of the first string, end of the last, seed place; all within `data`."""

    data: np.ndarray
    doc: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    seed: np.ndarray
    key: np.ndarray
    span: np.ndarray
    offset: np.ndarray  # of lo within its document

    @property
    def name(self) -> np.ndarray:
        """48 bits for a seed and a span; tells the spans of one document apart."""
        return (mix(self.key * U(0x9E3779B97F4A7C15) ^ self.span) >> U(16)).astype(np.int64)


def spans(parts: list[tuple[int, int, bytes]], k: int) -> Spans | None:
    """Parts are (document, offset in it, bytes)."""
    sizes = np.array([len(p[2]) for p in parts], np.int64)
    n = int(sizes.sum())
    data = np.frombuffer(b"".join(p[2] for p in parts) + bytes(64), np.uint8)
    place = np.arange(n)
    end = np.repeat(np.cumsum(sizes), sizes)
    eight = words8(data[: n + 32], n + 16)
    h = mix(eight[:n] * U(0x9E3779B97F4A7C15) + mix(eight[SEED - 8 : n + SEED - 8]))
    best = np.where(place + SEED > end, U(0xFFFFFFFFFFFFFFFF), h) & U(((1 << 64 - POS) - 1) << POS) | place.astype(U)
    width, done = k - SEED + 1, 1  # the smallest of `width` neighbours, by doubling
    while done * 2 <= width and len(best) > done:
        best, done = np.minimum(best[:-done], best[done:]), done * 2
    if width > done and len(best) > width - done:
        best = np.minimum(best[: done - width], best[width - done :])
    starts = np.flatnonzero(place + k <= end)
    if not len(starts):
        return None
    chosen = (best[starts] & U((1 << POS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(chosen, prepend=-1))
    lo, hi, seed = starts[first], np.append(starts[first[1:] - 1], starts[-1]) + k, chosen[first]
    doc_at = np.searchsorted(np.cumsum(sizes), lo, "right")
    docs, offsets = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
    begin = (np.cumsum(sizes) - sizes)[doc_at]
    span = (hi - lo).astype(U) << U(16) | (seed - lo).astype(U)
    for t in range(0, 2 * k - SEED, SEED):  # all its bytes, SEED at a time
        span = mix(span * U(0x9E3779B97F4A7C15) + h[np.minimum(lo + t, hi - SEED)])
    key = mix(h[seed] ^ U(0xD1B54A32D192ED03)) >> U(64 - KEY)  # anew: the hashes of chosen places are small ones
    return Spans(data, docs[doc_at], lo, hi, seed, key, span, lo - begin + offsets[doc_at])


def chunks(texts: Iterator[tuple[int, bytes]], k: int) -> Iterator[tuple[list[tuple[int, int, bytes]], int]]:
    """Numbered texts to lists of parts, with the bytes in them."""
    some: list[tuple[int, int, bytes]] = []
    size = 0
    for i, t in texts:
        for at in range(0, max(1, len(t) - k + 1), PART):
            some.append((i, at, t[at : at + PART + k - 1]))
            size += len(some[-1][2])
            if size >= CHUNK:
                yield some, size
                some, size = [], 0
    if some:
        yield some, size


def _texts(col: pa.Array, start: int = 0) -> Iterator[tuple[int, bytes]]:
    for i in range(0, len(col), 128):
        for j, t in enumerate(col.slice(i, 128).cast(pa.binary()).to_pylist()):
            yield start + i + j, t or b""


def _ids(col: pa.Array) -> np.ndarray:
    return col.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def _first(*sorted_columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before."""
    out = np.zeros(len(sorted_columns[0]), bool)
    out[:1] = True
    for c in sorted_columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _order(key: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Rows by key and then by the other columns; only rows of the same key are compared further."""
    order = np.argsort(key, kind="stable")
    tie = ~_first(key[order])
    tie[:-1] |= tie[1:]
    rows = order[tie]
    if len(rows):
        order[tie] = rows[np.lexsort((*(c[rows] for c in reversed(more)), key[rows]))]
    return order


def _cuts(sorted_column: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where each value begins and ends."""
    at = np.flatnonzero(np.append(_first(sorted_column), True)) if len(sorted_column) else []
    return zip(at, at[1:], strict=False)


def _least(group: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The smallest value of each row's group."""
    out = np.full(group[-1] + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(out, group, values)
    return out[group]


# What is sent is a row (bucket, bytes) for each task and range, not one for each record.


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length, byte by byte (all first bytes, all second ones and so on, as most differ little), compressed."""
    flat = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() if len(c) else b"" for c in columns)
    return np.array([len(columns[0]), len(flat)], "<u4").tobytes() + pa.compress(flat, codec="zstd", asbytes=True)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    n, size = np.frombuffer(blob, "<u4", 2).tolist()
    flat, at, out = np.frombuffer(pa.decompress(blob[8:], size, codec="zstd", asbytes=True), np.uint8), 0, []
    for kind in kinds:
        w = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(flat[at : at + n * w].reshape(w, n).T).view(kind).ravel())
        at += n * w
    return out


def _row(bucket: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([int(bucket)], pa.int64()), pa.array([blob], pa.binary())], ["bucket", "run"])


def answers(shards: int, ids: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Rows about documents, dealt by document to shards, which are numbered -1, -2 and so on; ids by what each adds to the one before."""
    shard = (mix(ids.astype(U)) % U(shards)).astype(np.int64)
    order = np.lexsort((ids, shard))
    for i, j in _cuts(shard[order]):
        w = order[i:j]
        yield -1 - int(shard[w[0]]), pack(np.diff(ids[w], prepend=0).astype("<i8"), *(c[w] for c in columns))


def gather(*kinds: str):
    """The answers of a shard to one row a document: (number, found)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(b, "<i8", *kinds) for b in pdf["run"]]
        ids = np.concatenate([np.cumsum(p[0]) for p in parts])
        columns = [np.concatenate([p[i + 1] for p in parts]) for i in range(len(kinds))]
        order = np.argsort(ids, kind="stable")
        ids, columns = ids[order], [c[order] for c in columns]
        cuts = list(_cuts(ids))
        out = pd.DataFrame({"number": ids[[i for i, _ in cuts]], "found": [b"".join(c[i:j].tobytes() for c in columns) for i, j in cuts]})
        release_memory()
        return out

    return run


def _columns(found: pa.Scalar, *kinds: str) -> list[np.ndarray]:
    """What gather has for a document."""
    data, at, out = found.as_buffer(), 0, []
    n = data.size // sum(np.dtype(k).itemsize for k in kinds)
    for kind in kinds:
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    return out


def _frame(rows: Iterator[tuple[int, bytes]]) -> pd.DataFrame:
    rows = list(rows)
    release_memory()
    return pd.DataFrame({"bucket": pd.Series([r[0] for r in rows], dtype="int64"), "run": [r[1] for r in rows]})


def _ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids in order, and the rank of each row's."""
    return np.unique(ids, return_inverse=True)


# The number of the bucket of seeds of very many spans.
HOT_BUCKET = -(1 << 62)


def _seeds(k: int, buckets: int):
    """Rows (id, text) to sorted runs of seeds; documents that share a seed with another of their run are told at once."""

    def flush(ids: np.ndarray, doc, key, span) -> Iterator[pa.RecordBatch]:
        distinct, rank = _ranked(ids)
        doc, key, span = rank[np.concatenate(doc)], np.concatenate(key), np.concatenate(span)
        order = _order(key, span)
        n_spans = np.bincount(np.cumsum(_first(key[order])) - 1, _first(key[order], span[order]))
        order = _order(key, doc)
        doc, key = doc[order], key[order]
        new = _first(key, doc)
        doc, key = doc[new], key[new]
        head = _first(key)
        group = np.cumsum(head) - 1
        shared = np.bincount(group) > 1
        told = shared[group]
        for row in answers(4 * buckets, distinct[doc[told]], key[told].astype("<u8")):
            yield _row(*row)
        doc, key, code = doc[head], key[head], (np.minimum(n_spans, 127).astype(np.uint8) | shared.astype(np.uint8) << np.uint8(7))
        bucket = (key * U(buckets) >> U(KEY)).astype(np.int64)
        for i, j in _cuts(bucket):
            some, where = np.unique(doc[i:j], return_inverse=True)
            ids_, seeds = (np.diff(c, prepend=c.dtype.type(0)) for c in (distinct[some], key[i:j]))  # sorted: by what each adds to the one before
            head_ = pack(ids_.astype("<i8"))
            yield _row(bucket[i], len(head_).to_bytes(4, "little") + head_ + pack(seeds.astype("<u8"), where.astype("<u4"), code[i:j]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, doc, key, span, size, base = [], [], [], [], 0, 0
        for batch in batches:
            ids.append(_ids(batch.column(0)))
            for parts, n in chunks(_texts(batch.column(1), base), k):
                if (s := spans(parts, k)) is not None:
                    doc.append(s.doc)
                    key.append(s.key)
                    span.append(s.span)
                size += n
                if size >= RUN and doc:
                    yield from flush(np.concatenate(ids), doc, key, span)
                    doc, key, span, size = [], [], [], 0
                    release_memory()
            base += batch.num_rows
        if doc:
            yield from flush(np.concatenate(ids), doc, key, span)
        release_memory()

    return run


def _shared_seeds(shards: int):
    """Merges the runs of a range: seeds that several documents have, told to those that don't know yet; and seeds of many spans."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["bucket"].iloc[0] < 0:
            return pdf[["bucket", "run"]]
        keys, ids, codes = [], [], []
        for blob in pdf["run"]:
            at = 4 + int.from_bytes(blob[:4], "little")
            (some,) = unpack(blob[4:at], "<i8")
            step, where, code = unpack(blob[at:], "<u8", "<u4", "u1")
            keys.append(np.cumsum(step.astype(U)))
            ids.append(np.cumsum(some)[where])
            codes.append(code)
        key, id_, code = map(np.concatenate, (keys, ids, codes))
        order = np.argsort(key, kind="stable")
        key, id_, code = key[order], id_[order], code[order]
        group = np.cumsum(_first(key)) - 1
        alone = code < 128
        several = (np.bincount(group, ~alone) > 0)[group] | (_least(group, id_) < -_least(group, ~id_) - 1)
        ask = alone & several
        n = np.bincount(group, code & 127)
        hot = np.flatnonzero(n >= HOT)
        rows = list(answers(shards, id_[ask], key[ask].astype("<u8")))
        if len(hot):
            rows.append((HOT_BUCKET, pack(key[_first(key)][hot].astype("<u8"), n[hot].astype("<i8"))))
        return _frame(rows)

    return run


#: Bytes of a suffix row before its text.
HEAD = 7


def suffixes(s: Spans, at: np.ndarray, k: int) -> np.ndarray:
    """The spans at some places as sortable rows of bytes: the seed's hash, the lengths from the seed on and before it, k bytes for what
    follows, and k - SEED for what stands before, backwards. Bytes beyond the lengths are 0."""
    x, y = (s.hi - s.seed)[at], (s.seed - s.lo)[at]
    rows = np.zeros((len(at), HEAD + 2 * k - SEED), np.uint8)
    rows[:, :5] = s.key[at].astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]
    rows[:, 5], rows[:, 6] = x, y
    if len(at):
        data = np.concatenate([np.zeros(k, np.uint8), s.data, np.zeros(k, np.uint8)])
        rows[:, HEAD : HEAD + k] = np.lib.stride_tricks.sliding_window_view(data, k)[s.seed[at] + k]
        rows[:, HEAD + k :] = np.lib.stride_tricks.sliding_window_view(data, k - SEED)[s.seed[at] + SEED][:, ::-1]
        rows[:, HEAD:][~_real(rows, k)[:, HEAD:]] = 0
    return rows


def _real(rows: np.ndarray, k: int) -> np.ndarray:
    """Which bytes of suffix rows count."""
    x, y = (np.arange(n) < np.arange(n + 1)[:, None] for n in (k, k - SEED))  # a row of flags for each length
    return np.concatenate([np.ones((len(rows), HEAD), bool), x[rows[:, 5]], y[rows[:, 6]]], 1)


def front_code(rows: np.ndarray, k: int) -> bytes:
    """Sorted, distinct suffix rows: the length of the prefix that each shares with the one before, and what follows of it."""
    column = np.zeros(len(rows), np.int64)
    column[1:] = (rows[1:] != rows[:-1]).argmax(1)
    shared = np.where(column < HEAD + k, column, column - k + rows[:, 5])  # of the bytes that count
    width = rows.shape[1]
    rest = rows[_real(rows, k) & (np.arange(width) >= np.arange(width + 1)[:, None])[column]].tobytes()
    sizes = pack(shared.astype(np.uint8), (HEAD + rows[:, 5].astype(np.int64) + rows[:, 6]).astype(np.uint8))
    return len(sizes).to_bytes(4, "little") + sizes + len(rest).to_bytes(4, "little") + pa.Codec("zstd", compression_level=6).compress(rest, asbytes=True)


def front_decode(data: bytes, start: int = 0) -> tuple[list[int], list[bytes]]:
    """The runs of front_code: common prefixes, and rows without the bytes that don't count."""
    at = start + 4 + int.from_bytes(data[start : start + 4], "little")
    shared, length = (c.tolist() for c in unpack(data[start + 4 : at], "u1", "u1"))
    rest = pa.decompress(data[at + 4 :], int.from_bytes(data[at : at + 4], "little"), codec="zstd", asbytes=True)
    out, last, at = [], b"", 0
    for h, n in zip(shared, length, strict=True):
        to = at + n - h
        last = last[:h] + rest[at:to]
        at = to
        out.append(last)
    return shared, out


def merge(runs: list[tuple[list[int], list[bytes]]]) -> tuple[list[int], list[int]]:
    """Merges sorted runs of (common prefix with the one before, string) by a loser tree: for each string in order, the number of its run and
    how far it agrees with the string before. No string is the beginning of another of its length or more, as lengths come first in them.

    `know[r]` is how far the head of run r agrees with the last string out, or in a loser's place with the winner that beat it. The head that
    agrees further comes first; only heads that agree equally far are compared, and from there on. No byte is compared twice."""
    n = len(runs)
    heads, place, ends = [r[1][0] for r in runs], [0] * n, [len(r[1]) for r in runs]
    know = [0] * n
    tree = [-1] * n  # losers; -1: no one came by yet
    for start in range(n):  # each run climbs until a place is free or it loses
        w, i = start, (start + n) >> 1
        while i:
            if tree[i] < 0:
                tree[i], w = w, -1
                break
            w, tree[i] = _play(w, tree[i], heads, know)
            i >>= 1
        if w >= 0:
            tree[0] = w
    w, out, agreed = tree[0], [], []
    while know[w] >= 0:
        out.append(w)
        agreed.append(know[w])
        shared, strings = runs[w]
        place[w] = p = place[w] + 1
        if p < ends[w]:
            heads[w] = strings[p]
            a = shared[p]
        else:
            a = -1
        i = (w + n) >> 1
        while i:  # a: how far w agrees with the last string out
            other = tree[i]
            b = know[other]
            if b > a:
                tree[i], know[w], w, a = w, a, other, b
            elif a == b and a >= 0:
                x, y = heads[w], heads[other]
                top = min(len(x), len(y))
                while a < top and x[a] == y[a]:
                    a += 1
                if a == top or x[a] < y[a]:  # all of them equal, or w is the smaller one
                    know[other], a = a, b
                else:
                    tree[i], know[w], w, a = w, a, other, b
            i >>= 1
        know[w] = a
    return out, agreed


def _play(a: int, b: int, heads: list[bytes], know: list[int]) -> tuple[int, int]:
    """Winner and loser of two heads at the start; the loser's `know` becomes how far the two agree."""
    x, y, i = heads[a], heads[b], 0
    n = min(len(x), len(y))
    while i < n and x[i] == y[i]:
        i += 1
    if i == n or x[i] < y[i]:
        know[b] = i
        return a, b
    know[a] = i
    return b, a


def _wanted(s: Spans, asked: np.ndarray) -> np.ndarray:
    """Which spans have a seed that their document is told of; asked holds each document's seeds."""
    out = np.zeros(len(s.key), bool)
    for i, j in _cuts(s.doc):
        (keys,) = _columns(asked[int(s.doc[i])], "<u8")
        out[i:j] = np.isin(s.key[i:j], keys)
    return out


def _runs(k: int, buckets: int, hot_keys: np.ndarray, base: int = 0xD6E8FEB86659FD93):
    """Rows (number, text, found) to sorted, front-coded runs of the suffixes of shared seeds, and of the strings of hot ones; spans and
    strings that a smaller document of the same run has are told at once."""

    def flush(ids: np.ndarray, got: list, hot: list) -> Iterator[pa.RecordBatch]:
        distinct, rank = _ranked(ids)
        if got:
            doc, key, name, rows = map(np.concatenate, zip(*got, strict=True))
            got.clear()
            doc = rank[doc]
            words = np.zeros((len(rows), -(-(rows.shape[1] - 5) // 8) * 8), np.uint8)
            words[:, : rows.shape[1] - 5] = rows[:, 5:]
            words = words.view(">u8")
            order = _order(key, *words.T, doc)
            doc, key, name, rows, words = (c[order] for c in (doc, key, name, rows, words))
            new = _first(key)
            same = np.flatnonzero(~new)
            new[same] = (words[same] != words[same - 1]).any(1)
            covered = ~new & (doc > doc[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))])
            yield from (_row(*r) for r in _found(4 * buckets, distinct[doc[covered]], name[covered]))
            doc, key, name, rows = (c[new] for c in (doc, key, name, rows))
            for i, j in _cuts((key * U(buckets) >> U(KEY)).astype(np.int64)):
                least = int(distinct[doc[i:j]].min())
                who = pack((distinct[doc[i:j]].astype(U) - U(least & (1 << 64) - 1)).astype("<u8"), name[i:j].astype("<i8"))
                yield _row(int(key[i]) * buckets >> KEY, least.to_bytes(8, "little", signed=True) + len(who).to_bytes(4, "little") + who + front_code(rows[i:j], k))
        if hot:
            doc, one, two, name, nth = map(np.concatenate, zip(*hot, strict=True))
            doc = rank[doc]
            order = _order(one, two, doc, name)
            doc, one, two, name, nth = (c[order] for c in (doc, one, two, name, nth))
            new = _first(one, two)
            covered = doc > doc[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
            yield from (_row(*r) for r in _found(4 * buckets, distinct[doc[covered]], name[covered], nth[covered], nth[covered]))
            new = ~covered & _first(one, two, name)  # the smallest document may have the string in several spans
            columns = [c[new].astype(t) for c, t in ((one, "<u8"), (two, "<u8"), (distinct[doc], "<i8"), (name, "<i8"), (nth, "<i2"))]
            one = one[new]
            for i, j in _cuts(((one >> U(32)) * U(buckets) >> U(32)).astype(np.int64)):
                yield _row(buckets + (int(one[i] >> U(32)) * buckets >> 32), pack(*(c[i:j] for c in columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, got, hot, size, first = [], [], [], 0, 0
        for batch in batches:
            ids.append(_ids(batch.column(0)))
            asked = batch.column(2)
            for parts, n in chunks(_texts(batch.column(1)), k):
                if (s := spans(parts, k)) is None:
                    continue
                at = np.flatnonzero(_wanted(s, asked))
                burning = np.isin(s.key[at], hot_keys)
                name = s.name
                if burning.any():
                    b = at[burning]
                    count = (s.hi - s.lo)[b] - k + 1
                    row = np.repeat(b, count)
                    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                    start = s.lo[row] + nth
                    one, two = (Ranges(s.data[:n], x).hash(start, start + k) for x in (BASE, base))
                    hot.append((first + s.doc[row], one, two, name[row], nth))
                    size += 40 * len(row)
                at = at[~burning]
                if len(at):
                    got.append((first + s.doc[at], s.key[at], name[at], suffixes(s, at, k)))
                    size += got[-1][3].nbytes
                if size >= 2 * RUN:
                    yield from flush(np.concatenate(ids), got, hot)
                    got, hot, size = [], [], 0
                    release_memory()
            first += batch.num_rows
        if got or hot:
            yield from flush(np.concatenate(ids), got, hot)
        release_memory()

    return run


def _found(shards: int, ids: np.ndarray, names: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> Iterator[tuple[int, bytes]]:
    """Answers that strings first to last of a span are covered; all of them if not given."""
    first, last = (np.full(len(ids), v) if c is None else c for c, v in ((first, 0), (last, -1)))
    return answers(shards, ids, names.astype("<i8"), first.astype("<i2"), last.astype("<i2"))


def _covered(k: int, buckets: int):
    """Merges the runs of a range: which spans, and which strings of those that are left, a smaller document has too."""

    def strings(pdf: pd.DataFrame) -> Iterator[tuple[int, bytes]]:
        one, two, id_, name, nth = (np.concatenate(c) for c in zip(*(unpack(b, "<u8", "<u8", "<i8", "<i8", "<i2") for b in pdf["run"]), strict=True))
        order = _order(one, two)
        one, two, id_, name, nth = (c[order] for c in (one, two, id_, name, nth))
        hit = id_ > _least(np.cumsum(_first(one, two)) - 1, id_)
        yield from _found(4 * buckets, id_[hit], name[hit], nth[hit], nth[hit])

    def spans_(pdf: pd.DataFrame) -> Iterator[tuple[int, bytes]]:
        ids, names, runs = [], [], []
        for blob in pdf["run"]:
            at = 12 + int.from_bytes(blob[8:12], "little")
            more, n = unpack(blob[12:at], "<u8", "<i8")
            ids.append((more + np.frombuffer(blob, "<u8", 1)).astype(np.int64))
            names.append(n)
            runs.append(front_decode(blob, at))
        at, know = (np.array(c, np.int64) for c in merge(runs))
        # the strings of a run come in order, so a run's n-th mention is its n-th string
        turn = np.argsort(at, kind="stable")
        place = np.empty(len(at), np.int64)
        place[turn] = np.arange(len(at))  # runs follow one another in the joined columns too
        id_, name = np.concatenate(ids)[place], np.concatenate(names)[place]
        texts = [t for r in runs for t in r[1]]
        size = np.fromiter(map(len, texts), np.int64, len(texts))[place]
        same = know == size  # agrees with the one before in all of its bytes, and its length stands in them
        klass = np.cumsum(~same) - 1
        least = _least(klass, id_)
        gone = id_ > least
        yield from _found(4 * buckets, id_[gone], name[gone])
        # Of each span the smallest document stays; spans of one seed that several documents have are compared string by string.
        lead = np.flatnonzero(~same)
        group = np.cumsum(know[lead] < 5) - 1  # 5 bytes of a row are the seed's hash
        low = least[lead]
        several = _least(group, low) < -_least(group, ~low) - 1
        lead, group, low = lead[several], group[several], low[several]
        bounds = np.flatnonzero(np.append(_first(group), True)) if len(lead) else np.zeros(1, np.int64)
        total = np.concatenate([[0], np.cumsum(size[lead])])
        i = 0
        while i < len(bounds) - 1:
            j = max(i + 1, int(np.searchsorted(total[bounds], total[bounds[i]] + CHUNK, "right")) - 1)
            some = lead[bounds[i] : bounds[j]]
            yield from _compare(k, 4 * buckets, [texts[place[x]] for x in some], least[some], name[some])
            i = j

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = pdf["bucket"].iloc[0]
        return pdf[["bucket", "run"]] if bucket < 0 else _frame(strings(pdf) if bucket >= buckets else spans_(pdf))

    return run


def _compare(k: int, shards: int, rows: list[bytes], id_: np.ndarray, name: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The strings of some spans, compared by their bytes."""
    data = []
    for r in rows:
        x = HEAD + r[5]
        data.append(r[x:][::-1] + r[HEAD:x])
    size = np.fromiter(map(len, data), np.int64, len(data))
    n = size - k + 1
    row = np.repeat(np.arange(len(data)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    place = np.repeat(np.cumsum(size) - size, n) + nth
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(b"".join(data), np.uint8), k)[place]
    _, which = np.unique(np.ascontiguousarray(view).view(f"V{k}").ravel(), return_inverse=True)
    least = np.full(which.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, which, id_[row])
    hit = np.flatnonzero(id_[row] > least[which])
    if len(hit):
        start = np.flatnonzero(np.append(True, (np.diff(hit) != 1) | (np.diff(row[hit]) != 0)))
        stop = np.append(start[1:], len(hit)) - 1
        yield from _found(shards, id_[row[hit[start]]], name[row[hit[start]]], nth[hit[start]], nth[hit[stop]])


def _hot_keys(rows: DataFrame) -> np.ndarray:
    """Seeds of very many spans. If there are too many to send to all tasks, only those of yet more spans; the others meet in one task each,
    with the same result."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                key, n = unpack(blob, "<u8", "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n)], ["key", "n"])

    each = rows.select("run").mapInArrow(flat, "key long, n long")
    sizes = each.groupBy(F.floor(F.log2("n")).alias("log")).count().orderBy(F.desc("log")).collect()
    total, least = 0, None
    for r in sizes:
        total += r["count"]
        if total * 16 > BROADCAST_BYTES:
            break
        least = 1 << r.log
    return np.array(sorted(r.key for r in each.where(F.col("n") >= least).select("key").collect()), U) if least else np.zeros(0, U)


def remove_repeats(docs: DataFrame, *, k: int = 50, keep: str | None = "bytes", carry: list[str] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document without the bytes of every k-byte string that also starts in a document with a smaller id.

    Texts are UTF-8 bytes, null is empty; strings don't cross documents and are judged on the input. Returns a row
    per row: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept (the bytes that stay; with
    keep="text" as text without characters of which only some bytes stay; with None null) and row (a struct of the
    columns to carry along). Ids are whole numbers. Rows
    that repeat an id are not smaller than each other, so they keep what only they share; a null id is smaller than
    all others. An empty table gives an empty result; other columns are not read.
    """
    if not SEED < k <= 128:
        raise ValueError(f"k must be over {SEED} and at most 128")
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    rows = pick(docs, id=id_col, text=text_col, **{f"c{i}": c for i, c in enumerate(carry)})
    if not isinstance(rows.schema["id"].dataType, IntegralType):
        raise TypeError("ids must be whole numbers")
    rows = rows.select("id", "text", F.struct(*(F.col(f"c{i}").alias(c) for i, c in enumerate(carry))).alias("row")) if carry else rows.withColumn("row", F.lit(None).cast("int"))
    kind, row_kind = (rows.schema[c].dataType.simpleString() for c in ("id", "row"))
    size, n_docs = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    buckets = max(8, min(1 << 20, -(-size // BUCKET)))
    numbered = rows.withColumn("number", F.coalesce(F.col("id").cast("long"), F.lit(NULL_ID)))
    sent = "bucket long, run binary"

    seeds = rows.select("id", "text").mapInArrow(_seeds(k, buckets), sent)
    seeds = scratch.keep(seeds.groupBy("bucket").applyInPandas(_shared_seeds(4 * buckets), sent))
    hot = _hot_keys(seeds.where(F.col("bucket") == HOT_BUCKET))
    held = spark.sparkContext.broadcast(hot) if len(hot) else None

    asked = seeds.where(F.col("bucket") > HOT_BUCKET).groupBy("bucket").applyInPandas(gather("<u8"), "number long, found binary")
    some = numbered.select("number", "text").join(asked, "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _runs(k, buckets, held.value if held else np.zeros(0, U))(batches)

    found = scratch.keep(some.select("number", "text", "found").mapInArrow(run, sent).groupBy("bucket").applyInPandas(_covered(k, buckets), sent))
    found = scratch.keep(found.groupBy("bucket").applyInPandas(gather("<i8", "<i2", "<i2"), "number long, found binary"))
    touched = maybe_broadcast(found.select("number"), n_docs, 16)

    kept_kind = "string" if keep == "text" else "binary"
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept {kept_kind}, row {row_kind}"
    changed = numbered.join(touched, "number", "left_semi").join(found, "number").select("id", "text", "found", "row").mapInArrow(_cut(k, keep), schema)
    same = numbered.join(touched, "number", "left_anti")
    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    text = F.coalesce("text", F.lit(""))
    same = same.select("id", n.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"), (F.encode(text, "UTF-8") if keep == "bytes" else text if keep else F.lit(None).cast("binary")).alias("kept"), "row")
    return changed.unionByName(same).withColumnRenamed("id", id_col)


def _cut(k: int, keep: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            found = batch.column(2)
            texts, marks = {}, {}
            out: list[list] = [[], [], [], [], []]
            done = 0

            def finish(upto: int, texts=texts, marks=marks, out=out) -> None:
                nonlocal done
                for i in range(done, upto):
                    text = texts.pop(i)
                    gone = np.cumsum(marks.pop(i)[:-1]) > 0
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    n_spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                    for to, v in zip(out, (len(text), len(text) - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), kept if keep == "bytes" else kept.decode("utf-8", "ignore") if keep else None), strict=True):
                        to.append(v)
                done = upto

            def take(batch=batch, texts=texts, marks=marks) -> Iterator[tuple[int, bytes]]:
                for i, t in _texts(batch.column(1)):
                    texts[i], marks[i] = t, np.zeros(len(t) + 1, np.int64)
                    yield i, t

            for parts, _ in chunks(take(), k):
                if (s := spans(parts, k)) is not None:
                    own = s.name
                    bounds = np.flatnonzero(np.append(_first(s.doc), True))
                    for i, j in zip(bounds, bounds[1:], strict=False):
                        d = int(s.doc[i])
                        names, first, last = _columns(found[d], "<i8", "<i2", "<i2")
                        order = np.argsort(names, kind="stable")
                        names, first, last = names[order], first[order].astype(np.int64), last[order].astype(np.int64)
                        a, b = np.searchsorted(names, own[i:j]), np.searchsorted(names, own[i:j], "right")
                        n = b - a
                        span = np.repeat(np.arange(i, j), n)
                        at = np.repeat(a, n) + np.arange(len(span)) - np.repeat(np.cumsum(n) - n, n)
                        start = s.offset[span] + first[at]
                        stop = s.offset[span] + np.where(last[at] < 0, (s.hi - s.lo)[span], last[at] + k)
                        np.add.at(marks[d], start, 1)
                        np.add.at(marks[d], stop, -1)
                finish(parts[-1][0])
            finish(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string() if keep == "text" else pa.binary()), strict=True)), batch.column(3)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "row"])
        release_memory()

    return run
