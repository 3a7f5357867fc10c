"""Byte-level BPE with the tokenizers library: encoding and decoding over Arrow batches.

A text is cut at its single spaces. Where both neighbours of a space are no white space, a pre-token always
begins at that space, so each piece can be encoded by itself and its ids kept for later texts. Texts are cut before single line
breaks too, and marks at the end of a piece are encoded apart, if the file's pre-tokenizer turns out to cut there (see Codec).
Any other text, and one with an added token of the file, goes through the library as a whole. Ids are the same either way.
Arrow cuts the texts and finds their different pieces, so that each piece is looked up once for many texts.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import pick

#: Pieces that a worker keeps at most; when full, it starts anew.
CACHE = 1_500_000
#: Where one of these ends a part, its ids are those of the letters and digits before and those of the marks.
MARKS = "!#$%&*,.:;?"
#: Bytes of texts that are handled at once; a text is never cut.
CHUNK = 1 << 22


def byte_chars() -> dict[int, str]:
    """The character that stands for each byte: itself if printable in Latin-1, else the next one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


def tiktoken_to_json(data: bytes, pattern: str) -> str:
    """A tokenizers file from tiktoken ranks: each way to split a token into two tokens is a merge, in order of rank."""
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}
    chars = byte_chars()
    text = {t: "".join(chars[b] for b in t) for t in ranks}
    merges = []
    for t in sorted(ranks, key=ranks.get):
        merges += [[text[t[:i]], text[t[i:]]] for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    split = {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": True, "vocab": {text[t]: r for t, r in ranks.items()}, "merges": merges}
    return json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [split, level]}, "post_processor": None, "decoder": None, "model": model})


class Codec:
    """One vocabulary in one Python worker."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(spec)
        self.plain = Tokenizer(self.whole.model)  # finds no added tokens
        for part in ("normalizer", "pre_tokenizer"):
            if getattr(self.whole, part) is not None:
                setattr(self.plain, part, getattr(self.whole, part))
        own = self.whole.normalizer is None
        self.lines = own and self._cuts(" a", "\n", "b", ".", "\n", ".", "\n", "B", "1", "\n", "1", " ,", "\n", "é")
        self.marks = own and all(self._cuts(" " + x, m * n) for x in "aZé½1" for m in MARKS for n in (1, 2))
        chars = byte_chars()
        self.to_char = {b: ord(c) for b, c in chars.items()}
        back = {c: b for b, c in chars.items()}
        vocab = self.whole.get_vocab(with_added_tokens=False)
        self.bytes_of = [b""] * (max(vocab.values(), default=-1) + 1)
        for t, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
        added = self.whole.get_added_tokens_decoder()
        self.added = "|".join(re.escape(t.content) for t in added.values())
        for i, t in added.items():
            self.bytes_of += [b""] * (i + 1 - len(self.bytes_of))
            self.bytes_of[i] = t.content.encode()
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.decimal = [str(i) for i in range(len(self.bytes_of))]
        self.pieces: dict[str, bytes] = {}
        self.ends: dict[str, bytes] = {}

    def _learn(self, parts: list[str]) -> None:
        """Keeps the ids of each part, after its space. Parts with marks at their end come last, as the rest of each may be known by then."""
        cores = [p.rstrip(MARKS) for p in parts] if self.marks else parts
        self._encode([p for p, c in zip(parts, cores, strict=True) if len(c) == len(p)])
        left = []
        for p, c in zip(parts, cores, strict=True):
            if len(c) < len(p):
                ids = self.pieces.get(c) if c and c[-1] < "\u0250" and c[-1].isalnum() else None
                if ids is None:
                    left.append(p)
                else:
                    self.pieces[p] = ids + self._mark(p[len(c) :])
        self._encode(left)

    def _encode(self, parts: list[str]) -> None:
        """Many parts are encoded as one text and cut by their bytes."""
        for i in range(0, len(parts), 2048):
            some = [p if self.lines and p[0] == "\n" else " " + p for p in parts[i : i + 2048]]
            ids = np.array(self.plain.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum([len(p.encode()) for p in some])
            at = [0, *(np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1).tolist()]
            raw = ids.tobytes()
            self.pieces.update((p, raw[4 * j : 4 * k]) for p, j, k in zip(parts[i : i + 2048], at, at[1:], strict=False))

    def _mark(self, text: str) -> bytes:
        if text not in self.ends:
            self.ends[text] = np.array(self.plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.ends[text]

    def _cuts(self, *parts: str) -> bool:
        """Whether the pre-tokens of a text are just these parts."""
        got = self.plain.pre_tokenizer.pre_tokenize_str("".join(parts)) if self.plain.pre_tokenizer else []
        return [x for _, x in got] == [(sum(map(len, parts[:i])), sum(map(len, parts[: i + 1]))) for i in range(len(parts))]

    def encode_many(self, some: pa.Array | list[str]) -> list[bytes]:
        """The ids of each text, none null, as little-endian unsigned 32-bit integers."""
        some = pa.array(some, pa.string()) if isinstance(some, list) else some
        parts = pc.split_pattern(pc.replace_substring(some, "\n", " \n") if self.lines else some, " ")
        values, bounds = parts.flatten(), parts.offsets.to_numpy()
        bounds = bounds - bounds[0]
        rest = np.ones(len(values), bool)
        rest[bounds[:-1]] = False
        words = values.filter(pa.array(rest)).dictionary_encode()
        known, at = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
        until = bounds[1:] - np.arange(1, len(some) + 1)  # words up to the end of each text

        if len(self.pieces) > CACHE:
            self.pieces.clear()
        found = list(map(self.pieces.get, known))
        new = [j for j, x in enumerate(found) if x is None]
        bad = {j for j in new if not (p := known[j].removeprefix("\n") if self.lines else known[j]) or p[0].isspace() or p[-1].isspace()}
        self._learn([known[j] for j in new if j not in bad])
        for j in new:
            found[j] = b"" if j in bad else self.pieces[known[j]]

        whole = pc.match_substring_regex(some, self.added).to_numpy(zero_copy_only=False) if self.added else np.zeros(len(some), bool)
        if bad:
            whole[np.searchsorted(until, np.flatnonzero(np.isin(at, list(bad))), "right")] = True
        heads = values.take(pa.array(bounds[:-1])).to_pylist()
        whole = [w or f[-1:].isspace() for w, f in zip(whole.tolist(), heads, strict=True)]
        heads = [some[i].as_py() if w else f for i, (w, f) in enumerate(zip(whole, heads, strict=True))]
        heads = [np.array(h.ids, "<u4").tobytes() for h in self.whole.encode_batch_fast(heads, add_special_tokens=False)]

        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts, many = np.cumsum(sizes) - sizes, sizes[at]
        ends = np.cumsum(many)
        from_ = np.repeat(starts[at] - ends + many, many)
        from_ += np.arange(len(from_))
        raw = np.frombuffer(b"".join(found), "<u4")[from_].tobytes()
        cuts = (4 * np.append(0, ends)[np.append(0, until)]).tolist()
        return [h if w else h + raw[i:j] for h, w, i, j in zip(heads, whole, cuts, cuts[1:], strict=False)]

    def encode(self, text: str) -> bytes:
        return self.encode_many(pa.array([text], pa.string()))[0]

    def encode_whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of all ids; a character that several ids share comes together again here."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def offsets(self, ids: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one character of each id's bytes; an id inside a split character gets that whole character."""
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        first_byte = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        chars = np.concatenate([[0], np.cumsum(first_byte)])  # characters begun before each byte
        inside = np.append(~first_byte, False)
        return chars[starts] - inside[starts], chars[ends]


_CODECS: dict[str, Codec] = {}


def codec(spec: str) -> Codec:
    """The worker's own codec: made once, used by all its tasks."""
    key = hashlib.md5(spec.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(spec)
    return _CODECS[key]


def encoded(c: Codec, col: pa.Array) -> Iterator[bytes]:
    """The ids of each text of a column, a few texts at a time in memory; null is empty."""
    col = col.fill_null("")
    ends, i = np.cumsum(pc.binary_length(col).to_numpy()), 0
    while i < len(col):
        k = max(i + 1, int(np.searchsorted(ends, CHUNK + (ends[i - 1] if i else 0), "right")))
        yield from c.encode_many(col.slice(i, k - i))
        i = k


def load_spec(path: str, pattern: str | None = None) -> str:
    """A tokenizers file, or one made from a file of tiktoken ranks."""
    with open(path, "rb") as f:
        data = f.read()
    return tiktoken_to_json(data, pattern) if path.endswith(".tiktoken") else data.decode()


def encode_decode(docs: DataFrame, path: str, pattern: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """Encodes each text and decodes its ids again.

    One row per input row: id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256. With full=True
    also ids, starts and ends (character offsets of each id) and decoded. Null and empty texts have no ids; repeated
    rows give repeated rows; an empty table gives an empty result; columns other than the two are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(load_spec(path, pattern))
    rows = pick(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, starts array<long>, ends array<long>, decoded binary" if full else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(held.value)
        for batch in batches:
            n, a, b, more = [], [], [], ([], [], [], [])
            for got in encoded(c, batch.column(1)):
                ids = np.frombuffer(got, "<u4")
                raw = c.decode(ids)
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(c.decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                b.append(hashlib.sha256(raw).hexdigest())
                if full:
                    start, end = c.offsets(ids, raw)
                    for to, v in zip(more, (ids.astype(np.int64), start, end, raw), strict=True):
                        to.append(v)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if full:
                cols += [pa.array(list(v), pa.list_(pa.int64())) for v in more[:3]] + [pa.array(more[3], pa.binary())]
                names += ["ids", "starts", "ends", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def token_counts(docs: DataFrame, path: str, pattern: str | None = None, *, carry: list[str] = (), text_col: str = "text") -> DataFrame:
    """The number of tokens of each text, n_tokens, after the columns to carry along; the text itself only if it is one of them."""
    held = docs.sparkSession.sparkContext.broadcast(load_spec(path, pattern))
    rows = pick(docs, **{f"c{i}": c for i, c in enumerate(carry)}, text=text_col)
    schema = "".join(f"c{i} {rows.schema[f'c{i}'].dataType.simpleString()}, " for i in range(len(carry))) + "n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(held.value)
        for batch in batches:
            *first, text = batch.columns
            yield pa.RecordBatch.from_arrays([*first, pa.array([len(x) // 4 for x in encoded(c, text)], pa.int64())], [*(f"c{i}" for i in range(len(first))), "n_tokens"])

    return rows.mapInArrow(run, schema).toDF(*carry, "n_tokens")
