"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are of documents. Counts over all documents to learn from show which words and word beginnings come with the
label; in toxic documents those words are the toxic tokens, and a bounded sample of lines with such labels
trains the field. Its states are toxic and plain. A token's features are its word, beginnings and ending; transitions
link a token with the one before it in its line. Forward-backward marginals of a document's tokens are summed up in
a few figures, and a logistic function of these, fitted on a bounded sample, is its score.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import batched, chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, maybe_broadcast, pick, release_memory

#: Bounds of the labelled rows that are learned from: lines with and without a mark, and documents of each label, about, from which the
#: lines come.
LINES, DOCS = 3000, 2500
#: Feature slots, words in a sequence at most (a longer line goes on in the next sequence), words a worker keeps, tokens looked up at once.
SLOTS, LENGTH, CACHE, PIECE = 1 << 18, 128, 250_000, 50_000
#: Toxic documents that must have a feature, and the share of its documents that must be toxic.
LEAST, SHARE = 4, 0.9
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_TOKEN = re.compile(r"[^ \t\n\x0b\x0c\r]+")


def word_of(token: str) -> str:
    low = token.lower()
    return low if low and low[0].isalnum() and low[-1].isalnum() else _EDGE.sub("", low)


def features(word: str) -> list[str]:
    """The word, its beginnings of 3 to 6 characters and its ending of 3."""
    if not word:
        return []
    return ["w=" + word] + [f"p{k}={word[:k]}" for k in (3, 4, 5, 6) if len(word) > k] + ["s=" + word[-3:]] * (len(word) > 3)


#: A checksum goes on from that of a feature's name: crc32(b"w=" + x) is crc32(x, crc32(b"w=")).
_WORD, _P3, _P4, _P5, _P6, _ENDING = (crc32(name) for name in (b"w=", b"p3=", b"p4=", b"p5=", b"p6=", b"s="))


def slots(word: str) -> list[int]:
    """crc32 of each of the features, as a slot."""
    if not word:
        return []
    size, out = len(word), [crc32(word.encode(), _WORD) % SLOTS]
    if size > 3:
        out.append(crc32(word[:3].encode(), _P3) % SLOTS)
    if size > 4:
        out.append(crc32(word[:4].encode(), _P4) % SLOTS)
    if size > 5:
        out.append(crc32(word[:5].encode(), _P5) % SLOTS)
    if size > 6:
        out.append(crc32(word[:6].encode(), _P6) % SLOTS)
    if size > 3:
        out.append(crc32(word[-3:].encode(), _ENDING) % SLOTS)
    return out


def held_out(id_: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Field:
    """Weights of the two-state field, as log odds of toxic against plain, and of the document score."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(SLOTS, np.float32))
    bias: float = -3.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))  # from, to: plain 0, toxic 1
    score: np.ndarray = field(default_factory=lambda: np.array([-4.0, 4.0, 1.0]))


def _messages(e: np.ndarray, n: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward log odds with, and backward log odds without, each token's own emission; rows are sequences, longest first."""
    t = np.exp(trans)
    a, b = np.zeros_like(e), np.zeros_like(e)
    live = [int(x) for x in np.searchsorted(-n, -np.arange(1, e.shape[1] + 1), "right")]
    if e.shape[1]:
        a[:, 0] = e[:, 0]
    for i in range(1, e.shape[1]):
        m = live[i]
        x = np.exp(np.clip(a[:m, i - 1], -30, 30))
        a[:m, i] = e[:m, i] + np.log((x * t[1, 1] + t[0, 1]) / (x * t[1, 0] + t[0, 0]))
    for i in range(e.shape[1] - 2, -1, -1):
        m = live[i + 1]
        y = np.exp(np.clip(e[:m, i + 1] + b[:m, i + 1], -30, 30))
        b[:m, i] = np.log((y * t[1, 1] + t[1, 0]) / (y * t[0, 1] + t[0, 0]))
    return a, b


def marginals(emissions: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(toxic) of each token; emissions are those of all sequences one after the other."""
    out = np.zeros(len(emissions))
    order = np.argsort(-lengths, kind="stable")
    starts = np.cumsum(lengths) - lengths
    for i in range(0, len(order), 4096):
        who = order[i : i + 4096]
        n = lengths[who]
        mask = np.arange(n[0] if len(n) else 0) < n[:, None]
        at = (starts[who][:, None] + np.arange(mask.shape[1]))[mask]
        e = np.zeros(mask.shape)
        e[mask] = emissions[at]
        a, b = _messages(e, n, trans)
        out[at] = 1 / (1 + np.exp(-np.clip((a + b)[mask], -30, 30)))
    return out


def train_field(lines: list[tuple[list[str], list[int]]], rounds: int = 6, rate: float = 0.4, seed: int = 1) -> Field:
    """Maximum likelihood by AdaGrad over batches of labelled lines (words, tags)."""
    f, rng = Field(), np.random.default_rng(seed)
    g_w, g_b, g_t = np.full(SLOTS, 1e-2), 1e-2, np.full((2, 2), 1e-2)
    seqs = [([slots(w) for w in ws[:LENGTH]], np.array(ts[:LENGTH], float)) for ws, ts in lines if ws]
    for _ in range(rounds):
        order = rng.permutation(len(seqs))
        for i in range(0, len(order), 256):
            some = sorted((seqs[j] for j in order[i : i + 256]), key=lambda s: -len(s[0]))
            n = np.array([len(s[0]) for s in some])
            mask = np.arange(n[0]) < n[:, None]
            per = [x for s in some for x in s[0]]
            flat = np.fromiter((x for p in per for x in p), np.int64)
            owner = np.repeat(np.arange(len(per)), [len(p) for p in per])
            e, y = np.zeros(mask.shape), np.zeros(mask.shape)
            e[mask] = np.bincount(owner, f.weights[flat], len(per)) + f.bias
            y[mask] = np.concatenate([s[1] for s in some])
            a, b = _messages(e, n, f.trans)
            p = 1 / (1 + np.exp(-np.clip(a + b, -30, 30)))
            diff = ((y - p) * mask)[mask]
            pair = mask[:, 1:]
            # P(states of two neighbours), by the forward odds of the first and what follows for the second
            left = np.stack([np.zeros_like(a[:, :-1]), np.clip(a[:, :-1], -30, 30)], -1)
            right = np.stack([np.zeros_like(a[:, 1:]), np.clip(e[:, 1:] + b[:, 1:], -30, 30)], -1)
            both = np.exp(left[..., :, None] + f.trans + right[..., None, :])
            both /= both.sum((-1, -2), keepdims=True)
            seen = np.stack([1 - y[:, :-1], y[:, :-1]], -1)[..., :, None] * np.stack([1 - y[:, 1:], y[:, 1:]], -1)[..., None, :]
            d_t = ((seen - both) * pair[..., None, None]).sum((0, 1)) - 0.1 * f.trans
            d_w = np.bincount(flat, diff[owner], SLOTS) - 1e-3 * f.weights * (np.bincount(flat, minlength=SLOTS) > 0)
            g_w += d_w**2
            g_t += d_t**2
            g_b += diff.sum() ** 2
            f.weights = (f.weights + rate * d_w / np.sqrt(g_w)).astype(np.float32)
            f.trans = f.trans + rate * d_t / np.sqrt(g_t)
            f.bias += rate * diff.sum() / np.sqrt(g_b)
    f.trans -= f.trans[0, 0]
    return f


def fit_score(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - 0.05 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Tagger:
    """The field in a worker; keeps the emission of each token that it has met."""

    def __init__(self, f: Field):
        self.f, self.known = f, {}
        self.weights = np.append(f.weights, np.float32(0))  # the last is that of no feature

    def _learn(self, tokens: list[str]) -> None:
        """Keeps the emissions of new tokens, all at once."""
        per = [slots(word_of(t)) for t in tokens]
        have = np.array([len(p) for p in per], np.int64)
        at = np.full((len(per), have.max(initial=0)), SLOTS)
        at[np.arange(at.shape[1]) < have[:, None]] = np.fromiter(chain.from_iterable(per), np.int64, have.sum())
        self.known.update(zip(tokens, (self.weights[at].sum(1) + self.f.bias).tolist(), strict=True))

    def _emissions(self, tokens: Iterable[str]) -> Iterator[float]:
        for piece in batched(tokens, PIECE):
            new = [t for t in set(piece) if t not in self.known]
            if len(self.known) + len(new) > CACHE:
                self.known.clear()
                new = list(set(piece))
            self._learn(new)
            yield from map(self.known.__getitem__, piece)

    def tag(self, texts: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
        """The lines of each text, each with its tokens, and P(toxic) of all its tokens in order."""
        lines = [[x.split() for x in t.split("\n")] for t in texts]
        e = np.fromiter(self._emissions(w for ls in lines for x in ls for w in x), float)
        n = np.array([min(LENGTH, len(x) - i) for ls in lines for x in ls for i in range(0, len(x), LENGTH)], np.int64)
        p, at = marginals(e, n, self.f.trans), 0
        for ls in lines:
            size = sum(map(len, ls))
            yield ls, p[at : at + size]
            at += size


def figures(p: np.ndarray) -> np.ndarray:
    """What a document's score is made of: 1, the largest marginal, and the log of the sum of those over a half. The small
    marginals of a long text don't add up."""
    return np.array([1.0, p.max(), np.log1p(p[p > 0.5].sum())]) if len(p) else np.array([1.0, 0.0, 0.0])


_TAGGERS: dict = {}


def _tagger(key: str, f: Field) -> Tagger:
    if key not in _TAGGERS:
        _TAGGERS.clear()
        _TAGGERS[key] = Tagger(f)
    return _TAGGERS[key]


def _tagged(rows: DataFrame, f: Field, make, schema: list[tuple[str, str]]) -> DataFrame:
    """make(text, lines, marginals, field) gives each row's values after the columns before the text, the last."""
    import uuid

    held, key = rows.sparkSession.sparkContext.broadcast(f), uuid.uuid4().hex
    names = [n for n, _ in schema]
    kinds = {"double": pa.float64(), "int": pa.int32(), "array<double>": pa.list_(pa.float64()), "array<struct<start:int,end:int,p:double>>": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _tagger(key, held.value)
        for batch in batches:
            *first, texts = batch.columns
            for i in range(0, batch.num_rows, 256):
                some = [t or "" for t in texts.slice(i, 256).to_pylist()]
                got = [make(t, ls, p, held.value) for t, (ls, p) in zip(some, tagger.tag(some), strict=True)]
                values = [pa.array(list(v), kinds[k]) for v, (_, k) in zip(zip(*got, strict=True), schema[len(first) :], strict=True)]
                yield pa.RecordBatch.from_arrays([c.slice(i, 256) for c in first] + values, names)
        release_memory()

    return rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in schema))


def _spans(text: str, p: np.ndarray, least: float) -> list[dict]:
    """Offsets of runs of tokens whose marginal is at least `least`."""
    if not len(p) or p.max() < least:
        return []
    out: list[dict] = []
    last = -2
    # str.split() and this pattern differ only in rare white space; then the tokens are found one by one.
    found = [m.span() for m in _TOKEN.finditer(text)]
    if len(found) != len(p):
        found, at = [], 0
        for w in text.split():
            at = text.index(w, at)
            found.append((at, at + len(w)))
            at += len(w)
    for i in np.flatnonzero(p >= least).tolist():
        if i == last + 1:
            out[-1]["end"], out[-1]["p"] = found[i][1], max(out[-1]["p"], float(p[i]))
        else:
            out.append({"start": found[i][0], "end": found[i][1], "p": float(p[i])})
        last = i
    return out


def _features(rows: DataFrame) -> DataFrame:
    """(mark, n, bad): words and beginnings of words of the texts, with the documents and the toxic ones that have each word."""
    tokens = rows.select("y", F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("t"))
    words = tokens.groupBy("t").agg(F.count("*").alias("n"), F.sum("y").alias("bad"))
    words = words.withColumn("t", F.regexp_replace("t", r"(?U)^[\W_]+|[\W_]+$", "")).where("t != ''")
    begin = lambda k: F.when(F.length("t") > k, F.concat(F.lit(f"p{k}="), F.substring("t", 1, k)))
    return words.select(F.explode(F.array(F.concat(F.lit("w="), "t"), *map(begin, (3, 4, 5, 6)))).alias("mark"), "n", "bad").where("mark IS NOT NULL")


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Field:
    """Learns from the labelled documents that aren't held out.

    Counts are of all of them. The score is fitted on about DOCS documents of each label, chosen by a hash of the id, and the
    field on at most LINES of their lines with and LINES without a mark. An id with labels of both kinds counts as toxic; null
    labels and ids are left out. Without toxic documents every score is small.
    """
    known = pick(labels, id=id_col, y=label_col).where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.max("y").cast("int").alias("y")).where(~held_out(F.col("id")))
    known = maybe_broadcast(known, labels.count(), 16)
    rows = pick(docs, id=id_col, text=text_col).join(known, "id").select("id", "y", F.coalesce("text", F.lit("")).alias("text"))

    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "toxicity")
    # The sample is cut by a hash at each row, so nothing of it meets in one task.
    n = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    share_of = F.when(F.col("y") == 1, F.lit(DOCS / max(DOCS, n.get(1, 0)))).otherwise(F.lit(DOCS / max(DOCS, n.get(0, 0))))
    sample_rows = scratch.keep(rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 24)) < share_of * (1 << 24)).select("y", "text"))

    # Marks: features that nearly only toxic documents have, by counts over all documents to learn from. Those of the sample are enough, as
    # only its tokens are tagged, and so their number is bounded by the sample.
    counted = _features(rows).groupBy("mark").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).where((F.col("bad") >= LEAST) & (F.col("bad") >= F.col("n") * SHARE))
    chosen = {r.mark for r in counted.join(_features(sample_rows.where("y = 1")).select("mark").distinct(), "mark", "left_semi").select("mark").collect()}
    if not chosen:
        return Field()

    held = spark.sparkContext.broadcast(chosen)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            got = []
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for line in text.split("\n"):
                    ws = [word_of(t) for t in line.split()]
                    for i in range(0, len(ws), LENGTH):
                        for w in ws[i : i + LENGTH]:
                            if w not in seen:
                                seen[w] = int(any(x in held.value for x in features(w)))
                        tags = [y and seen[w] for w in ws[i : i + LENGTH]]
                        if any(tags) or not y:
                            got.append((any(tags), crc32(" ".join(ws[i : i + LENGTH]).encode()), ws[i : i + LENGTH], tags))
                if len(seen) > CACHE:
                    seen.clear()
            for label in (True, False):
                some = [g for g in got if g[0] == label]
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in some], pa.bool_()), pa.array([g[1] for g in some], pa.int64()), pa.array([g[2] for g in some], pa.list_(pa.string())), pa.array([g[3] for g in some], pa.list_(pa.int32()))], ["toxic", "hash", "words", "tags"])

    lines = sample_rows.mapInArrow(mark, "toxic boolean, hash long, words array<string>, tags array<int>")
    sample = [x for label in (True, False) for x in lines.where(F.col("toxic") == label).orderBy("hash", F.xxhash64("words")).limit(LINES).collect()]
    f = train_field([(r.words, r.tags) for r in sample])

    got = _tagged(sample_rows, f, lambda t, ls, p, f: (figures(p).tolist(),), [("y", "int"), ("x", "array<double>")]).collect()
    f.score = fit_score(np.array([r.x for r in got]), np.array([float(r.y) for r in got]))
    share = known.agg(F.avg("y")).first()[0] or 0.5  # the sample holds the labels in other shares than all rows
    own = float(np.mean([r.y for r in got]))
    if 0 < own < 1 and 0 < share < 1:
        f.score[0] += np.log(share / (1 - share)) - np.log(own / (1 - own))
    return f


def score(docs: DataFrame, f: Field, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Scores every whole text: id, score (0 to 1), predicted (1 from 0.5 on), spans (start, end, p of offending runs of
    tokens, in characters). Null and empty texts score as texts without tokens. A row per row; other columns are not read."""
    rows = pick(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()

    def make(text, lines, p, f):
        s = float(1 / (1 + np.exp(-np.clip(figures(p) @ f.score, -700, 700))))
        return s, int(s >= 0.5), _spans(text, p, least)

    out = [("id", kind), ("score", "double"), ("predicted", "int"), ("spans", "array<struct<start:int,end:int,p:double>>")]
    return _tagged(rows, f, make, out).withColumnRenamed("id", id_col)
