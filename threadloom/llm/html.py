"""Main text of web pages.

Markup says most: what stands in article or main elements is the text, what stands in menus, adverts, forms, scripts
and the like is not. On pages without such an element the blocks of a host are compared: a run of words that
distinct pages of the host share is boilerplate, as in a suffix array of all its pages, where a run of `run` words or
more is repeated exactly when its suffix has a neighbour of another page with that long a common prefix. Such runs
are found by the first `run` words of each suffix, so a host of any size is spread over many tasks.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pick

#: Words of a run.
RUN = 8
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"(?i)\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")
_RAW = frozenset(["script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"])
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_DROP = frozenset("head nav footer aside form button select option svg math object canvas audio video dialog menu fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices gdpr sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments disqus footer header masthead newsletter subscribe subscription share sharing social related popup modal pagination pager toolbar widget skip".split())
#: Words that within an article may also name a part of it.
_WITHIN = frozenset(["header", "navbar", "masthead"])
_LANDMARK = re.compile(r"(?i)<(?:article|main)\b|\brole\s*=\s*[\"']?(?:main|article)\b")


def blocks(page: str) -> tuple[list[str], bool]:
    """The blocks of text of a page, in order, and whether an element marks them as the main text."""
    found: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # open elements that hold blocks: name and zone
    piece: list[str] = []
    at = 0

    def zone() -> str:
        return stack[-1][1] if stack else ""

    def close() -> None:
        if piece:
            text = _SPACE.sub(" ", html.unescape("".join(piece))).strip()
            piece.clear()
            if text:  # never written in a dropped element, but one may have begun within the block
                found.append((next((z for _, z in reversed(stack) if z != "drop"), ""), text))

    while at < len(page):
        m = _TAG.search(page, at)
        if zone() != "drop":
            text = page[at : m.start() if m else len(page)]
            if not m and (cut := re.search(r"<[a-zA-Z/!?]", text)):
                text = text[: cut.start()]  # a tag that never ends
            if text:
                piece.append(text)
        if not m:
            break
        at = m.end()
        if m["cdata"] is not None:
            if zone() != "drop":
                piece.append(html.escape(m["cdata"]))
            continue
        if not m["name"]:
            continue
        name = m["name"].lower()
        if m["end"]:
            if name in _INLINE:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        if stack[i][1] != "drop":
                            close()
                        del stack[i:]
                        break
                    if stack[i][0] not in _INLINE:
                        break
                continue
            close()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "br" or name == "hr":
            piece.append("\n")
        if name in _VOID:
            continue
        attrs = {k.lower(): (a or b or c or "").lower() for k, a, b, c in _ATTR.findall(m["attrs"])} if m["attrs"].strip() else {}
        inner = zone()
        if inner != "drop":
            role = attrs.get("role", "")
            words = set(re.split(r"[^a-z]+", f"{attrs.get('class', '')} {attrs.get('id', '')}"))
            if name in _DROP or name == "header" and not inner or role in _ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or words & (_WORDS - _WITHIN if inner == "article" else _WORDS) and name not in ("html", "body", "article", "main") or name == "article" and (inner == "article" or words & {"comment", "comments", "ad", "advert", "related", "teaser", "promo"}):
                inner = "drop"
            elif name == "article" or role == "article":
                inner = "article"
            elif (name == "main" or role == "main") and inner != "article":
                inner = "main"
        if name in _INLINE and inner == zone():
            if any(n == name for n, _ in stack):
                stack.append((name, inner))  # so that its end isn't taken for the other's
            continue
        if name not in _INLINE or inner != "drop":
            close()
        if not m["attrs"].endswith("/") or inner == zone():
            if name not in ("p", "li", "td", "th", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd", "option") or inner != zone():
                stack.append((name, inner))
    close()
    marked = [text for z, text in found if z]
    return (marked, True) if marked else ([text for _, text in found], bool(_LANDMARK.search(page)))


def _windows(text: str) -> Iterator[tuple[int, int]]:
    """Hashes of each run of words of a block and how many words it spans; a shorter block is one run."""
    words = text.split(" ")
    for i in range(max(1, len(words) - RUN + 1)):
        yield i, xxhash.xxh3_64_intdigest(" ".join(words[i : i + RUN])) - (1 << 63)


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of each page: id, url, text, n_chars (code points).

    Blocks keep their order and are joined by one space. Null, empty and broken pages give what text they have, empty
    if none. On pages without article or main element the words are dropped that lie in runs of RUN words (or in a whole
    shorter block) that another page of the host, with another text, has too; what stands between stays. Rows that repeat are pages of their own, but of one page id; an empty
    table gives an empty result; other columns are not read.
    """
    rows = pick(pages, id=id_col, url=url_col, html=html_col)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, url string, text string, n_chars long"
    has = F.coalesce(F.col("html").rlike(_LANDMARK.pattern), F.lit(True))

    def joined(ids, urls, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["id", "url", "text", "n_chars"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [" ".join(blocks(x)[0]) for i in range(0, batch.num_rows, 256) for x in (y or "" for y in batch.column(2).slice(i, 256).to_pylist())]
            yield joined(batch.column(0), batch.column(1), texts)

    done = rows.where(has).select("id", "url", "html").mapInArrow(run, schema)
    rest = _by_host(rows.where(~has), kind, schema, joined)
    return done.unionByName(rest).select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")


def _by_host(rows: DataFrame, kind: str, schema: str, joined) -> DataFrame:
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks(y or "")[0] for i in range(0, batch.num_rows, 256) for y in batch.column(2).slice(i, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], ["id", "url", "blocks"])

    parsed = rows.select("id", "url", "html").mapInArrow(parse, f"id {kind}, url string, blocks array<string>")
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1), F.lit("")))
    kept = Scratch(rows.sparkSession, "html").keep(parsed.select(F.monotonically_increasing_id().alias("row"), host.alias("host"), "id", "url", "blocks"))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, name, found in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                got = [(b, w, h) for b, text in enumerate(found) for w, h in _windows(text)]
                if got:
                    b, w, h = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(got), pa.int64()), pa.array([name] * len(got)), pa.array(b, pa.int32()), pa.array(w, pa.int32()), pa.array(h, pa.int64())], ["row", "host", "block", "word", "hash"])

    cut = kept.select("row", "host", "blocks").mapInArrow(suffixes, "row long, host string, block int, word int, hash long")
    # Two of the pages differ in id and in text exactly when neither is the same for all.
    whole = F.sha2(F.to_json(F.struct("blocks")), 256)
    ends = [f(c).alias(f.__name__ + c) for c in ("id", "whole") for f in (F.min, F.max)]
    shared = cut.join(kept.select("row", "id", whole.alias("whole")), "row").groupBy("host", "hash").agg(*ends).where("minid < maxid AND minwhole < maxwhole").select("host", "hash")
    spots = cut.join(shared, ["host", "hash"], "left_semi").groupBy("row").agg(F.collect_list(F.struct("block", "word")).alias("spots"))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for found, spots in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                covered = [np.zeros(x.count(" ") + 1, bool) for x in found]
                for s in spots or ():
                    covered[s["block"]][s["word"] : s["word"] + RUN] = True
                texts.append(" ".join(w for x, c in zip(found, covered, strict=True) for w, gone in zip(x.split(" "), c, strict=True) if not gone))
            yield joined(batch.column(0), batch.column(1), texts)

    return kept.join(spots, "row", "left").select("id", "url", "blocks", "spots").mapInArrow(drop, schema)
