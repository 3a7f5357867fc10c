"""Pasted transcripts: text to messages with offsets."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Speaker labels at the start of a line; those of plain ASCII in any case.
LABELS = {
    "You said:": "user", "ChatGPT said:": "assistant", "User said:": "user", "Assistant said:": "assistant", "ユーザー:": "user", "ユーザー：": "user", "アシスタント:": "assistant", "アシスタント：": "assistant",
    "あなた:": "user", "あなた：": "user", "User:": "user", "Assistant:": "assistant", "Human:": "user", "ChatGPT:": "assistant", "You:": "user",
}
_LABEL = re.compile("^[ \t]*(" + "|".join(f"(?i:{re.escape(x)})" if x.isascii() else re.escape(x) for x in LABELS) + ")[ \t]*(?:(?=\r?$)\r?\n?)?", re.M)
_ROLE = {k.lower(): v for k, v in LABELS.items()}
MESSAGE = ArrayType(StructType([StructField("index", IntegerType()), StructField("role", StringType()), StructField("content", StringType()), StructField("char_start", IntegerType()), StructField("char_end", IntegerType())]))


def parse(raw: str) -> list[dict]:
    found = list(_LABEL.finditer(raw))
    if found:
        cuts = [(m.end(), n, _ROLE[m[1].lower()]) for m, n in zip(found, [*(m.start() for m in found[1:]), len(raw)], strict=True)]
        cuts = [(0, found[0].start(), "unknown")] * (found[0].start() > 0) + cuts
        if out := _messages(raw, cuts):
            return out
    ends = [(m.start(), m.end()) for m in re.finditer(r"\n{2,}", raw)]
    starts = [0, *(b for _, b in ends)]
    stops = [*(a for a, _ in ends), len(raw)]
    out = _messages(raw, [(a, b, "unknown") for a, b in zip(starts, stops, strict=True)])
    return out or ([{"index": 0, "role": "unknown", "content": raw, "char_start": 0, "char_end": len(raw)}] if raw else [])


def _messages(raw: str, cuts: list[tuple[int, int, str]]) -> list[dict]:
    kept = [(a, b, r) for a, b, r in cuts if raw[a:b].strip()]
    return [{"index": i, "role": r, "content": raw[a:b], "char_start": a, "char_end": b} for i, (a, b, r) in enumerate(kept)]


@F.pandas_udf(MESSAGE)
def messages_of(raw: pd.Series) -> pd.Series:
    """The messages of each text; a text without labels is cut at blank lines, its roles unknown. Offsets are code points."""
    return raw.map(lambda r: parse(r or ""))
