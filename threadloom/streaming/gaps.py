"""Sessions by time gap as a stream: the rule of operators.sessions.gap_sessions on rows that come in any order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

_ROW = StructType([StructField("us", LongType()), StructField("id", StringType())])
_OPEN = StructType([StructField("session", LongType()), StructField("us", LongType())])


class _Gaps(StatefulProcessor):
    """State of a key: rows that the watermark hasn't passed, and of the session that is open its number and last instant."""

    def __init__(self, gap_us: int | None):
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", _ROW)
        self.open = handle.getValueState("open", _OPEN)

    def _emit(self, key, rows: list[tuple[int | None, str, int]]) -> Iterator[pd.DataFrame]:
        if rows:
            us, ids, numbers = zip(*rows, strict=True)
            at = pd.Series([None if u is None else pd.Timestamp(u, unit="us") for u in us], dtype="datetime64[us]")
            yield pd.DataFrame({"key": [key[0]] * len(rows), "id": ids, "at": at, "session": numbers})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting, blank = [], []
        now = self.open.get() if self.open.exists() else (0, None)
        for batch in rows:
            for us, id_ in zip(batch["us"].tolist(), batch["id"].tolist(), strict=True):
                if us is None or pd.isna(us):
                    blank.append((None, id_, int(now[0])))
                else:
                    waiting.append((int(us), id_))
        if waiting:
            self.pending.appendList(waiting)
            # a timer goes off once the watermark has reached its instant
            self.handle.registerTimer(-(-min(w[0] for w in waiting) // 1000))
        yield from self._emit(key, blank)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((int(us), id_) for us, id_ in self.pending.get()) if self.pending.exists() else []
        ready, rest = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        session, last = self.open.get() if self.open.exists() else (0, None)
        out = []
        for us, id_ in ready:
            if last is not None and self.gap is not None and us - last >= self.gap:
                session += 1
            last = us
            out.append((us, id_, int(session)))
        if ready:
            self.open.update((session, last))
            self.pending.clear()
            if rest:
                self.pending.put(rest)
                self.handle.registerTimer(-(-rest[0][0] // 1000))
        yield from self._emit(key, out)

    def close(self) -> None:
        pass


def stream_gap_sessions(rows: DataFrame, key: str, at: str, id_: str, gap_seconds: float | None, late: str) -> DataFrame:
    """(key, id, at, session) of a stream of rows, each once the watermark, `late` behind the newest instant, has passed it.

    Rows of a key are taken in the order of (at, id). As in batches a session begins where at least the gap lies between two rows; without a
    positive gap all is one. Rows later than the watermark are left out. A row without an instant has no place in the order: it goes to the
    session that is open and parts none. State is kept in RocksDB (spark.sql.streaming.stateStore.providerClass has to name it), holds
    the rows of the last `late` of each key and survives a restart from the checkpoint.
    """
    gap = int(gap_seconds * 1_000_000) if gap_seconds and gap_seconds > 0 else None
    marked = rows.select(F.col(key).cast("string").alias("key"), F.col(at).alias("at"), F.unix_micros(at).alias("us"), F.col(id_).cast("string").alias("id")).withWatermark("at", late)
    return marked.groupBy("key").transformWithStateInPandas(_Gaps(gap), "key string, id string, at timestamp, session long", "append", "eventTime")
