"""Streams of what the batch operators do at once. These are extensions: the incremental rules are those of the sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import insert_if_absent


def stream_insert_if_absent(rows: DataFrame, path: str, keys: list[str], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends each micro-batch's new keys to a table; a batch that is repeated after a failure appends nothing."""
    writer = rows.writeStream.foreachBatch(lambda batch, _: insert_if_absent(batch, path, keys) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_message_stats(messages: DataFrame, at: str, key: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Messages per key and window; rows later than `late` behind the newest are left out."""
    return messages.withWatermark(at, late).groupBy(F.window(at, window), key).agg(F.count("*").alias("n"))
