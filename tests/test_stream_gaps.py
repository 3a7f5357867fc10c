"""The stream of gap sessions gives the rows of the batch operator, over shuffled micro-batches and a restart."""

import datetime
import random

from pyspark.sql import functions as F

from threadloom.operators.sessions import gap_sessions
from threadloom.streaming.gaps import stream_gap_sessions

BEGIN, GAP = datetime.datetime(2024, 1, 1), 3600


def _events():
    """Times of three keys; many gaps are exactly the limit, or a microsecond less."""
    rng, rows = random.Random(4), []
    for key in "abc":
        at = BEGIN
        for i in range(40):
            at += datetime.timedelta(microseconds=rng.choice([0, 5_000_000, GAP * 1_000_000 - 1, GAP * 1_000_000, GAP * 1_000_000 + 1]))
            rows.append((key, at, f"{key}{i:02d}"))
    return rows


def test_stream_of_gap_sessions(spark, tmp_path):
    rows = sorted(_events(), key=lambda r: r[1])
    schema = "k string, at timestamp, id string"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(1)
    for i in range(1, len(rows)):  # rows come up to about ten places late
        j = max(0, i - rng.randrange(10))
        rows[i], rows[j] = rows[j], rows[i]
    src, ck, out = str(tmp_path / "src"), str(tmp_path / "ck"), str(tmp_path / "out")

    def run():
        stream = stream_gap_sessions(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), "k", "at", "id", GAP, "2 days")
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()

    try:
        for part in (rows[:60], rows[60:], [("z", BEGIN + datetime.timedelta(days=400), "end"), ("z", None, "blank")]):  # each a restart from the checkpoint
            for i in range(0, len(part), 30):
                spark.createDataFrame(part[i : i + 30], schema).coalesce(1).write.mode("append").parquet(src)
            run()
        run()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted((r.key, r.id, r.session) for r in spark.read.parquet(out).collect() if r.key != "z")
    assert [(r.at, r.session) for r in spark.read.parquet(out).where("id = 'blank'").collect()] == [(None, 0)]
    df = spark.createDataFrame(rows, schema).withColumn("s", F.unix_micros("at") / 1e6)
    want = sorted((r.k, r.id, r.session) for r in gap_sessions(df, ["k"], ["at", "id"], "at", GAP).collect())
    assert got == want and max(s for _, _, s in got) > 5
