"""The stateful stream against the batch: micro-batches with packets out of order, repeated and late."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from quakeframe.streaming.segments import channel_segments

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
KIND = "sta string, chan string, ts timestamp, rate double, npts int"


def packets(seed, n=120):
    """Packets of 50 or 100 samples with gaps, jitter below and above the tolerance, and changes of the rate."""
    rng, rows = np.random.default_rng(seed), []
    for sta in ("A", None, "C"):
        at, rate = 0.0, 10.0
        for _ in range(n):
            size = int(rng.choice([50, 100]))
            rows.append((sta, "BHZ", START + datetime.timedelta(seconds=round(at + float(rng.choice([0, 0.02, 0.2], p=[0.8, 0.15, 0.05])), 3)), rate, size))
            at += size / rate + float(rng.choice([0, 30], p=[0.93, 0.07]))
            rate = 20.0 if rng.random() < 0.05 else rate
    return rows


def test_stream_and_batch_agree(spark, tmp_path):
    rng, rows = np.random.default_rng(7), packets(7)
    order = sorted(range(len(rows)), key=lambda i: rows[i][2].timestamp() + rng.uniform(0, 100))  # up to 100 s out of order
    folder = tmp_path / "in"
    parts = np.array_split(order, 8)
    for k, part in enumerate([*parts, []]):
        chosen = [rows[i] for i in part] + [rows[i] for i in part[:10]]  # some twice
        if k == 8:  # the watermark passes everything
            chosen = [("Z", "BHZ", START + datetime.timedelta(days=2), 1.0, 1), ("Z", "BHZ", START, 1.0, 1)]
        spark.createDataFrame(chosen, KIND).coalesce(1).write.mode("append").parquet(str(folder))
        if k == 8:
            spark.createDataFrame([("Z", "BHZ", START + datetime.timedelta(days=4), 1.0, 1)], KIND).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = channel_segments(stream, ["sta", "chan"], late="2 minutes").writeStream.outputMode("append").format("memory").queryName("segs").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    assert len([p for p in q.recentProgress if p["numInputRows"]]) >= 8
    q.stop()
    tell = lambda df: sorted((r.sta or "", round(r.starttime, 3), round(r.endtime, 3), r.rate, r.npts, r.npackets) for r in df.filter("sta IS NULL OR sta <> 'Z'").collect())
    batch = spark.createDataFrame(rows, KIND)
    want = tell(channel_segments(batch.unionByName(batch).repartition(3), ["sta", "chan"]))
    assert len(want) > 30 and sum(w[4] for w in want) == sum(r[4] for r in rows)
    assert tell(spark.table("segs")) == want


def test_edges(spark):
    df = spark.createDataFrame([("A", "x", None, 1.0, 1), ("A", "x", START, 0.0, 1), ("A", "x", START, 1.0, 0), ("A", "x", START, None, 1)], KIND)
    assert channel_segments(df, ["sta", "chan"]).count() == 0
    one = df.unionByName(spark.createDataFrame([("A", "x", START, 2.0, 3)], KIND))
    assert [(r.endtime - r.starttime, r.npts) for r in channel_segments(one, ["sta", "chan"]).collect()] == [(1.0, 3)]
    assert channel_segments(one.withColumn("open", F.lit(1)), ["sta"]).count() == 1
