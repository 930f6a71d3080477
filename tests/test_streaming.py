"""Windows of a stream that arrives in pieces are those of the whole.

Times are long after 1970: a stream's watermark begins there, and points at it are late.
"""

import numpy as np
from pyspark.sql import functions as F

from weirlight.operators import metric, windows
from weirlight.streaming import score


def test_streamed_windows_are_batch_windows(spark, tmp_path):
    rng = np.random.default_rng(0)
    data = [(s, p, float(p), float(rng.normal())) for s in ("a", "b") for p in range(40)]
    points = spark.createDataFrame(data, "stream string, pos int, t double, x double").withColumn("ts", F.timestamp_seconds(F.lit(10**9) + F.col("pos")))
    for k, (lo, hi) in enumerate(((0, 15), (15, 33), (33, 40))):
        points.where((F.col("pos") >= lo) & (F.col("pos") < hi)).coalesce(1).write.parquet(str(tmp_path / f"in/p{k}"))
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    w = metric.Whitening(np.eye(6), np.ones(6))
    found = score.score_windows(score.closed_windows(stream, ["x"], 16), np.zeros((3, 6)), w, {0: 1e12})
    q = found.writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted((r["stream"], r["window"]) for r in spark.table("closed").collect())
    whole = windows.cut_windows(points.drop("ts"), 16, 17).select("source", "window").distinct().collect()
    assert got == sorted((r["source"], r["window"]) for r in whole) and not any(r["flag"] for r in spark.table("closed").collect())


def test_order_ends_and_repeats(spark, tmp_path):
    data = [(s, p, float(p), float(p)) for s in ("a", "b") for p in range(40)] + [("z", 0, 0.0, 0.0)]
    points = spark.createDataFrame(data, "stream string, pos int, t double, x double").withColumn("ts", F.timestamp_seconds(F.lit(10**9) + F.when(F.col("stream") == "z", 10**6).otherwise(F.col("pos"))))
    parts = ("pos >= 10 and pos < 20 and stream <> 'z'", "pos < 12 and stream <> 'z'", "pos >= 20 and stream = 'b'", "pos >= 18 and stream <> 'z'", "stream = 'z'", "stream = 'z'")
    for k, part in enumerate(parts):
        points.where(part).coalesce(1).write.parquet(str(tmp_path / f"in/p{k}"))
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    found = score.closed_windows(stream, ["x"], 16)
    q = found.writeStream.format("memory").queryName("ends").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r["stream"], r["window"]): [p[1] for p in r["points"]] for r in spark.table("ends").collect()}
    assert got == {(s, w): [float(p) for p in range(16 * w - 16, min(16 * w, 39) + 1)] for s in ("a", "b") for w in (1, 2, 3)}
