"""A stream in several batches gives what the batch features give."""

import numpy as np
from pyspark.sql import functions as F

from panelcast import streaming
from panelcast.operators import features as feats
from panelcast.operators import windows as W

from .test_windows import bars, walk


def test_online_is_the_batch(spark, tmp_path):
    (p, v), (q, u) = walk(60, 1), walk(25, 2)
    df = bars(spark, {"a": (p, v), "b": (q, u)}).select("stk", F.col("i").cast("long").alias("i"), "p", "v")
    folder = str(tmp_path / "in")
    for low, high in ((0, 20), (20, 21), (21, 60)):
        df.where((F.col("i") >= low) & (F.col("i") < high)).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = streaming.online(stream).writeStream.format("memory").queryName("online_features").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.stk, r.i): r for r in spark.table("online_features").collect()}
    batch = feats.macd(df).withColumns({"r": W.returns(F.col("p")), "d": W.difference(F.col("p"))}).withColumn("obv", W.obv(F.col("d"), F.col("v")))
    want = {(r.stk, r.i): r for r in batch.collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        assert np.allclose([got[k][c] for c in ("r", "ema_fast", "ema_slow", "macd_hist", "obv")], [w[c] for c in ("r", "ema_fast", "ema_slow", "macd_hist", "obv")], rtol=1e-9, atol=1e-12)
