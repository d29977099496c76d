"""Counts that run with a stream end as the batch's, restart and late rows
included."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtests
from tidemark.streaming import running

SCHEMA = "series_id string, model string, alpha double, ts timestamp, actual_return double, var double"


def test_stream_ends_as_the_batch(spark, tmp_path):
    rng, day = random.Random(1), datetime.datetime(2020, 1, 1)
    rows = [(s, "m", 0.05, day + datetime.timedelta(days=t), rng.choice([-2.0, 0.5, -3.0, None]), rng.choice([1.0, 1.0, None])) for s in ("a", "b") for t in range(60)]
    order = sorted(rows, key=lambda r: (r[3] + datetime.timedelta(days=rng.randint(0, 1)), r[0]))  # a day out of order
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        def feed(k, some):
            spark.createDataFrame(some, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/k={k}")

        def run():
            stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*")
            q = running.running_counts(stream, "3 days").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start(f"{tmp_path}/out")
            try:
                q.processAllAvailable()
            finally:
                q.stop()

        feed(0, order[:50])
        run()
        feed(1, order[50:])
        run()  # another query, from the checkpoint
        late = [("a", "m", 0.05, day, -9.0, 1.0), ("b", "m", 0.05, day + datetime.timedelta(days=1), -9.0, 1.0)]
        feed(2, late)
        feed(3, [(s, "m", 0.05, day + datetime.timedelta(days=900), 1.0, 1.0) for s in ("a", "b")])  # moves the watermark
        run()
        out = spark.read.parquet(f"{tmp_path}/out")
        last = {r.series_id: r for r in out.groupBy("series_id").agg(F.max_by(F.struct("*"), "n_obs").alias("x")).select("x.*").collect()}
        batch = spark.createDataFrame([(*r[:3], k, r[4], r[5], 1.0) for k, r in enumerate(sorted(rows, key=lambda r: r[3]))], "series_id string, model string, alpha double, t int, actual_return double, var double, es double")
        for w in backtests.counts(batch).collect():
            g = last[w.series_id]
            assert [g[c] for c in ("n_obs", "n_violations", "n00", "n01", "n10", "n11")] == [w[c] for c in ("n_obs", "n_violations", "n00", "n01", "n10", "n11")]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
