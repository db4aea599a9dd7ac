"""Panes by timers, and queries stopped and started again."""

from __future__ import annotations

import os
import signal
import time

from pyspark.sql import functions as F

from plumbline.streaming import panes
from plumbline.streaming import streams as Z

BASE = 1704067200
SCHEMA = "id long, s long, k string, value double, ts timestamp"


def write_files(spark, path, files):
    for n, rows in enumerate(files):
        df = spark.createDataFrame([(i, BASE + t, "a", 1.0) for i, t in rows], "id long, s long, k string, value double")
        df.withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.parquet(f"{path}/staged/{n}")
        part = next(f for f in os.listdir(f"{path}/staged/{n}") if f.startswith("part-"))
        os.makedirs(f"{path}/in", exist_ok=True)
        os.utime(f"{path}/staged/{n}/{part}", (BASE + n, BASE + n))
        os.rename(f"{path}/staged/{n}/{part}", f"{path}/in/{n}.parquet")


def test_panes_early_on_time_and_late(spark, tmp_path):
    files = [[(1, 10), (2, 50)], [(3, 130)], [(4, 125)], [(5, 30), (6, 200)], [(7, 900)], [(8, 20), (9, 901)], [(10, 100_000)], [(11, 200_000)]]
    write_files(spark, str(tmp_path), files)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", panes.ROCKSDB)
    try:
        out = panes.paned(Z.file_stream(spark, f"{tmp_path}/in", SCHEMA), "ts", "k", "value", size_seconds=60, lateness_seconds=300, early_s=0, late_s=0)
        Z.run_batches(out, str(tmp_path), lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}"), mode="update")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    first = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").where(f"start = {BASE * 1000}").orderBy("pane").select("pane", "timing", "n", "total").collect()]
    # rows 1 and 2; the end of the window has been seen; row 5 is late but within 300 seconds; row 8 is too late
    assert first == [(1, "early", 2, 2.0), (2, "on time", 2, 2.0), (3, "late", 3, 3.0)]
    last = spark.read.parquet(f"{tmp_path}/out").groupBy("start").agg(F.max_by("n", "pane").alias("n"), F.collect_set("timing").alias("t")).collect()
    assert {(r["start"] // 1000 - BASE, r["n"]) for r in last if r["start"] // 1000 - BASE < 1000} == {(0, 3), (120, 2), (180, 1), (900, 2)}


def test_stopped_after_a_batch_and_started_again(spark, tmp_path):
    write_files(spark, str(tmp_path), [[(i, i) for i in range(10 * n, 10 * n + 10)] for n in range(5)])
    seen = []

    def write(batch, number):
        batch.select("id").write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")
        seen.append(number)

    def start():
        return Z.start_batches(Z.file_stream(spark, f"{tmp_path}/in", SCHEMA), str(tmp_path), write)

    Z.stop_between_batches(start(), lambda: len(seen) >= 1)
    assert 1 <= len(seen) < 5
    Z.stop_between_batches(start(), lambda: max(seen) >= 4)
    ids = [r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(ids) == list(range(50))


def test_stopped_by_a_signal(spark, tmp_path):
    write_files(spark, str(tmp_path), [[(1, 1)]])
    seen = []
    with Z.stopping_on(signal.SIGUSR1) as asked:
        query = Z.start_batches(Z.file_stream(spark, f"{tmp_path}/in", SCHEMA), str(tmp_path), lambda b, n: seen.append(b.count()))
        while not seen:
            time.sleep(0.1)
        assert query.isActive and not asked.is_set()
        os.kill(os.getpid(), signal.SIGUSR1)
        Z.stop_between_batches(query, asked.is_set)
    assert not query.isActive and seen == [1]
