"""Streams over files, run to their end; where a batch query gives the same rows, it is the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.registry import query, table
from plumbline.sources import writers as W
from plumbline.storage import new_path
from plumbline.streaming import streams as Z
from plumbline.streaming.panes import ROCKSDB, paned


#: Rows of a file of the stream, about, which one task writes; batches of the stream at most, apart from that of the end.
FILE_ROWS, BATCHES = 200_000, 3


def event_stream(spark: SparkSession, sf_dir: str, files: int = 3) -> tuple[DataFrame, str]:
    """``events`` in ranges of ascending time, a file each, as a stream, ended by a far event that closes all windows.

    All files are written at once; a stream takes them by their times, which are then set in the order of their ranges. A batch takes
    more files where there are more: each batch goes through the state of all keys, so their number must not grow with the rows.
    """
    folder = new_path(spark, "stream")
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    last = spark.sql("SELECT -1L AS event_id, timestamp '2024-06-01 00:00:00' AS ts, -1L AS user_id, 'end' AS event_type, 0.0D AS value")
    per_batch = -(-max(files, -(-e.count() // FILE_ROWS)) // max(files, BATCHES))
    files = per_batch * max(files, BATCHES)
    e.repartitionByRange(files, "ts").sortWithinPartitions("ts").write.parquet(f"{folder}/in")
    W.dated_by_name(spark, f"{folder}/in")
    last.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return Z.file_stream(spark, f"{folder}/in", e.schema, per_batch), folder


@query(
    "Z01 Z02 K08",
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""",
)
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows of a stream in order: what is final equals the batch."""
    stream, folder = event_stream(spark, sf_dir)
    out = Z.run_available(Z.tumbling(stream, "ts", "event_type", "value", size="1 hour"), folder)
    return out.where("event_type <> 'end'").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "Z04",
    """SELECT b.start AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, LATERAL (SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR AS start UNION ALL SELECT time_bucket(INTERVAL 1 HOUR, ts)) b GROUP BY 1, 2""",
)
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, folder = event_stream(spark, sf_dir)
    out = Z.run_available(Z.tumbling(stream, "ts", "event_type", "value", size="2 hours", slide="1 hour"), folder)
    return out.where("event_type <> 'end'").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "Z05",
    """WITH g AS (SELECT user_id, ts, (ts - lag(ts) OVER w >= INTERVAL 12 HOUR OR lag(ts) OVER w IS NULL)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, folder = event_stream(spark, sf_dir)
    out = Z.run_available(Z.sessions(stream, "ts", "user_id", "12 hours"), folder)
    return out.where("user_id >= 0").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query(
    "Z06 Z07 Z08 Z09 Z10 K11 F15",
    """SELECT CASE WHEN event_id % 10 = 0 THEN 'Broken JSON' WHEN event_id % 10 = 1 THEN 'Missing user_id' ELSE 'ok' END AS outcome, count(*) AS n, round(sum(CASE WHEN event_id % 10 > 1 THEN value / 100 ELSE 0 END), 4) AS score FROM events GROUP BY 1""",
)
def stream_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parse, check, score and split each batch: predictions to one table, dead letters to another, written by batch number."""
    stream, folder = event_stream(spark, sf_dir)
    i = F.col("event_id")
    good = F.to_json(F.struct("event_id", "user_id", "value"))
    raw = F.when(i % 10 == 0, F.lit('{"event_id":')).when(i % 10 == 1, F.to_json(F.struct("event_id", "value"))).otherwise(good)
    texts = stream.where("event_id >= 0").select(raw.alias("value"))
    rows = Z.checked(texts.select(F.replace("value", F.lit('"value"'), F.lit('"amount"')).alias("value")), "event_id long, user_id long, amount double", ("user_id",), lambda df: df.withColumn("score", F.col("amount") / 100))

    def write(batch: DataFrame, number: int) -> None:
        kept, letters = W.split_dead_letters(batch, "error", "posts")
        kept.select("event_id", "user_id", "score").write.mode("overwrite").parquet(f"{folder}/predictions/batch={number}")
        letters.write.mode("overwrite").parquet(f"{folder}/letters/batch={number}")

    Z.run_batches(rows, folder, write)
    kept = spark.read.parquet(f"{folder}/predictions").select(F.lit("ok").alias("outcome"), "score")
    letters = spark.read.parquet(f"{folder}/letters").select(F.get_json_object("value", "$.error").alias("outcome"), F.lit(0.0).alias("score"))
    return kept.unionByName(letters).groupBy("outcome").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("score"))


@query("Z12")
def stream_token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests allowed by a refilling bucket per user, kept as state between batches."""
    stream, folder = event_stream(spark, sf_dir)
    rows = stream.where("event_id >= 0").select("user_id", F.col("event_id").alias("id"), "ts")
    out = Z.run_available(Z.token_bucket(rows, "user_id", "ts", capacity=3, per_second=1 / 36000), folder)
    return out.groupBy("allowed").agg(F.count("*").alias("n"))


@query("Z13")
def breaker_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("failed"))
    return Z.circuit_breaker(calls, "user_id", "event_id", "failed")


@query("Z03", """SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accumulating panes, early, on time and late, by timers over state; a window's last pane is its result."""
    stream, folder = event_stream(spark, sf_dir)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, ROCKSDB)
    try:
        own = paned(stream, "ts", "event_type", "value", size_seconds=86400, lateness_seconds=300, early_s=0, late_s=0)

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/panes/batch={number}")

        Z.run_batches(own, folder, write, mode="update")
    finally:
        spark.conf.set(provider, before)
    panes = spark.read.parquet(f"{folder}/panes").where("key <> 'end'").select(F.timestamp_millis("start").alias("start"), F.col("key").alias("event_type"), "pane", "n")
    last = panes.groupBy("start", "event_type").agg(F.max_by("n", "pane").alias("n"))
    return last.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
