"""Structured Streaming: windows with watermarks, record checks with dead letters, and keyed state."""

from __future__ import annotations

import signal
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from threading import Event

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW, LATENESS, TRIGGER = "60 seconds", "300 seconds", "30 seconds"


def run_available(stream: DataFrame, folder: str, *, mode: str = "append", name: str = "out") -> DataFrame:
    """Run a stream over what is there and stop: its rows, from files; the checkpoint lies beside them."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{folder}/{name}-checkpoint").trigger(availableNow=True).start(f"{folder}/{name}")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/{name}")


def run_batches(stream: DataFrame, folder: str, write: Callable[[DataFrame, int], None], *, mode: str = "append") -> None:
    """Run a stream over what is there through ``foreachBatch``; each batch has a number to write under, so a retry overwrites."""
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def start_batches(stream: DataFrame, folder: str, write: Callable[[DataFrame, int], None], *, mode: str = "append", every: str = "0 seconds") -> StreamingQuery:
    """Start a stream that goes on, through ``foreachBatch``; from ``folder``'s checkpoint, if it has one, where it was stopped."""
    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime=every).start()


def stop_between_batches(query: StreamingQuery, wanted: Callable[[], bool], *, poll_s: float = 0.1) -> None:
    """Stop a query once it is ``wanted`` and no batch is under way; a batch that is cut off all the same runs again when the query
    is started anew, under its number, so a sink that overwrites by number has each row once."""
    while query.isActive and not wanted():
        query.awaitTermination(poll_s)
    while query.isActive and query.status["isTriggerActive"] and query.status["isDataAvailable"]:
        query.awaitTermination(poll_s)
    query.stop()


@contextmanager
def stopping_on(*signals: int) -> Iterator[Event]:
    """An event that is set by the first of the signals, whose handlers are put back afterwards; for ``stop_between_batches``."""
    asked = Event()
    before = {s: signal.signal(s, lambda *_: asked.set()) for s in signals}
    try:
        yield asked
    finally:
        for s, handler in before.items():
            signal.signal(s, handler)


def file_stream(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    """Files as a stream, in the order of their times."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def tumbling(stream: DataFrame, ts: str, key: str, value: str, *, size: str = WINDOW, lateness: str = LATENESS, slide: str | None = None) -> DataFrame:
    """Counts and sums of a key by event-time window; rows later than the lateness are dropped."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    own = stream.withWatermark(ts, lateness).groupBy(window.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return own.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def sessions(stream: DataFrame, ts: str, key: str, gap: str, lateness: str = LATENESS) -> DataFrame:
    own = stream.withWatermark(ts, lateness).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return own.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def checked(stream: DataFrame, schema: str, required: tuple[str, ...], features: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Parse JSON texts (``value``), check required fields, and derive features; ``error`` names what is wrong."""
    parsed = F.from_json("value", f"{schema}, __broken string", {"columnNameOfCorruptRecord": "__broken"})
    rows = stream.select("value", parsed.alias("r"))
    missing = [F.when(F.col(f"r.{c}").isNull(), F.lit(f"Missing {c}")) for c in required]
    error = F.coalesce(F.when(F.col("r.__broken").isNotNull() | F.col("r").isNull(), F.lit("Broken JSON")), *missing)
    return features(rows.select("value", "r.*", error.alias("error")).drop("__broken"))


def token_bucket(stream: DataFrame, key: str, ts: str, *, capacity: float, per_second: float) -> DataFrame:
    """Requests allowed by a bucket per key that refills with event time; the bucket is keyed state.

    A key's requests within a batch are ordered by time; the batch of one key is all that a call holds.
    """

    def run(own: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, last = state.get if state.exists else (capacity, None)
        parts = [(f["__us"].to_numpy(), f["id"].to_numpy()) for f in frames]
        times, ids = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((ids, times))
        allowed = []
        for now in (times[order] / 1e6).tolist():
            level = min(capacity, level + (now - last) * per_second) if last is not None else level
            last = now
            allowed.append(level >= 1)
            level -= level >= 1
        state.update((float(level), last))
        yield pd.DataFrame({key: own[0], "id": ids[order], "allowed": np.array(allowed)}, copy=False)

    # Times go to Python as numbers, which cost much less to convert for each of many small groups.
    rows = stream.select(key, "id", F.unix_micros(F.col(ts).cast("timestamp")).alias("__us"))
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} long, id long, allowed boolean", "level double, last double", "append", GroupStateTimeout.NoTimeout)


def circuit_breaker(calls: DataFrame, key: str, order: str, failed: str, *, limit: int = 3, cooldown: int = 5) -> DataFrame:
    """State of a breaker after all of a key's calls in order: open after ``limit`` failures in a row, half-open after
    ``cooldown`` calls, closed by a success; an unknown outcome is none of failure.

    A key's calls are sorted in its task and stream through it, a batch at a time: of a key only three values are held.
    """
    n = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key_type = calls.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, fails, since = None, "closed", 0, 0
        for batch in batches:
            keys, states, kind = [], [], batch.schema.field(0).type
            for k, bad in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if last is None or k != last[0]:
                    if last is not None:
                        keys.append(last[0])
                        states.append(state)
                    last, state, fails, since = (k,), "closed", 0, 0
                if state == "open":
                    since += 1
                    state = "open" if since < cooldown else "half_open"
                elif not bad:
                    state, fails = "closed", 0
                elif state == "half_open" or fails + 1 >= limit:
                    state, fails, since = "open", 0, 0
                else:
                    fails += 1
            yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(states, pa.string())], names=[key, "state"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last[0]], kind), pa.array([state], pa.string())], names=[key, "state"])

    rows = calls.select(key, F.col(failed).alias("failed"), F.col(order).alias("o")).repartition(n, key).sortWithinPartitions(key, "o", "failed")
    return rows.select(key, "failed").mapInArrow(run, f"`{key}` {key_type}, state string")
