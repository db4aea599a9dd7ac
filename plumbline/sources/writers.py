"""Sinks: files, partitioned tables, shards, and merges into tables that exist."""

from __future__ import annotations

import hashlib
import html
import io
import json
import tarfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.storage import materialize


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_parquet(df: DataFrame, path: str, max_rows: int | None = None) -> None:
    """Parquet with zstandard; ``max_rows`` rotates files."""
    own = df.write.mode("overwrite").option("compression", "zstd")
    (own.option("maxRecordsPerFile", max_rows) if max_rows else own).parquet(path)


def write_text_file(spark: SparkSession, path: str, text: str) -> None:
    """One small file, whole or not at all: written under another name and moved."""
    jvm = spark.sparkContext._jvm
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".part")
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = store.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    store.delete(target, False)
    store.rename(part, target)


def dated_by_name(spark: SparkSession, path: str) -> None:
    """Set the times of a folder's files in the order of their names, a second apart and all in the past."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((f.getPath().toString() for f in store.listStatus(folder) if f.getPath().getName().startswith("part-")))
    first = int(time.time() * 1000) - 1000 * (len(files) + 1)
    for i, name in enumerate(files):
        store.setTimes(jvm.org.apache.hadoop.fs.Path(name), first + 1000 * i, -1)


def write_with_stats(df: DataFrame, path: str, label: str, *distinct: str) -> dict:
    """Parquet and a sidecar with rows, rows by label and the distinct values of some columns, from one aggregate."""
    write_parquet(df, path)
    own = df.sparkSession.read.parquet(path)
    rows = own.groupBy(label).agg(F.count("*").alias("n"), *(F.collect_set(c).alias(c) for c in distinct)).collect()
    stats = {"total": sum(r["n"] for r in rows), "labels": {str(r[label]): r["n"] for r in rows}}
    stats |= {c: sorted({v for r in rows for v in r[c]}) for c in distinct}
    write_text_file(df.sparkSession, path.rstrip("/") + ".stats.json", json.dumps(stats, sort_keys=True))
    return stats


def write_offline(df: DataFrame, path: str, date: str) -> None:
    """A date's partition of a feature view replaced, others kept; a sidecar has its rows and columns."""
    own = df.withColumn("date", F.lit(date).cast("date"))
    own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
    meta = {"date": date, "columns": df.columns, "version": definition_hash(df)}
    write_text_file(df.sparkSession, f"{path.rstrip('/')}/_info_{date}.json", json.dumps(meta, sort_keys=True))


def read_offline(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """A feature view between two dates, both included; other partitions aren't read."""
    return spark.read.parquet(path).where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def definition_hash(df: DataFrame) -> str:
    """A short hash of a view's columns and types."""
    return hashlib.sha256(json.dumps(sorted(df.dtypes)).encode()).hexdigest()[:16]


def arrow_files(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """Arrow IPC files as rows of ``content binary, n long``, at most ``rows`` rows each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), rows):
                part = batch.slice(i, rows)
                out = io.BytesIO()
                with pa.ipc.new_file(out, part.schema) as writer:
                    writer.write_batch(part)
                yield pa.RecordBatch.from_pydict({"content": pa.array([out.getvalue()], pa.binary()), "n": pa.array([len(part)], pa.int64())})

    return df.mapInArrow(run, "content binary, n long")


def write_blobs(blobs: DataFrame, path: str, suffix: str) -> DataFrame:
    """Each ``content`` as a file of its own below ``path``, named by what it holds, so that a repeated task writes the same
    file: ``file, bytes`` of each. A file is written whole under another name and moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [(_write_named(path, content, suffix), len(content)) for content in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["file", "bytes"])

    return materialize(blobs.select("content").mapInArrow(run, "file string, bytes long"), "blobs").dropDuplicates(["file"])


def _write_named(path: str, content: bytes, suffix: str) -> str:
    """Write a file below ``path`` that is named by its content: its URI."""
    from pyarrow import fs

    uri = f"{path.rstrip('/')}/{hashlib.sha256(content).hexdigest()[:32]}{suffix}"
    store, own = fs.FileSystem.from_uri(uri)
    store.create_dir(own.rpartition("/")[0], recursive=True)
    part = f"{own}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(content)
    store.move(part, own)
    return uri


def zstd_files(lines: DataFrame) -> DataFrame:
    """Texts (the first column) as zstandard files of lines, rows of ``content binary``, one for each batch of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            body = "".join(f"{x}\n" for x in batch.column(0).to_pylist()).encode()
            yield pa.RecordBatch.from_pydict({"content": pa.array([zstandard.ZstdCompressor().compress(body)], pa.binary())})

    return lines.mapInArrow(run, "content binary")


def _tar_parts(batches: Iterator[pa.RecordBatch], key: str, body: str, rows: int) -> Iterator[tuple[pa.RecordBatch, bytes]]:
    """Slices of ``rows`` rows and the tar shard of each, one at a time."""
    for batch in batches:
        for i in range(0, len(batch), rows):
            part = batch.slice(i, rows)
            out = io.BytesIO()
            with tarfile.open(fileobj=out, mode="w") as tar:
                for k, t in zip(part.column(key).to_pylist(), part.column(body).to_pylist(), strict=True):
                    data = (t or "").encode()
                    info = tarfile.TarInfo(f"{k}.txt")
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
            yield part, out.getvalue()


def write_tar_shards(df: DataFrame, key: str, body: str, rows: int, path: str) -> DataFrame:
    """Tar shards as files below ``path``, ``rows`` rows each: ``first_key, file, n``, a row a shard, also where shards are equal.

    A task holds one shard, and none passes through Spark's columns, whose batches would hold as many as a file has.
    """
    id_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, content in _tar_parts(batches, key, body, rows):
            uri = _write_named(path, content, ".tar")
            yield pa.RecordBatch.from_arrays([part.column(key).slice(0, 1), pa.array([uri], pa.string()), pa.array([len(part)], pa.int64())], names=["first_key", "file", "n"])

    return materialize(df.select(key, body).mapInArrow(run, f"first_key {id_type}, file string, n long"), "shards")


def insert_new(known: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new`` whose keys ``known`` lacks, each key once: what an insert that ignores duplicates appends."""
    return new.dropDuplicates(keys).join(known.select(*keys), keys, "left_anti")


def upsert(known: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``known`` with rows of ``new`` in place of those with equal keys."""
    return known.join(new.select(*keys), keys, "left_anti").unionByName(new)


def merge_nodes(known: DataFrame, new: DataFrame, key: str, on_create: dict[str, Column] | None = None) -> DataFrame:
    """A merge by key: on a match new values win where they are not null, known ones stay elsewhere; a new key's nulls become
    what ``on_create`` has for their column."""
    rest, first = [c for c in known.columns if c != key], on_create or {}
    own = known.withColumn("__known", F.lit(True)).alias("a").join(new.alias("b"), key, "full")
    created = F.col("a.__known").isNull()
    return own.select(key, *(F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}"), *([F.when(created, first[c])] if c in first else [])).alias(c) for c in rest))


def replace_table(df: DataFrame, path: str) -> None:
    """Write a version of a table beside those there are; it is the table once it is complete, so readers see one or the other.

    A version that a lost driver left unfinished has no success marker and is passed over.
    """
    df.write.parquet(f"{path.rstrip('/')}/version={time.time_ns():020d}")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The latest complete version of a table."""
    from plumbline.sources.readers import latest

    done = latest(spark, f"{path.rstrip('/')}/version=*/_SUCCESS")
    return spark.read.parquet(done.rpartition("/")[0])


def merge_edges(known: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with the weights of equal (src, dst, type) added up; a null weight counts as 0."""
    return known.unionByName(new).groupBy("src", "dst", "type").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight"))


def with_expiry(features: DataFrame, ts: str, ttl_seconds: int) -> DataFrame:
    return features.withColumn("expires_at", F.col(ts) + F.make_dt_interval(secs=F.lit(float(ttl_seconds))))


def alive(features: DataFrame, now: Column) -> DataFrame:
    return features.where(F.col("expires_at") > now)


def split_dead_letters(rows: DataFrame, error: str, topic: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and dead letters ``{original, error, timestamp, topic}`` of those with an error."""
    bad = rows.where(F.col(error).isNotNull())
    letter = F.to_json(F.struct(F.col("value").alias("original"), F.col(error).alias("error"), F.lit(topic).alias("topic")))
    return rows.where(F.col(error).isNull()).drop(error), bad.select(letter.alias("value"))


def kafka_sink(rows: DataFrame, servers: str, topic: str, key: str, checkpoint: str):
    """Start a stream into a Kafka topic, keyed; it needs Spark's Kafka package."""
    own = rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))
    return own.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def read_text_file(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None where there is no such file."""
    from plumbline.sources.readers import path_exists

    if not path_exists(spark, path):
        return None
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def append_log(rows: DataFrame, path: str) -> None:
    """Append rows to a log of JSON lines."""
    rows.write.mode("append").json(path)


def write_report(results: DataFrame, path: str, title: str) -> None:
    """A validation's checks as JSON and as an HTML table; there is a row per check."""
    rows = [r.asDict() for r in results.orderBy("check_name").collect()]
    text = json.dumps({"title": title, "passed": all(r["passed"] for r in rows), "checks": rows}, sort_keys=True)
    write_text_file(results.sparkSession, f"{path}.json", text)
    cells = "".join(f"<tr><td>{html.escape(r['check_name'])}</td><td>{'ok' if r['passed'] else 'failed'}</td><td>{r['value']}</td></tr>" for r in rows)
    write_text_file(results.sparkSession, f"{path}.html", f"<h1>{html.escape(title)}</h1><table>{cells}</table>")
