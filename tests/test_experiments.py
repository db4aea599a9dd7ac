"""Experiments against closed forms and values worked out by hand, and the Python data sources."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from plumbline.functions import scores as S
from plumbline.operators import experiments, validate
from plumbline.operators.sampling import folds
from plumbline.plans import experiments as plans
from plumbline.sources import datasources, readers, writers


def test_bootstrap_interval_is_the_closed_form(spark):
    rng = np.random.default_rng(1)
    x = [rng.normal(10, 3, 20_000), rng.normal(10.1, 5, 9_000)]
    rows = [(g * 100_000 + i, float(v), g) for g in (0, 1) for i, v in enumerate(x[g])] + [(-1, None, 0)]
    row = experiments.bootstrap_interval(spark.createDataFrame(rows, "k long, x double, g int"), "k", "x", "g").collect()[0]
    half = 1.959964 * math.sqrt(x[0].var() / len(x[0]) + x[1].var() / len(x[1]))
    middle = x[1].mean() - x[0].mean()
    assert row["replicates"] == 10_000 and abs(row["mean_difference"] - middle) < 0.05 * half
    assert abs(row["lower"] - (middle - half)) < 0.08 * half and abs(row["upper"] - (middle + half)) < 0.08 * half
    few = spark.createDataFrame([(1, 1.0, 0)], "k long, x double, g int")
    assert experiments.bootstrap_interval(few, "k", "x", "g").collect() == []


def test_stopping_rule(spark):
    rows = [(999, 5000, -0.5, True, 99), (1000, 1000, -0.06, False, 1), (1000, 1000, 0.01, True, 1), (1000, 1000, -0.01, True, 1), (1000, 1000, 0.01, False, 13), (1000, 1000, 0.0, False, 14), (1000, 1000, -0.01, False, 14), (1000, 1000, 0.0, True, 1)]
    df = spark.createDataFrame(rows, "n0 long, n1 long, lift double, sure boolean, days long")
    got = [r[0] for r in df.select(experiments.stopping_rule(*map(F.col, ("n0", "n1", "lift", "sure", "days")))).collect()]
    assert got == [None, "rollback", "promote", "rollback", None, "promote", "rollback", None]


def test_noise_is_laplace_and_none_without_privacy(spark):
    own = [r[0] for r in spark.range(20_000).select(experiments.laplace(F.col("id").cast("string"), F.lit(2.0))).collect()]
    assert abs(np.median(own)) < 0.1 and abs(np.mean(np.abs(own)) - 2.0) < 0.1
    rows = spark.createDataFrame([(i % 50, i % 10 / 10, int(i % 10 >= 5 or i % 7 == 0)) for i in range(1000)], "u long, p double, y int")
    got = {r["epsilon"]: r for r in experiments.privacy_utility(rows, "u", "p", "y", [0.01, float("inf")], clip=1000.0).collect()}
    truth = sum(max(sum(y for _, y in own), sum(1 - y for _, y in own)) for own in ([(i, int(i % 10 >= 5 or i % 7 == 0)) for i in range(b, 1000, 10)] for b in range(10))) / 1000
    assert set(got) == {"0.01", "inf"} and got["inf"]["accuracy"] == round(truth, 6) and got["0.01"]["auc"] < got["inf"]["auc"]


def test_cross_validation_uses_the_hash_folds(spark):
    rows = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 20 > 9).cast("int").alias("label"))
    sizes = {r["f"]: r["count"] for r in rows.groupBy(folds("id", 5).alias("f")).count().collect()}
    got = experiments.cross_validated(rows, "id", ["a"], "label").collect()
    assert {r["fold"]: r["n"] for r in got} == sizes and min(r["auc"] for r in got) == 1.0 and len({r["parameter"] for r in got}) == 1


def test_suite_passes_by_share(spark):
    rows = [(str(i), i > 0, 0.0) for i in range(20)]
    df = spark.createDataFrame(rows, "check_name string, passed boolean, value double")
    assert validate.overall(df).collect()[0][0] and not validate.overall(df, strict=True).collect()[0][0] and not validate.overall(df.limit(10)).collect()[0][0]
    names = {r["check_name"]: r["passed"] for r in plans.ten_checks(spark, "/root/testdata/sf0.001").collect()}
    assert len(names) == 10 and not names["duplicates"] and names["nulls"]


def test_models_apart(spark):
    df = spark.createDataFrame([(0.2, 0.8, None), (0.6, 0.7, 0.9), (0.4, None, None)], "a double, b double, c double")
    own = [F.col(c) for c in "abc"]
    got = df.select(F.round(S.null_variance(own), 6), S.disagree(own, 0.5)).collect()
    assert [tuple(r) for r in got] == [(0.09, True), (0.015556, False), (0.0, False)]
    shares = spark.range(1).select(S.softmax([F.lit(1000.0), F.lit(1000.0), F.lit(-1000.0)])).collect()[0][0]
    assert shares == [0.5, 0.5, 0.0]


def test_zstandard_lines_of_all_kinds(spark, tmp_path):
    lines = b'{"x": 1}\n\n  \n{"x": \n\xff\xfe\n{"x": 2}'
    whole = zstandard.ZstdCompressor().compress(lines) + zstandard.ZstdCompressor().compress(b'\n{"x": 3}\n')
    (tmp_path / "a.zst").write_bytes(whole)
    long = b'{"x": 4, "y": "' + b"z" * 300_000 + b'"}\n'
    cut = zstandard.ZstdCompressor().compress(long + bytes(np.random.default_rng(1).integers(97, 120, 500_000).astype(np.uint8)))
    (tmp_path / "b.zst").write_bytes(cut[: len(cut) - 100])
    (tmp_path / "c.zst").write_bytes(b"")
    good, broken = readers.read_zstd_lines(spark, str(tmp_path.as_uri()), "x long", chunk=1000)
    assert sorted(r["x"] for r in good.collect()) == [1, 2, 3, 4]
    assert sorted((r["value"] or "").strip() for r in broken.collect()) == ["", '{"x":', "��"]


def test_a_large_frame_streams_in_chunks(tmp_path):
    """200 MB of text in one small frame: no more than a chunk and a line of it are held."""
    body = (b'{"x": 1}' + b" " * 991 + b"\n") * 200
    engine, path = zstandard.ZstdCompressor().compressobj(), tmp_path / "big.zst"
    with path.open("wb") as out:
        for _ in range(1000):
            out.write(engine.compress(body))
        out.write(engine.flush())
    reader = datasources.ZstdLinesReader(path.as_uri(), 4096)
    rows = most = 0
    for batch in reader.read(reader.partitions()[0]):
        rows += len(batch)
        most = max(most, len(batch))
        if rows > 20_000:
            break
    assert rows > 20_000 and most * 1000 < 64 << 20


def test_arrow_blocks(spark, tmp_path):
    table = pa.table({"a": list(range(100)), "b": [str(i) for i in range(100)], "c": [i / 2 for i in range(100)]})
    with pa.ipc.new_file(str(tmp_path / "x.arrow"), table.schema) as out:
        for i in range(0, 100, 10):
            out.write_batch(table.slice(i, 10).to_batches()[0])
    df = readers.read_arrow(spark, tmp_path.as_uri(), ["c", "a"], batches=3)
    assert df.columns == ["c", "a"] and df.select(F.spark_partition_id()).distinct().count() == 4
    assert sorted(tuple(r) for r in df.collect()) == [(i / 2, i) for i in range(100)]
    assert readers.read_arrow(spark, tmp_path.as_uri()).count() == 100


def test_nested_json_search(spark):
    rows = [(1, '{"k": {"k": [1, {"z": {"k": "a,\\"k\\": b"}}]}, "t": "\\"k\\": 9"}'), (2, "[[{\"k\": null}], 5]"), (3, '"k"'), (4, "no json"), (5, None), (6, "{}")]
    df = spark.createDataFrame(rows, "path long, value string")
    got = sorted((r[0], r[1], r[2]) for r in readers.find_in_json(df, "value", "k", ["path"]).collect())
    assert got == [(1, "$.k", '{"k":[1,{"z":{"k":"a,\\"k\\": b"}}]}'), (1, "$.k.k", '[1,{"z":{"k":"a,\\"k\\": b"}}]'), (1, "$.k.k[1].z.k", '"a,\\"k\\": b"'), (2, "$[0][0].k", "null")]


def test_tables_in_the_store(spark, tmp_path):
    path = tmp_path.as_uri()
    writers.replace_table(spark.createDataFrame([(1, "a")], "id long, v string"), path)
    (tmp_path / "version=99999999999999999999").mkdir()  # unfinished
    new = spark.createDataFrame([(1, None), (2, None), (3, "c")], "id long, v string")
    writers.replace_table(writers.merge_nodes(writers.read_table(spark, path), new, "id", {"v": F.lit("made")}), path)
    assert sorted(tuple(r) for r in writers.read_table(spark, path).collect()) == [(1, "a"), (2, "made"), (3, "c")]
