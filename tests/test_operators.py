"""Edge cases of the operators, against values worked out by hand."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import scores as S
from plumbline.functions import text as X
from plumbline.operators import joins, labels, sampling, stats, temporal, vectors
from plumbline.sources import readers, writers
from plumbline.streaming import streams


def values(df):
    return [tuple(r) for r in df.collect()]


def test_word_count(spark):
    df = spark.createDataFrame([("",), ("  ",), (None,), ("a",), ("a  b",)], "t string")
    assert [r[0] for r in df.select(X.word_count(F.col("t"))).collect()] == [0, 0, 0, 1, 2]


def test_anonymize_order(spark):
    text = "a.b@c.org 555-123-4567 555.123.4567 5551234567 4111 1111 1111 1111 4111-1111-1111-1111"
    df = spark.createDataFrame([(text,)], "t string")
    assert values(df.select(X.anonymize(F.col("t")))) == [("[EMAIL] [PHONE] [PHONE] [PHONE] [CARD] [CARD]",)]


def test_clean_flags(spark):
    df = spark.createDataFrame([("Hi  @Bob\thttps://x.y/z www.a.b #Tag é\n!",)], "t string")
    own = df.select(X.clean(F.col("t")), X.clean(F.col("t"), mentions=True, hashtags=True, lower=False))
    assert values(own) == [("hi @bob #tag é !", "Hi é !")]


def test_keywords(spark):
    df = spark.createDataFrame([("cancelled",), ("please cancel",), ("scancel cancel cancel cancel",)], "t string")
    t = F.col("t")
    own = df.select(X.distinct_hits(t, ["cancel", "x"]), X.whole_word_hits(t, ["cancel"]))
    assert values(own) == [(1, 0), (1, 1), (1, 3)]


def test_bands_at_the_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.3,), (0.7,), (1.0,), (None,)], "x double")
    assert [r[0] for r in df.select(S.tercile_band(F.col("x"))).collect()] == ["low", "low", "mid", "high", None]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (2.0,)], "x double")
    assert [r[0] for r in df.select(S.clip(F.col("x"), 0, 1)).collect()] == [None, 0.0, 1.0]


def test_ab_bucket_equals_big_integers(spark):
    import hashlib

    df = spark.range(200)
    got = {r[0]: r[1] for r in df.select("id", S.ab_bucket(F.col("id"), "e", 0.3)).collect()}
    for i, bucket in got.items():
        n = int(hashlib.md5(f"e:{i}".encode()).hexdigest(), 16) % 65535
        assert bucket == ("treatment" if n < int(65535 * 0.3) else "control")


def test_asof_join(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 10), (3, "a", 11), (4, "b", 10), (5, None, 1)], "id long, k string, t long")
    right = spark.createDataFrame([("a", 10, "x", 1), ("a", 10, "y", 2), ("c", 1, "z", 1)], "k string, t long, v string, n long")
    out = joins.asof_join(left, right, "k", "t", "t", ["v"], ["n"])
    assert sorted(values(out.select("id", "v"))) == [(1, None), (2, "y"), (3, "y"), (4, None), (5, None)]


def test_interval_join_edges(spark):
    rows = spark.createDataFrame([(1, "a", 0), (2, "a", 10), (3, "a", 21), (4, "b", 5), (5, "a", 0)], "id long, k string, t long")
    pairs = joins.interval_join(rows, rows, "k", "t", "t", 10).where("a_id < b_id").select("a_id", "b_id")
    assert sorted(values(pairs)) == [(1, 2), (1, 5), (2, 5)]


def test_jaccard_self_join(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (2, "y"), (3, "x"), (2, "y")], "i long, g string")
    assert values(joins.jaccard_self_join(rows, "i", "g", 2)) == [(1, 2, 2, 1.0)]


def test_k_hop(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    assert sorted(values(joins.k_hop(e, F.col("node") == 1, 2))) == [(1, 0), (2, 1), (3, 2)]


def test_dense_ids(spark):
    df = spark.createDataFrame([(30,), (10,), (20,), (10,)], "x long")
    assert sorted(values(joins.dense_ids(df, "x"))) == [(10, 0), (20, 1), (30, 2)]


@pytest.mark.parametrize("sizes", [(1, 9, 10, 11)])
def test_split_floors(spark, sizes):
    rows = [(f"{s}-{i}", str(s)) for s in sizes for i in range(s)]
    df = spark.createDataFrame(rows, "id string, g string")
    out = sampling.split_strata(df, ["g"], "id", {"train": 0.8, "val": 0.1, "test": 0.1}).groupBy("g", "split").count()
    got = {(r["g"], r["split"]): r["count"] for r in out.collect()}
    for s in sizes:
        train, val = math.floor(s * 0.8), math.floor(s * 0.1)
        assert [got.get((str(s), k), 0) for k in ("train", "val", "test")] == [train, val, s - train - val]


def test_dedup_first(spark):
    df = spark.createDataFrame([(2, "a", None), (1, "a", "x"), (3, "b", "y")], "id long, k string, v string")
    assert sorted(values(sampling.dedup_first(df, ["k"], ["id"]))) == [(1, "a", "x"), (3, "b", "y")]


def test_votes(spark):
    rows = spark.createDataFrame([(1, 1, 1), (-1, -1, -1), (1, 0, -1), (0, -1, -1)], "a int, b int, c int")
    functions = [labels.LabelingFunction(f"lf_{c}", w, F.col(c)) for c, w in (("a", 1.0), ("b", 1.0), ("c", 2.0))]
    out = labels.weak_label(rows, functions).select("weak_label", "confidence")
    assert values(out) == [(1, 1.0), (-1, 0.0), (-1, 0.0), (0, 0.25)]


def test_temporal_defaults_and_constant(spark):
    rows = [("few", i, i, 0.5, 0.1, 3.0) for i in range(2)] + [("same", i, i, 0.5, 0.1, 3.0) for i in range(4)]
    df = spark.createDataFrame(rows, "user_id string, post_id long, s long, sentiment double, toxicity double, score double").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["user_id"]: r for r in temporal.temporal_features(df).collect()}
    assert (got["few"]["gap_mean"], got["few"]["slope"]) == (86400.0, 0.0)
    assert (got["same"]["gap_mean"], got["same"]["slope"], got["same"]["r2"]) == (1.0, 0.0, 1.0)


def test_psi_identical_and_disjoint(spark):
    same = spark.createDataFrame([(float(i), g) for i in range(10) for g in (0, 1)], "x double, g int")
    assert abs(stats.psi(same, "x", "g").collect()[0]["psi"]) < 1e-9
    apart = spark.createDataFrame([(float(i + 100 * g), g) for i in range(10) for g in (0, 1)], "x double, g int")
    assert stats.psi(apart, "x", "g").collect()[0]["psi"] > 1


def test_ks_and_auc(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "p double, y int")
    assert stats.roc_auc(df, "p", "y").collect()[0][0] == 0.75
    assert stats.ks_statistic(df, "p", "y").collect()[0][0] == 0.5


def test_running_sums_and_quantiles_by_range(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(g, float(x)) for g in ("a", None, "one") for x in (rng.integers(0, 300, 1 if g == "one" else 2001))] + [("a", None)] * 5
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    shares = [0.0, 0.05, 0.5, 0.8, 0.99, 1.0]
    for row in stats.quantiles(df, "x", shares, "g").collect():
        want = np.quantile([x for g, x in rows if g == row["g"] and x is not None], shares)
        assert np.allclose(row["q"], want, rtol=0, atol=1e-9)
    assert stats.quantiles(df, "x", shares, "g").count() == 3
    assert np.allclose(stats.quantiles(df, "x", shares).collect()[0]["q"], np.quantile([x for _, x in rows if x is not None], shares))
    assert stats.quantiles(df.where("false"), "x", [0.5]).collect()[0]["q"] == [None]
    counts = df.where("x IS NOT NULL").groupBy("x").count()
    below = 0
    for row in stats.own_and_below(counts, ["x"], ["count"]).orderBy("x").collect():
        assert row["count_below"] == below
        below += row["count"]


def test_circuit_breaker(spark):
    import random

    chance = random.Random(5)
    calls = [(k, i, chance.choice([True, True, False, None])) for k in (1, 2, 3, None) for i in range(1, 400 if k == 2 else 30)]
    want = {}
    for k in {c[0] for c in calls}:
        state, fails, waited = "closed", 0, 0
        for _, _, bad in sorted((c for c in calls if c[0] == k), key=lambda c: c[1]):
            if state == "open":
                waited += 1
                if waited >= 5:
                    state = "half_open"
            elif bad:
                fails += 1
                if state == "half_open" or fails >= 3:
                    state, fails, waited = "open", 0, 0
            else:
                state, fails = "closed", 0
        want[k] = state
    df = spark.createDataFrame(calls, "k long, i long, bad boolean").repartition(5)
    out = streams.circuit_breaker(df, "k", "i", "bad")
    assert dict(values(out)) == want and out.columns == ["k", "state"]
    assert values(streams.circuit_breaker(df.where("false"), "k", "i", "bad")) == []


def test_near_neighbours_recall(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    points = (rng.normal(size=(40, 16))[rng.integers(0, 40, 1600)] + 0.15 * rng.normal(size=(1600, 16))).round(4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "id long, v array<double>").repartition(4)
    square = ((points[:, None, :] - points[None]) ** 2).sum(2) + np.diag(np.full(1600, np.inf))
    exact = np.argsort(square, axis=1)[:, :5]
    found = {}
    for i, j in values(vectors.near_neighbours(df, "id", "v", 5, dims=16).select("id", "neighbour")):
        found.setdefault(i, set()).add(j)
    assert np.mean([len(found.get(i, set()) & set(exact[i].tolist())) / 5 for i in range(1600)]) >= 0.9
    few = vectors.near_neighbours(df.where("id < 300"), "id", "v", 5, dims=16).groupBy("id").count()
    assert {r[1] for r in few.collect()} == {5} and few.count() == 300


def test_queries_in_blocks(spark):
    df = spark.range(50).selectExpr("id AS k")
    queries = spark.range(0, 50, 10).selectExpr("id AS q")
    assert sum(b.count() for b in vectors.query_blocks(queries, "q", rows=2)) == 5
    assert vectors.against_all(df, queries, "k", "q").count() == 5 * 49


def test_student_p(spark):
    df = spark.createDataFrame([(2.0, 10.0)], "t double, df double").select(stats.student_p("t", "df"))
    assert abs(df.collect()[0][0] - 0.07338803) < 1e-7


def test_sinks(spark):
    known = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, None), (3, "c"), (3, "c")], "id long, v string")
    assert sorted(values(writers.insert_new(known, new, ["id"]))) == [(3, "c")]
    assert sorted(values(writers.merge_nodes(known, new.distinct(), "id"))) == [(1, "a"), (2, "b"), (3, "c")]
    assert len(values(writers.upsert(known, new.distinct(), ["id"]))) == 3


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": 1}\n{"x": \n\n{"y": 2}\n')
    good, bad = readers.read_json_lines(spark, str(tmp_path), "x long")
    assert sorted(values(good), key=repr) == [(1,), (None,)]
    assert values(bad) == [('{"x": ',)]


def test_unknown_format(spark):
    with pytest.raises(readers.UnknownFormat):
        readers.read_any(spark, "x.unknown")
    with pytest.raises(FileNotFoundError):
        readers.first_existing(spark, ["/none/such"])
