"""Cases of the fourth round's findings: each failed before its change."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from support import same_rows

from plumbline import catalog
from plumbline.operators import joins


def test_figures_of_pairs_are_rounded_as_the_sql_does(spark, tmp_path):
    """posts that are odd multiples of 30 ms apart, whose weights lie in the middle; no decimals are made for a pair."""
    rows = [(i, i * i * 30_000, i % 7) for i in range(142)]
    at = F.expr("CAST(timestamp_micros(1704067211000000 + us) AS timestamp_ntz)")
    df = spark.createDataFrame(rows, "event_id long, us long, user_id long")
    df = df.select("event_id", at.alias("ts"), "user_id", F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 5}').alias("props"))
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet/*.parquet'")
    own = catalog.queries()["temporal_edges"](spark, str(tmp_path))
    assert own.count() > 7000
    same_rows(own, con, catalog.oracle_sql()["temporal_edges"])
    assert "round(" not in own._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("later", [False, True])
@pytest.mark.parametrize("sizes", [(400, 400), (400, 30), (30, 400)])
def test_rows_of_one_time_are_many_tasks(spark, later, sizes):
    """a cell that is crowded on a side is dealt in blocks, and all its pairs are there once."""
    left, right = (spark.range(n).select("id", (F.col("id") % 2).alias("k"), (F.col("id") * 37 % 12 - 6).alias("at")) for n in sizes)
    got = joins.interval_join(left, right, "k", "at", "at", 4, later=later, block=20)
    found = got.select("a_id", "b_id", F.spark_partition_id()).collect()
    at = lambda i: i * 37 % 12 - 6
    near = lambda d: 0 < d <= 4 if later else abs(d) <= 4
    want = [(a, b) for a in range(sizes[0]) for b in range(sizes[1]) if a % 2 == b % 2 and near(at(b) - at(a))]
    assert sorted(r[:2] for r in found) == sorted(want)
    assert max(Counter(r[2] for r in found).values()) < 0.5 * len(found)
