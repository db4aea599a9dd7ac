"""Scans in stretches where one key has a third of the rows, and features against values worked out by hand."""

from __future__ import annotations

import random
from contextlib import contextmanager

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators import joins, labels, stats, temporal
from plumbline.operators.sampling import by_range
from plumbline.sources.readers import edge_name


@contextmanager
def set_to(spark, **values):
    """Session settings for a while."""
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


MANY = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


def hot_posts(spark, n=3000):
    chance = random.Random(4)
    rows = [("hot" if chance.random() < 0.35 else chance.choice([f"u{chance.randint(0, 400)}", "few"] if i < 2 else [f"u{chance.randint(0, 400)}"]), i, chance.randint(0, n), round(chance.uniform(-1, 1), 3), chance.choice([None, 0.25, 0.5]), round(chance.uniform(0, 100), 2)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "user_id string, post_id long, s long, sentiment double, toxicity double, score double").withColumn("ts", F.timestamp_seconds("s"))


def plain_features(posts):
    """The features of one user's posts in order, with numpy."""
    s, x, t, e = (np.array([p[i] or 0.0 for p in posts], float) for i in (3, 2, 4, 5))
    if len(posts) < 3:
        return {"velocity": 0.0, "gap_mean": 86400.0, "slope": 0.0, "mean_7": 0.0}
    gaps = np.diff(x)
    slope, at = np.polyfit(np.arange(len(e)), e, 1)
    rest = e - (slope * np.arange(len(e)) + at)
    return {
        "velocity": np.diff(s).mean(), "acceleration": np.diff(s, 2).mean(), "slope": slope, "r2": 1 - (rest**2).sum() / ((e - e.mean()) ** 2).sum(), "mean_7": s[-7:].mean(), "std_30": s[-30:].std(),
        "gap_mean": gaps.mean(), "gap_std": gaps.std(ddof=1) if len(gaps) > 1 else 0.0, "posting_acceleration": -np.polyfit(np.arange(len(gaps)), gaps, 1)[0] if len(gaps) > 1 else 0.0,
        "toxicity_trend": np.diff(t).mean(), "toxicity_peak": t[-7:].max(),
    }


def test_features_of_a_hot_user(spark):
    with set_to(spark, **MANY):
        rows, df = hot_posts(spark)
        sizes = [r["count"] for r in by_range(df, ["user_id", "ts", "post_id"]).groupBy("__range").count().collect()]
        assert len(sizes) == 9 and max(sizes) < 2 * len(rows) / 9
        got = {r["user_id"]: r for r in temporal.temporal_features(df).collect()}
    users = {}
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        users.setdefault(r[0], []).append(r)
    assert set(got) == set(users) and len(users["hot"]) > 900
    for user, own in users.items():
        assert got[user]["n"] == len(own)
        for name, value in plain_features(own).items():
            assert abs(got[user][name] - value) < 1e-6, (user, name)


def test_asof_join_of_a_hot_key(spark):
    chance = random.Random(9)
    key = lambda: "hot" if chance.random() < 0.4 else chance.choice([None, *"abcdef"])
    left = [(i, key(), chance.randint(0, 2000)) for i in range(1500)]
    right = [(key(), chance.randint(0, 2000), i, chance.choice([None, f"v{i}"])) for i in range(400)]
    with set_to(spark, **MANY):
        a = spark.createDataFrame(left, "id long, k string, t long").repartition(3)
        b = spark.createDataFrame(right, "k string, at long, n long, v string").repartition(2)
        got = {r["id"]: (r["v"], r["n"]) for r in joins.asof_join(a, b, "k", "t", "at", ["v", "n"], ["n"]).collect()}
    assert len(got) == len(left)
    for i, k, t in left:
        before = [r for r in right if r[0] == k and r[1] <= t]
        last = max(before, key=lambda r: (r[1], r[2]), default=None)
        assert got[i] == ((last[3], last[2]) if last else (None, None))


def test_a_trend_of_engagement(spark):
    rows = [("up", i, i, 0.0, None, 10.0 * i) for i in range(4)]
    df = spark.createDataFrame(rows, "user_id string, post_id long, s long, sentiment double, toxicity double, score double").withColumn("ts", F.timestamp_seconds("s"))
    row = temporal.temporal_features(df).collect()[0]
    assert (round(row["slope"], 9), round(row["r2"], 9), row["toxicity_peak"], row["toxicity_trend"]) == (10.0, 1.0, 0.0, 0.0)


def test_names_of_trends(spark):
    series = {"two": [50, 60], "up": [0, 10, 20], "rising": [0, 1, 2], "flat": [5, 5, 5], "falling": [2, 1, 0], "down": [80, 40, 0]}
    df = spark.createDataFrame([(k, float(i), float(v)) for k, own in series.items() for i, v in enumerate(own)], "k string, i double, score double")
    got = {r["k"]: r for r in temporal.forecast(df, key="k", steps=3).collect()}
    names = {"two": "insufficient_data", "up": "accelerating", "rising": "increasing", "flat": "stable", "falling": "decreasing", "down": "decelerating"}
    assert {k: r["trend"] for k, r in got.items()} == names
    assert (got["two"]["forecast"], got["two"]["peak_day"], got["two"]["confidence"]) == ([60.0] * 3, None, 0.0)
    # smoothed 0, 3, 8.1; slope 10: 0.6 * (8.1 + 10 h) + 0.4 * (10 * (2 + h))
    assert [round(x, 6) for x in got["up"]["forecast"]] == [22.86, 32.86, 42.86] and got["up"]["peak_day"] == 3
    assert got["flat"]["peak_day"] is None


def test_seven_votes(spark):
    names = ("engagement", "sentiment", "toxicity", "severe", "comments", "communities", "days", "actions", "hedges")
    rows = [
        (501, -0.41, 0.61, 0.0, 51, 3, 3, 2, 0),  # all for: 12 of 12
        (19, 0.21, 0.19, 0.09, 4, 0, 0, 0, 2),  # all against
        (100, 0.0, 0.19, 0.1, 10, 1, 1, 0, 1),  # all abstain: severe 0.1 and one hedge are not enough
        (100, 0.0, 0.0, 0.51, 51, 0, 1, 1, 0),  # toxicity 1.5 and replies 2 for, communities 1 against
    ]
    functions = labels.standard_functions(**{n: n for n in names})
    assert {f.name: f.weight for f in functions} == {"lf_engagement": 2.0, "lf_sentiment": 1.5, "lf_toxicity": 1.5, "lf_action": 3.0, "lf_communities": 1.0, "lf_comments": 2.0, "lf_persistence": 1.0}
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" if n in ("sentiment", "toxicity", "severe") else f"{n} long" for n in names))
    got = [(r["w_pos"], r["w_neg"], r["weak_label"], round(r["confidence"], 6)) for r in labels.weak_label(df, functions).collect()]
    assert got == [(12.0, 0.0, 1, 1.0), (0.0, 12.0, 0, 1.0), (0.0, 0.0, -1, 0.0), (3.5, 1.0, 1, round(2.5 / 12, 6))]


def test_lift_keeps_its_sign(spark):
    df = spark.createDataFrame([(-2.0, 0), (-4.0, 0), (-1.0, 1), (-2.0, 1)], "x double, g int")
    assert stats.welch(df, "x", "g").collect()[0]["lift"] == 0.5


def test_edge_names(spark):
    df = spark.createDataFrame([(x,) for x in ("Follow", "mention", "RETWEET", "reply", "Liked", None)], "t string")
    assert [r[0] for r in df.select(edge_name(F.col("t"))).collect()] == ["follows", "mentions", "retweets", "replies_to", "liked", None]


def test_pairs_where_a_group_has_a_third_of_the_members(spark):
    chance, members = random.Random(2), []
    for i in range(120):
        groups = {0} if i % 3 == 0 else set()
        groups |= {100 + i % 7, 200 + i % 5} if i % 4 else set(chance.sample(range(300, 330), 4))
        members += [(i, g) for g in groups]
    df = spark.createDataFrame([*members, *members[:10]], "i long, g long")
    sets = {}
    for i, g in members:
        sets.setdefault(i, set()).add(g)
    want = {}
    for a in sets:
        for b in sets:
            both = sets[a] & sets[b]
            if a < b and len(both) >= 2:
                want[a, b] = (len(both), round(len(both) / len(sets[a] | sets[b]), 9), sorted(both)[:2])
    for block in (7, 1000):
        rows = joins.jaccard_self_join(df, "i", "g", 2, names=2, block=block).collect()
        assert {(r["a"], r["b"]): (r["common"], round(r["jaccard"], 9), r["names"]) for r in rows} == want and len(rows) == len(want)
    every = joins.pairs_in_groups(spark.createDataFrame(members, "i long, g long"), "i", "g", block=7).collect()
    assert len(every) == len(set(every)) == sum(len(s & sets[b]) for a, s in sets.items() for b in sets if a < b)
