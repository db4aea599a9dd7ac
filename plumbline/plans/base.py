"""Views that the queries share, as DataFrames and as SQL: posts of users made from ``events``, and edges between users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.registry import table

#: The time "now" of all ages, as a parameter of the queries rather than the clock's.
AS_OF = "2024-02-01 00:00:00"

SOCIAL = """
social AS (SELECT event_id AS post_id, user_id, event_type AS community, ts, value AS score, k, (k - 50) / 50.0::DOUBLE AS sentiment,
  k / 100.0::DOUBLE AS toxicity, k * 7 % 60 AS comments, user_id * 37 % 1000 AS followers, user_id % 10 = 0 AS verified,
  CASE WHEN event_id % 3 > 0 THEN event_id - 1 - (event_id * 13) % 7 END AS parent_id
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))
"""


def social(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts: who, where, when, score, a sentiment in [-1, 1], a toxicity in [0, 1], comments, followers, parent."""
    k = F.col("k")
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.select(
        F.col("event_id").alias("post_id"),
        "user_id",
        F.col("event_type").alias("community"),
        "ts",
        F.col("value").alias("score"),
        "k",
        ((k - 50) / 50.0).alias("sentiment"),
        (k / 100.0).alias("toxicity"),
        (k * 7 % 60).alias("comments"),
        (F.col("user_id") * 37 % 1000).alias("followers"),
        (F.col("user_id") % 10 == 0).alias("verified"),
        F.when(F.col("event_id") % 3 > 0, F.col("event_id") - 1 - (F.col("event_id") * 13) % 7).alias("parent_id"),
    )


EDGES = f"""{SOCIAL}, edges AS (SELECT a.user_id AS src, b.user_id AS dst, CASE a.k % 3 WHEN 0 THEN 'reply' WHEN 1 THEN 'mention' ELSE 'retweet' END AS type,
  a.toxicity AS weight, a.ts AS ts FROM social a JOIN social b ON a.parent_id = b.post_id WHERE a.user_id <> b.user_id)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions: who answered whom, how, with what weight and when; nobody answers themselves."""
    posts = social(spark, sf_dir)
    parents = posts.select(F.col("post_id").alias("parent_id"), F.col("user_id").alias("dst"))
    kind = F.when(F.col("k") % 3 == 0, "reply").when(F.col("k") % 3 == 1, "mention").otherwise("retweet")
    joined = posts.join(parents, "parent_id").where("user_id <> dst")
    return joined.select(F.col("user_id").alias("src"), "dst", kind.alias("type"), F.col("toxicity").alias("weight"), "ts")
