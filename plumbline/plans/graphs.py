"""Joins between posts, users, features and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.scores import half_up
from plumbline.operators.graph import co_members, random_embedding, sage_layer, undirected
from plumbline.operators.joins import asof_join, interval_join, jaccard_self_join, k_hop, pairs_in_groups
from plumbline.plans.base import EDGES, SOCIAL, edges, social
from plumbline.registry import query, table
from plumbline.sources.readers import edge_name


@query(
    "J01 S21",
    """SELECT e.event_id, e.user_id, arg_max(o.o_orderkey, (o.o_orderdate, o.o_orderkey)) AS o_orderkey, arg_max(o.o_totalprice, (o.o_orderdate, o.o_orderkey)) AS o_totalprice
FROM (SELECT *, TIMESTAMP '1992-01-01' + to_days(((event_id * 37) % 3000)::INT) AS at FROM events) e LEFT JOIN orders o ON o.o_custkey = e.user_id AND o.o_orderdate <= e.at GROUP BY e.event_id, e.user_id""",
)
def point_in_time_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest order of the user at each event's time: one sort per user through which values are carried."""
    at = F.expr("timestamp_ntz '1992-01-01 00:00:00' + make_dt_interval(CAST((event_id * 37) % 3000 AS INT))")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", at.cast("timestamp").alias("at"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp").alias("o_orderdate"), "o_orderkey", "o_totalprice")
    return asof_join(e, o, "user_id", "at", "o_orderdate", ["o_orderkey", "o_totalprice"], ["o_orderkey"]).drop("at")


@query(
    "J02 J03 J11 F12",
    f"""WITH {EDGES} SELECT src, dst, count(*) AS replies, min(ts) AS first_ts FROM edges WHERE type = 'reply' GROUP BY src, dst""",
)
def reply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply edges by parent ids that carry a kind's prefix: it is cut off before the join."""
    posts = social(spark, sf_dir).withColumn("parent_ref", F.concat(F.lit("t1_"), F.col("parent_id").cast("string")))
    parents = posts.select(F.col("post_id").cast("string").alias("ref"), F.col("user_id").alias("dst"))
    own = posts.where("k % 3 = 0").withColumn("ref", F.element_at(F.split("parent_ref", "_"), -1))
    return own.join(parents, "ref").where("user_id <> dst").groupBy(F.col("user_id").alias("src"), "dst").agg(F.count("*").alias("replies"), F.min("ts").alias("first_ts"))


@query(
    "J04 J05 U09",
    """WITH m AS (SELECT DISTINCT o_custkey AS i, l_partkey AS g FROM orders JOIN lineitem ON o_orderkey = l_orderkey), n AS (SELECT i, count(*) AS n FROM m GROUP BY i),
c AS (SELECT a.i AS a, b.i AS b, count(*) AS common, array_to_string(list_sort(list(a.g))[1:10], ',') AS names FROM m a JOIN m b ON a.g = b.g AND a.i < b.i GROUP BY ALL HAVING count(*) >= 2)
SELECT a, b, common, names, round(common / (x.n + y.n - common)::DOUBLE, 4) AS jaccard FROM c JOIN n x ON x.i = a JOIN n y ON y.i = b""",
)
def co_purchase_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers by parts bought in common, the first ten of which are named."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    m = o.join(lines, "o_orderkey").select("o_custkey", "l_partkey").distinct()
    pairs = jaccard_self_join(m, "o_custkey", "l_partkey", 2, names=10)
    return pairs.select("a", "b", "common", F.array_join(F.transform("names", lambda x: x.cast("string")), ",").alias("names"), F.round("jaccard", 4).alias("jaccard"))


@query(
    "J07",
    """WITH m AS (SELECT l_partkey AS g, o_custkey AS i FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R') SELECT x.g AS part, x.i AS a, y.i AS b, count(*) AS n FROM m x JOIN m y ON x.g = y.g AND x.i < y.i GROUP BY ALL""",
)
def buyers_of_a_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two buyers who sent a part back, once for each two of their lines."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    return pairs_in_groups(o.join(lines, "o_orderkey"), "o_custkey", "l_partkey").groupBy(F.col("g").alias("part"), "a", "b").agg(F.count("*").alias("n"))


@query(
    "J06 W17",
    f"""WITH {SOCIAL}, m AS (SELECT DISTINCT community AS g, user_id AS i FROM social), c AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY g ORDER BY i) <= 50) SELECT a.i AS a, b.i AS b, a.g, 0.5::DOUBLE AS weight FROM c a JOIN c b ON a.g = b.g AND a.i < b.i""",
)
def co_community_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co_members(social(spark, sf_dir), "user_id", "community", 50).withColumn("weight", F.lit(0.5))


@query(
    "J08",
    f"""WITH {SOCIAL}, s AS (SELECT post_id, user_id, community, epoch_us(ts) AS us FROM social)
SELECT a.post_id AS a_post, b.post_id AS b_post, round(1 - abs(a.us - b.us) / 600e6, 4) AS weight, round((b.us - a.us) / 3600e6, 2) AS hours FROM s a JOIN s b ON a.community = b.community AND a.us < b.us AND a.user_id <> b.user_id AND b.us - a.us <= 600000000""",
)
def temporal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of one community within ten minutes of each other, by different users: an interval join over time buckets.

    Pairs grow with the square of the posts at a time, so a pair's own price counts: figures are rounded as the SQL does, in plain arithmetic.
    """
    p = social(spark, sf_dir).select("post_id", "user_id", "community", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    pairs = interval_join(p, p, "community", "us", "us", 600_000_000, later=True).where("a_user_id <> b_user_id")
    apart = F.col("b_us") - F.col("a_us")
    return pairs.select(F.col("a_post_id").alias("a_post"), F.col("b_post_id").alias("b_post"), half_up(1 - apart / 600e6, 4).alias("weight"), half_up(apart / 3600e6, 2).alias("hours"))


@query(
    "J12",
    f"""WITH RECURSIVE {SOCIAL}, e AS (SELECT a.user_id AS s, b.user_id AS d FROM social a JOIN social b ON a.parent_id = b.post_id WHERE a.user_id <> b.user_id),
u AS (SELECT DISTINCT s, d FROM (SELECT s, d FROM e UNION ALL SELECT d, s FROM e)), r(node, steps) AS (SELECT DISTINCT s, 0 FROM u WHERE s = 8 UNION SELECT u.d, r.steps + 1 FROM r JOIN u ON u.s = r.node WHERE r.steps < 2)
SELECT node, min(steps)::INT AS steps FROM r GROUP BY node""",
)
def neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All users within two steps of a user, with the least number of steps."""
    posts = social(spark, sf_dir)
    parents = posts.select(F.col("post_id").alias("parent_id"), F.col("user_id").alias("dst"))
    e = posts.join(parents, "parent_id").where("user_id <> dst").select(F.col("user_id").alias("src"), "dst")
    return k_hop(e, F.col("node") == 8, 2)


@query(
    "J16",
    f"""WITH {EDGES} SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges)""",
)
def undirected_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return undirected(edges(spark, sf_dir)).toDF("a", "b")


@query(
    "J20 S21 K15",
    """WITH v1 AS (SELECT o_custkey AS id, avg(o_totalprice) AS price, 1.0 AS f FROM orders GROUP BY 1), v2 AS (SELECT c_custkey AS id, 2.0 AS f, c_acctbal AS balance FROM customer WHERE c_custkey % 2 = 0)
SELECT c_custkey AS id, round(v1.price, 8) AS price, coalesce(v2.f, v1.f)::DOUBLE AS f, v2.balance FROM customer c LEFT JOIN v1 ON v1.id = c_custkey LEFT JOIN v2 ON v2.id = c_custkey""",
)
def assembled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per entity over several views; a later view's feature wins."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    v1 = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.avg("o_totalprice").alias("price")).withColumn("f1", F.lit(1.0))
    v2 = c.where("id % 2 = 0").select("id", F.lit(2.0).alias("f2"), F.col("c_acctbal").alias("balance"))
    return c.select("id").join(v1, "id", "left").join(v2, "id", "left").select("id", F.round("price", 8).alias("price"), F.coalesce("f2", "f1").alias("f"), "balance")


@query(
    "J23",
    """WITH e AS (SELECT vec_id AS s, (vec_id * 7 + 3) % 500 AS d FROM embeddings UNION SELECT (vec_id * 7 + 3) % 500, vec_id FROM embeddings), n AS (SELECT * FROM e WHERE s <> d QUALIFY row_number() OVER (PARTITION BY s ORDER BY d) <= 20),
c AS (SELECT s, d, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM n JOIN embeddings a ON a.vec_id = s JOIN embeddings b ON b.vec_id = d)
SELECT s AS node, d AS neighbour, cosine FROM c QUALIFY row_number() OVER (PARTITION BY s ORDER BY cosine DESC, d) <= 10""",
)
def neighbour_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    from plumbline.functions.scores import cosine

    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    e = undirected(v.select(F.col("vec_id").alias("src"), ((F.col("vec_id") * 7 + 3) % 500).alias("dst"))).where("src <> dst")
    e = e.withColumn("p", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where("p <= 20")
    joined = e.join(v.toDF("src", "a"), "src").join(v.toDF("dst", "b"), "dst").select("src", "dst", F.round(cosine(F.col("a"), F.col("b")), 5).alias("cosine"))
    best = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("cosine"), "dst"))
    return joined.withColumn("p", best).where("p <= 10").select(F.col("src").alias("node"), F.col("dst").alias("neighbour"), "cosine")


@query(
    "J24",
    """WITH a AS (SELECT o_orderpriority AS metric, avg(o_totalprice) AS x FROM orders WHERE o_orderkey % 2 = 0 AND o_orderpriority <> '1-URGENT' GROUP BY 1), b AS (SELECT o_orderpriority AS metric, avg(o_totalprice) AS x FROM orders WHERE o_orderkey % 2 = 1 AND o_orderpriority <> '5-LOW' GROUP BY 1)
SELECT coalesce(a.metric, b.metric) AS metric, round(coalesce(b.x, 0) - coalesce(a.x, 0), 4) AS delta FROM a FULL JOIN b ON a.metric = b.metric""",
)
def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("metric"), "o_totalprice")
    a = o.where("o_orderkey % 2 = 0 AND metric <> '1-URGENT'").groupBy("metric").agg(F.avg("o_totalprice").alias("x"))
    b = o.where("o_orderkey % 2 = 1 AND metric <> '5-LOW'").groupBy("metric").agg(F.avg("o_totalprice").alias("y"))
    return a.join(b, "metric", "full").select("metric", F.round(F.coalesce("y", F.lit(0.0)) - F.coalesce("x", F.lit(0.0)), 4).alias("delta"))


@query(
    "J26 W18",
    f"""WITH {EDGES} SELECT user_id, max(followers) AS followers, bool_or(is_author) AS is_author FROM (SELECT user_id, followers, true AS is_author FROM social UNION ALL SELECT dst + 100, 0, false FROM edges WHERE type = 'mention') GROUP BY user_id""",
)
def users_and_mentioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors with their profiles, and users who are only mentioned with an empty one; an author's row wins."""
    authors = social(spark, sf_dir).select("user_id", "followers", F.lit(True).alias("is_author"))
    named = edges(spark, sf_dir).where("type = 'mention'").select((F.col("dst") + 100).alias("user_id"), F.lit(0).cast("long").alias("followers"), F.lit(False).alias("is_author"))
    return authors.unionByName(named).groupBy("user_id").agg(F.max("followers").alias("followers"), F.bool_or("is_author").alias("is_author"))


@query(
    "J30",
    f"""WITH {EDGES}, t AS (SELECT src, dst, CASE WHEN src % 4 = 0 THEN upper(type) WHEN src % 4 = 1 THEN 'Follow' WHEN src % 4 = 2 AND type = 'reply' THEN 'Liked' ELSE type END AS type FROM edges)
SELECT 'twitter_' || src AS source, 'twitter_' || dst AS target, CASE lower(type) WHEN 'follow' THEN 'follows' WHEN 'mention' THEN 'mentions' WHEN 'retweet' THEN 'retweets' WHEN 'reply' THEN 'replies_to' ELSE lower(type) END AS type, count(*) AS n FROM t GROUP BY ALL""",
)
def renamed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions under the names of their edges: types in any case, an unknown one under its own."""
    i, own = F.col("src") % 4, F.col("type")
    typed = F.when(i == 0, F.upper(own)).when(i == 1, "Follow").when((i == 2) & (own == "reply"), "Liked").otherwise(own)
    own = edges(spark, sf_dir).select(F.concat(F.lit("twitter_"), "src").alias("source"), F.concat(F.lit("twitter_"), "dst").alias("target"), edge_name(typed).alias("type"))
    return own.groupBy("source", "target", "type").agg(F.count("*").alias("n"))


@query(
    "C33 C34",
    f"""WITH {EDGES}, a AS (SELECT user_id AS node, 'author' AS kind FROM social UNION ALL SELECT dst, 'target' FROM edges), n AS (SELECT node, min(kind) AS kind FROM a GROUP BY node),
e AS (SELECT src, count(*) AS out_n, round(sum(weight), 6) AS weight FROM edges GROUP BY src) SELECT node, kind, coalesce(out_n, 0) AS out_n, coalesce(weight, 0) AS weight FROM n LEFT JOIN e ON e.src = node""",
)
def interaction_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    nodes = social(spark, sf_dir).select(F.col("user_id").alias("node"), F.lit("author").alias("kind")).unionByName(e.select(F.col("dst").alias("node"), F.lit("target").alias("kind")))
    out = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_n"), F.round(F.sum("weight"), 6).alias("weight"))
    return nodes.groupBy("node").agg(F.min("kind").alias("kind")).join(out, "node", "left").fillna(0, ["out_n"]).fillna(0.0, ["weight"])


@query("C35")
def graph_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random-projection embeddings; the signs are Spark's hashes, which DuckDB lacks."""
    return random_embedding(edges(spark, sf_dir))


@query(
    "C36 A33",
    f"""WITH {EDGES}, p AS (SELECT DISTINCT s, d FROM (SELECT src AS s, dst AS d FROM edges UNION ALL SELECT dst, src FROM edges)), f AS (SELECT user_id, avg(sentiment) AS x, avg(toxicity) AS y FROM social GROUP BY user_id)
SELECT f.user_id AS node, round(any_value(f.x), 9) AS x, round(any_value(f.y), 9) AS y, round(coalesce(avg(g.x), 0), 9) AS near_x, round(coalesce(avg(g.y), 0), 9) AS near_y FROM f LEFT JOIN p ON p.s = f.user_id LEFT JOIN f g ON g.user_id = p.d GROUP BY f.user_id""",
)
def message_passing(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = social(spark, sf_dir).groupBy(F.col("user_id").alias("node")).agg(F.array(F.avg("sentiment"), F.avg("toxicity")).alias("v"))
    out = sage_layer(undirected(edges(spark, sf_dir)), feats)
    return out.select("node", *(F.round(F.get("v", F.lit(i)), 9).alias(n) for i, n in enumerate(("x", "y", "near_x", "near_y"))))
