"""Aggregations over posts, edges and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.scores import tercile_band
from plumbline.operators.stats import quantiles
from plumbline.plans.base import EDGES, SOCIAL, edges, social
from plumbline.registry import query, table


def r9(column, name: str):
    return F.round(column, 9).alias(name)


@query(
    "A01 A02 A04 A05 A06 J09",
    f"""WITH {SOCIAL} SELECT user_id, arg_min(followers, (ts, post_id)) AS first_followers, arg_min(verified, (ts, post_id)) AS first_verified, round(avg(sentiment), 9) AS sentiment,
  round(avg(toxicity), 9) AS toxicity, count(*) AS posts, round(count(*) FILTER (score > 100 AND sentiment < -0.3) / count(*)::DOUBLE, 9) AS controversy, count(DISTINCT community) AS communities
FROM social GROUP BY user_id""",
)
def user_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("ts", "post_id")
    return social(spark, sf_dir).groupBy("user_id").agg(
        F.min_by("followers", order).alias("first_followers"),
        F.min_by("verified", order).alias("first_verified"),
        r9(F.avg("sentiment"), "sentiment"),
        r9(F.avg("toxicity"), "toxicity"),
        F.count("*").alias("posts"),
        r9(F.count_if((F.col("score") > 100) & (F.col("sentiment") < -0.3)) / F.count("*"), "controversy"),
        F.countDistinct("community").alias("communities"),
    )


@query(
    "A03 J10",
    f"""WITH {EDGES}, u AS (SELECT DISTINCT user_id FROM social), o AS (SELECT src, count(*) AS n FROM edges GROUP BY src), i AS (SELECT dst, count(*) AS n FROM edges GROUP BY dst)
SELECT u.user_id, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) + coalesce(o.n, 0) AS degree FROM u LEFT JOIN o ON o.src = u.user_id LEFT JOIN i ON i.dst = u.user_id""",
)
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-, out- and total degree of every user, with zeros: both ends in one pass over the edges."""
    users = social(spark, sf_dir).select("user_id", F.lit(0).alias("o"), F.lit(0).alias("i")).distinct()
    e = edges(spark, sf_dir)
    ends = e.select(F.col("src").alias("user_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("user_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    out = users.unionByName(ends).groupBy("user_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return out.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


@query(
    "A16 K17 A07 U06",
    f"""WITH {EDGES}, a AS (SELECT src, dst, type, sum(weight) AS w, count(*) AS n, max(ts) AS latest FROM edges GROUP BY ALL)
SELECT src, dst, type, round(w, 9) AS weight, n, latest, round(w / max(w) OVER (), 9) AS scaled FROM a""",
)
def edge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel edges merged, and weights scaled by the largest; the maximum is one row, not a window over all."""
    merged = edges(spark, sf_dir).groupBy("src", "dst", "type").agg(F.sum("weight").alias("w"), F.count("*").alias("n"), F.max("ts").alias("latest"))
    top = merged.agg(F.max("w").alias("top"))
    return merged.crossJoin(F.broadcast(top)).select("src", "dst", "type", r9(F.col("w"), "weight"), "n", "latest", r9(F.col("w") / F.col("top"), "scaled"))


@query(
    "A08 A09 A35 S20",
    f"""WITH {EDGES}, d AS (SELECT src, count(*) AS n FROM edges GROUP BY src)
SELECT 'users' AS metric, count(DISTINCT user_id)::DOUBLE AS value FROM social UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'edges_' || type, count(*) FROM edges GROUP BY type
UNION ALL SELECT 'avg_degree', round(avg(n), 9) FROM d UNION ALL SELECT 'completion', round(count(*) / 50000.0, 9) FROM social""",
)
def graph_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts, e = social(spark, sf_dir), edges(spark, sf_dir)
    own = [
        posts.agg(F.countDistinct("user_id").cast("double").alias("value")).select(F.lit("users").alias("metric"), "value"),
        e.agg(F.count("*").cast("double").alias("value")).select(F.lit("edges").alias("metric"), "value"),
        e.groupBy("type").count().select(F.concat(F.lit("edges_"), "type").alias("metric"), F.col("count").cast("double").alias("value")),
        e.groupBy("src").count().agg(r9(F.avg("count"), "value")).select(F.lit("avg_degree").alias("metric"), "value"),
        posts.agg(r9(F.count("*") / 50000, "value")).select(F.lit("completion").alias("metric"), "value"),
    ]
    out = own[0]
    for other in own[1:]:
        out = out.unionByName(other)
    return out


@query("A08 T07 T11", f"""WITH {EDGES} SELECT src AS user_id, count(*) AS degree FROM edges GROUP BY src ORDER BY degree DESC, user_id LIMIT 10""")
def top_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).groupBy(F.col("src").alias("user_id")).agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "user_id").limit(10)


@query(
    "A10 A11 A12 A13 A22 A37",
    """SELECT source, lang, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents)::DOUBLE, 9) AS share, count(DISTINCT text) AS distinct_texts, round(avg((n_chars > 1000)::INT), 9) AS long_share
FROM documents GROUP BY source, lang""",
)
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    total = docs.agg(F.count("*").alias("total"))
    counts = docs.groupBy("source", "lang").agg(
        F.count("*").alias("n"), F.countDistinct(F.xxhash64("text"), F.md5(F.col("text").cast("binary"))).alias("distinct_texts"), r9(F.avg((F.col("n_chars") > 1000).cast("int")), "long_share")
    )
    return counts.crossJoin(F.broadcast(total)).select("source", "lang", "n", r9(F.col("n") / F.col("total"), "share"), "distinct_texts", "long_share")


@query(
    "A14 A15 A24 C38",
    f"""WITH {SOCIAL} SELECT community, count(*) AS n, round(avg(score), 9) AS mean, round(median(score), 9) AS median, round(stddev_samp(score), 9) AS std, min(score) AS low, max(score) AS high,
  round(quantile_cont(score, 0.95), 9) AS p95, round(quantile_cont(score, 0.99), 9) AS p99, round(count(*) / (epoch(max(ts)) - epoch(min(ts))), 9) AS per_second FROM social GROUP BY community""",
)
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles, linear between values, by places in ranges, so that a community's values needn't fit in a task."""
    span = (F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))) / 1e6
    posts = social(spark, sf_dir)
    rows = posts.groupBy("community").agg(
        F.count("*").alias("n"), r9(F.avg("score"), "mean"), r9(F.stddev_samp("score"), "std"), F.min("score").alias("low"), F.max("score").alias("high"),
        F.round(F.count("*") / span, 9).alias("per_second"),
    )
    rows = rows.join(quantiles(posts, "score", [0.5, 0.95, 0.99], "community"), "community")
    return rows.select("community", "n", "mean", *(r9(F.get("q", F.lit(i)), n) for i, n in enumerate(("median", "p95", "p99"))), "std", "low", "high", "per_second")


@query(
    "A23 J21",
    """WITH b AS (SELECT l_returnflag AS metric, CASE WHEN l_orderkey % 2 = 0 THEN 'control' ELSE 'treatment' END AS bucket, l_quantity AS x FROM lineitem)
SELECT metric, bucket, count(*) AS n, round(avg(x), 9) AS mean, round(stddev_pop(x), 9) AS std, round(median(x), 9) AS median FROM b GROUP BY ALL""",
)
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.when(F.col("l_orderkey") % 2 == 0, "control").otherwise("treatment").alias("bucket")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("metric"), bucket, F.col("l_quantity").alias("x"))
    return rows.groupBy("metric", "bucket").agg(F.count("*").alias("n"), r9(F.avg("x"), "mean"), r9(F.stddev_pop("x"), "std"), r9(F.percentile("x", 0.5), "median"))


@query(
    "A25 A32",
    f"""WITH {SOCIAL} SELECT community, round(avg((toxicity < 0.7)::INT), 9) AS pass_rate, round(avg(CASE WHEN sentiment > 0 THEN sentiment END), 9) AS avg_uplift, max(sentiment) AS max_uplift,
  count(*) FILTER (sentiment > 0.5) AS successes, count(*) FILTER (sentiment <= 0.5) AS failures, round(sum(score), 2) AS total FROM social GROUP BY community""",
)
def outcome_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("sentiment")
    return social(spark, sf_dir).groupBy("community").agg(
        r9(F.avg((F.col("toxicity") < 0.7).cast("int")), "pass_rate"),
        r9(F.avg(F.when(s > 0, s)), "avg_uplift"),
        F.max(s).alias("max_uplift"),
        F.count_if(s > 0.5).alias("successes"),
        F.count_if(s <= 0.5).alias("failures"),
        F.round(F.sum("score"), 2).alias("total"),
    )


@query(
    "A20 A21 A26 A28 A29 J25",
    """WITH d AS (SELECT d.doc_id, d.text, d.lang, l.toxic, (regexp_matches(lower(coalesce(d.text, '')), 'stupid|idiot|loser|trash|scum'))::INT AS guess FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT count(*) AS n, count(*) FILTER (toxic IS NULL) AS unlabelled, count(*) FILTER (guess = 1 AND toxic = 1) AS tp, count(*) FILTER (guess = 1 AND toxic = 0) AS fp, count(*) FILTER (guess = 0 AND toxic = 1) AS fn,
  count(*) FILTER (guess = 0 AND toxic = 0) AS tn, round(avg((guess = toxic)::INT), 9) AS agreement, count(*) - count(DISTINCT text) AS duplicates, count(*) FILTER (lang IS NULL) AS null_lang FROM d""",
)
def confusion_and_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    guess = F.lower(F.coalesce("text", F.lit(""))).rlike("stupid|idiot|loser|trash|scum").cast("int")
    rows = docs.select("lang", "toxic", guess.alias("g"), F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    g, t = F.col("g"), F.col("toxic")
    return rows.agg(
        F.count("*").alias("n"),
        F.count_if(t.isNull()).alias("unlabelled"),
        *(F.count_if((g == i) & (t == j)).alias(name) for name, i, j in (("tp", 1, 1), ("fp", 1, 0), ("fn", 0, 1), ("tn", 0, 0))),
        r9(F.avg((g == t).cast("int")), "agreement"),
        (F.count("*") - F.countDistinct("h")).alias("duplicates"),
        F.count_if(F.col("lang").isNull()).alias("null_lang"),
    )


@query(
    "A30",
    f"""WITH {SOCIAL}, c AS (SELECT p.post_id, c.user_id, c.sentiment, c.k, c.parent_id FROM social p JOIN social c ON c.parent_id = p.post_id AND c.ts >= p.ts AND c.ts <= p.ts + INTERVAL 24 HOUR)
SELECT post_id, round(count(*) / 24.0, 9) AS per_hour, count(DISTINCT user_id) AS commenters, round(sum(k) / (count(*) + 1.0), 9) AS likes_ratio, round(avg((sentiment < -0.3)::INT), 9) AS controversy, bool_or(k % 3 = 1) AS has_mentions FROM c GROUP BY post_id""",
)
def engagement_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = social(spark, sf_dir)
    p = posts.select("post_id", F.col("ts").alias("posted"))
    c = posts.select(F.col("parent_id").alias("post_id"), "user_id", "sentiment", "k", "ts")
    near = (F.col("ts") >= F.col("posted")) & (F.col("ts") <= F.col("posted") + F.expr("INTERVAL 24 HOURS"))
    return p.join(c, "post_id").where(near).groupBy("post_id").agg(
        r9(F.count("*") / 24, "per_hour"),
        F.countDistinct("user_id").alias("commenters"),
        r9(F.sum("k") / (F.count("*") + 1), "likes_ratio"),
        r9(F.avg((F.col("sentiment") < -0.3).cast("int")), "controversy"),
        F.bool_or(F.col("k") % 3 == 1).alias("has_mentions"),
    )


@query(
    "A31",
    """SELECT round(avg(regexp_matches(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+')::INT), 9) AS leaking FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 100)""",
)
def leak_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a fixed sample of a hundred rows that shows a mail address; the sample is the feature."""
    first = table(spark, sf_dir, "documents").select("doc_id", "text").orderBy("doc_id").limit(100)
    return first.agg(r9(F.avg(F.coalesce("text", F.lit("")).rlike("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+").cast("int")), "leaking"))


@query(
    "A33 Z15",
    f"""WITH {EDGES} SELECT dst AS node, arg_max(weight, (ts, src, type)) AS last_message, max(ts) AS last_update, round(avg(weight), 9) AS mean_message FROM edges GROUP BY dst""",
)
def node_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).groupBy(F.col("dst").alias("node")).agg(
        F.max_by("weight", F.struct("ts", "src", "type")).alias("last_message"), F.max("ts").alias("last_update"), r9(F.avg("weight"), "mean_message")
    )


@query(
    "A34",
    """WITH v AS (SELECT label AS client, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT client, i, avg(x) AS x, count(*) AS n FROM v GROUP BY ALL)
SELECT (i - 1)::INT AS parameter, round(sum(x * n) / sum(n), 5) AS value FROM m GROUP BY i""",
)
def federated_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients' mean parameters, weighted by their samples."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("client"), F.posexplode("embedding").alias("parameter", "x"))
    clients = rows.groupBy("client", "parameter").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    return clients.groupBy("parameter").agg(F.round(F.sum(F.col("x") * F.col("n")) / F.sum("n"), 5).alias("value"))


@query(
    "A36 C25",
    f"""WITH {SOCIAL} SELECT CASE WHEN toxicity <= 0.3 THEN 'low' WHEN toxicity <= 0.7 THEN 'mid' ELSE 'high' END AS level, least(floor(round(toxicity * 20, 9)) + 1, 20)::INT AS bin, count(*) AS n FROM social GROUP BY ALL""",
)
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty even bins of [0, 1], the last one closed."""
    bin_ = F.least(F.floor(F.round(F.col("toxicity") * 20, 9)) + 1, F.lit(20)).cast("int")
    return social(spark, sf_dir).groupBy(tercile_band(F.col("toxicity")).alias("level"), bin_.alias("bin")).agg(F.count("*").alias("n"))


@query(
    "Z16",
    f"""WITH {SOCIAL}, b AS (SELECT unnest([10.0, 50.0, 100.0, 500.0, 'inf'::DOUBLE]) AS le) SELECT community, CASE WHEN isinf(le) THEN '+Inf' ELSE le::VARCHAR END AS le, count(*) FILTER (score <= le) AS n FROM social, b GROUP BY community, b.le""",
)
def cumulative_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts up to each bound: counted into disjoint buckets first, so that the running sum sees a row per bucket."""
    bounds = [10.0, 50.0, 100.0, 500.0]
    place = sum((F.when(F.col("score") > b, 1).otherwise(0) for b in bounds), F.lit(0))
    known = F.explode(F.array(*(F.lit(i) for i in range(len(bounds) + 1))))
    counts = social(spark, sf_dir).groupBy("community", place.alias("i")).agg(F.count("*").alias("c"))
    grid = counts.select("community").distinct().select("community", known.alias("i")).join(counts, ["community", "i"], "left")
    running = F.sum(F.coalesce("c", F.lit(0))).over(Window.partitionBy("community").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    names = F.array(*(F.lit(x) for x in [*map(str, bounds), "+Inf"]))
    return grid.select("community", F.get(names, F.col("i")).alias("le"), running.alias("n"))
