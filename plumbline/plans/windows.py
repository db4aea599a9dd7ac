"""Ordered sequences: temporal features, forecasts, ranks, prefixes and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.scores import decay, reply_weight
from plumbline.functions.text import words
from plumbline.operators.search import CellIndex, WordIndex
from plumbline.operators.temporal import forecast, temporal_features
from plumbline.operators.vectors import best_candidates
from plumbline.plans.base import AS_OF, EDGES, SOCIAL, edges, social
from plumbline.registry import query, table

_FEATURES = ["velocity", "acceleration", "slope", "r2", "mean_7", "std_7", "mean_14", "std_14", "mean_30", "std_30", "gap_mean", "gap_std", "posting_acceleration", "toxicity_trend", "toxicity_peak"]


@query(
    "W01 W02 W03 W04 W05 W06 W07 W08 W09 T01",
    f"""WITH {SOCIAL}, o AS (SELECT *, epoch_us(ts) / 1e6 AS sec, row_number() OVER w - 1.0 AS i, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, post_id DESC) AS from_end FROM social WINDOW w AS (PARTITION BY user_id ORDER BY ts, post_id)),
d AS (SELECT *, sentiment AS s, score AS e, sentiment - lag(sentiment) OVER w AS d1, sentiment - 2 * lag(sentiment) OVER w + lag(sentiment, 2) OVER w AS d2, sec - lag(sec) OVER w AS gap, toxicity - lag(toxicity) OVER w AS dt FROM o WINDOW w AS (PARTITION BY user_id ORDER BY ts, post_id)),
a AS (SELECT user_id, count(*) AS n, avg(d1) AS velocity, avg(d2) AS acceleration, regr_slope(e, i) AS slope, CASE WHEN stddev_pop(e) > 0 THEN regr_r2(e, i) ELSE 1.0 END AS r2,
  avg(s) FILTER (from_end <= 7) AS mean_7, stddev_pop(s) FILTER (from_end <= 7) AS std_7, avg(s) FILTER (from_end <= 14) AS mean_14, stddev_pop(s) FILTER (from_end <= 14) AS std_14,
  avg(s) FILTER (from_end <= 30) AS mean_30, stddev_pop(s) FILTER (from_end <= 30) AS std_30, avg(gap) AS gap_mean, stddev_samp(gap) AS gap_std, -regr_slope(gap, i) AS posting_acceleration, avg(dt) AS toxicity_trend, max(toxicity) FILTER (from_end <= 7) AS toxicity_peak FROM d GROUP BY user_id)
SELECT user_id, n, {", ".join(f"round(CASE WHEN n < 3 THEN {86400.0 if c == 'gap_mean' else 0.0} ELSE coalesce({c}, 0) END, {5 if c.startswith('gap') or c.startswith('posting') else 9})::DOUBLE AS {c}" for c in _FEATURES)} FROM a""",
)
def user_temporal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = temporal_features(social(spark, sf_dir))
    return out.select("user_id", "n", *(F.round(c, 5 if c.startswith(("gap", "posting")) else 9).alias(c) for c in _FEATURES))


def _forecast_sql(key: str) -> str:
    return f"""WITH RECURSIVE daily AS (SELECT {key} AS key, (date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)))::DOUBLE AS i, avg(value) / 2 AS score FROM events GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY i) AS r FROM daily),
s(key, r, level) AS (SELECT key, r, score FROM o WHERE r = 1 UNION ALL SELECT o.key, o.r, s.level * 0.7 + o.score * 0.3 FROM s JOIN o ON o.key = s.key AND o.r = s.r + 1),
g AS (SELECT key, coalesce(regr_slope(score, i), 0) AS slope, coalesce(regr_intercept(score, i), 0) AS b, max(i) AS last_i, stddev_pop(score) AS std, count(*) AS n, arg_max(score, i) AS last FROM daily GROUP BY key),
f AS (SELECT g.*, h, CASE WHEN n < 3 THEN last ELSE least(greatest(0.6 * (level + slope * h) + 0.4 * (b + slope * (last_i + h)), 0), 100) END AS y FROM g JOIN (SELECT key, arg_max(level, r) AS level FROM s GROUP BY key) USING (key), range(1, 8) t(h))
SELECT key AS {key if key != "event_type" else "community"}, round(min(y) FILTER (h = 1), 5) AS next_day, round(min(y) FILTER (h = 7), 5) AS last_day,
  any_value(CASE WHEN n < 3 THEN 'insufficient_data' WHEN slope > 2 THEN 'accelerating' WHEN slope > 0.5 THEN 'increasing' WHEN slope < -2 THEN 'decelerating' WHEN slope < -0.5 THEN 'decreasing' ELSE 'stable' END) AS trend,
  (CASE WHEN any_value(n) >= 3 AND max(y) > any_value(last) THEN arg_max(h, y) END)::INT AS peak_day,
  round(CASE WHEN any_value(n) < 3 THEN 0 ELSE least(greatest(least(any_value(n) / 30.0, 1.0) * (1 - any_value(std) / 50), 0), 1) END, 5)::DOUBLE AS confidence, coalesce(min(h) FILTER (y >= 80), 0)::INT AS crossing FROM f GROUP BY key"""


def _forecasts(spark: SparkSession, sf_dir: str, column: str, name: str) -> DataFrame:
    """Forecasts over daily means, so that a series is as long as its days, whatever the posts."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("double")
    daily = table(spark, sf_dir, "events").groupBy(F.col(column).alias(name), day.alias("i")).agg((F.avg("value") / 2).alias("score"))
    out = forecast(daily, key=name)
    first, last = F.get("forecast", F.lit(0)), F.element_at("forecast", -1)
    return out.select(name, F.round(first, 5).alias("next_day"), F.round(last, 5).alias("last_day"), "trend", "peak_day", F.round("confidence", 5).alias("confidence"), "crossing")


@query("W10 W11 W12 W13 W14 R04", _forecast_sql("event_type"))
def community_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forecasts(spark, sf_dir, "event_type", "community")


@query("W10 W11 W12 W13 W14", _forecast_sql("user_id"))
def user_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the communities', for users, some of whom have too few days for a trend."""
    return _forecasts(spark, sf_dir, "user_id", "user_id")


@query(
    "W15 W16 J27 J29 D05",
    f"""WITH {EDGES}, w AS (SELECT *, floor((epoch(TIMESTAMP '{AS_OF}') - epoch(ts)) / 86400) AS age FROM edges)
SELECT src, dst, type, ts, round(exp(-age / 30.0), 6) AS decayed, round(exp(-age / 30.0) * (1 + least(weight / 100, 1.0)), 6) AS reply_weight FROM w WHERE type IN ('mention', 'reply')""",
)
def edge_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.floor((F.unix_micros(F.lit(AS_OF).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86400e6)
    rows = edges(spark, sf_dir).where(F.col("type").isin("mention", "reply")).withColumn("age", age)
    return rows.select("src", "dst", "type", "ts", F.round(decay(F.col("age")), 6).alias("decayed"), F.round(reply_weight(F.col("age"), F.col("weight")), 6).alias("reply_weight"))


@query(
    "J28 W15",
    f"""WITH {EDGES}, known AS (SELECT user_id FROM social GROUP BY user_id HAVING count(*) >= 2)
SELECT src, dst, count(*) AS n, round(sum(exp(-floor((epoch(TIMESTAMP '{AS_OF}') - epoch(ts)) / 86400) / 30.0)), 6) AS weight FROM edges WHERE type = 'retweet' AND dst IN (SELECT user_id FROM known) GROUP BY src, dst""",
)
def retweet_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from who shared a post to its author, where the author is known; a pair's weight is the sum of its decays."""
    age = F.floor((F.unix_micros(F.lit(AS_OF).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86400e6)
    known = social(spark, sf_dir).groupBy(F.col("user_id").alias("dst")).agg(F.count("*").alias("posts")).where("posts >= 2").select("dst")
    own = edges(spark, sf_dir).where("type = 'retweet'").join(known, "dst", "left_semi")
    return own.groupBy("src", "dst").agg(F.count("*").alias("n"), F.round(F.sum(decay(age)), 6).alias("weight"))


@query(
    "W17 W19",
    f"""WITH {SOCIAL}, u AS (SELECT user_id, count(*) AS n, avg(sentiment) AS s FROM social GROUP BY user_id) SELECT user_id, n, row_number() OVER (ORDER BY n DESC, user_id) AS place FROM u ORDER BY n DESC, user_id LIMIT 50""",
)
def most_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by activity: the top are taken first, and only they are numbered."""
    top = social(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(50)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "user_id")).cast("long"))


@query(
    "T05",
    f"""WITH {SOCIAL} SELECT community, post_id, round(sentiment * score, 6) AS weight FROM social QUALIFY row_number() OVER (PARTITION BY community ORDER BY abs(round(sentiment * score, 6)) DESC, post_id) <= 10""",
)
def heaviest_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten posts of each community with the greatest weight either way; a rank limit, which Spark applies before the shuffle too."""
    order = Window.partitionBy("community").orderBy(F.desc(F.abs("weight")), "post_id")
    rows = social(spark, sf_dir).select("community", "post_id", F.round(F.col("sentiment") * F.col("score"), 6).alias("weight"))
    return rows.withColumn("place", F.row_number().over(order)).where("place <= 10").drop("place")


@query(
    "T02 F17",
    f"""WITH {SOCIAL}, v AS (SELECT post_id, n AS variant, least(toxicity + n * 0.1::DOUBLE, 1.0) AS toxicity, round(toxicity * n / 4.0::DOUBLE - 0.3 * (n = 3)::INT, 6) AS uplift FROM social, range(1, 5) r(n))
SELECT post_id, variant, uplift FROM v WHERE toxicity < 0.7 QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY uplift DESC, variant) <= 2""",
)
def best_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each post's variants within the moderation limit the two with the greatest uplift."""
    n = F.col("variant")
    rows = social(spark, sf_dir).select("post_id", "toxicity", F.explode(F.sequence(F.lit(1), F.lit(4)).cast("array<bigint>")).alias("variant"))
    uplift = F.round(F.col("toxicity") * n / 4 - F.when(n == 3, 0.3).otherwise(0.0), 6)
    passing = rows.where(F.least(F.col("toxicity") + n * F.lit(0.1), F.lit(1.0)) < 0.7).select("post_id", "variant", uplift.alias("uplift"))
    place = F.row_number().over(Window.partitionBy("post_id").orderBy(F.desc("uplift"), "variant"))
    return passing.withColumn("place", place).where("place <= 2").drop("place")


@query(
    "J17 R02 G03",
    """WITH a AS (SELECT o_custkey AS src, string_agg(((o_orderkey * 7) % 1500)::VARCHAR, ',' ORDER BY o_orderkey) AS ids FROM orders GROUP BY 1)
SELECT DISTINCT src, d::BIGINT AS dst FROM a, LATERAL (SELECT unnest(string_split(ids, ',')[1:100]) AS d) WHERE src <> d::BIGINT""",
)
def follow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges to the first hundred ids of each user's array, which is a JSON text; nobody follows themselves."""
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("src")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", ((F.col("o_orderkey") * 7) % 1500).cast("string").alias("id")))).alias("ids"))
    texts = own.select("src", F.to_json(F.transform("ids", lambda x: x["id"])).alias("ids"))
    rows = texts.select("src", F.explode(F.slice(F.from_json("ids", "array<string>"), 1, 100)).alias("dst"))
    return rows.select("src", F.col("dst").cast("long").alias("dst")).where("src <> dst").distinct()


@query(
    "W18 T08 J06",
    f"""WITH {EDGES}, f AS (SELECT src, dst, min(ts) AS first_ts FROM edges GROUP BY src, dst) SELECT src, dst, first_ts FROM f QUALIFY row_number() OVER (PARTITION BY src ORDER BY first_ts, dst) <= 5""",
)
def first_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five users that each user answered; pairs are combined before they are ranked."""
    firsts = edges(spark, sf_dir).groupBy("src", "dst").agg(F.min("ts").alias("first_ts"))
    place = F.row_number().over(Window.partitionBy("src").orderBy("first_ts", "dst"))
    return firsts.withColumn("place", place).where("place <= 5").drop("place")


@query(
    "W20",
    """WITH o AS (SELECT c_custkey, c_acctbal AS x, c_custkey % 2 AS g, row_number() OVER (PARTITION BY c_custkey % 2 ORDER BY c_custkey) AS r FROM customer),
p AS (SELECT n, g, count(*) AS c, avg(x) AS m, var_samp(x) AS v FROM o JOIN range(100, 10001, 100) t(n) ON r <= n GROUP BY n, g HAVING count(*) = n)
SELECT a.n, round((b.m - a.m) / sqrt(a.v / a.c + b.v / b.c), 5) AS t FROM p a JOIN p b ON a.n = b.n AND a.g = 0 AND b.g = 1""",
)
def sequential_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Welch's statistic after each hundred of each group: rows are summed by hundred, and the sums run up.

    Only the first 10,000 of a group are looked at, so a group's rows are cut to them by a limit in every task first.
    """
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 2).alias("g"))
    first = [rows.where(F.col("g") == g).orderBy("c_custkey").limit(10_000) for g in (0, 1)]
    rows = first[0].unionByName(first[1])
    block = F.ceil(F.row_number().over(Window.partitionBy("g").orderBy("c_custkey")) / 100)
    sums = rows.withColumn("n", block * 100).where("n <= 10000").groupBy("g", "n").agg(F.count("*").alias("c"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    run = Window.partitionBy("g").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.select("g", "n", *(F.sum(c).over(run).alias(c) for c in ("c", "s", "q")))
    sums = sums.select("g", "n", "c", (F.col("s") / F.col("c")).alias("m"), ((F.col("q") - F.col("s") * F.col("s") / F.col("c")) / (F.col("c") - 1) / F.col("c")).alias("v"))
    sums = sums.where("c = n").drop("c")  # whole hundreds only
    a, b = sums.where("g = 0"), sums.where("g = 1").select("n", F.col("m").alias("m2"), F.col("v").alias("v2"))
    return a.join(b, "n").select("n", F.round((F.col("m2") - F.col("m")) / F.sqrt(F.col("v") + F.col("v2")), 5).alias("t"))


@query(
    "W21 T09 J24 X27",
    """WITH v AS (SELECT o_custkey AS model, o_orderdate AS created, (o_orderkey % 3) || '.' || (o_orderkey % 5) || '.' || (o_orderkey % 11) AS version, o_totalprice AS metric, o_orderkey FROM orders)
SELECT model, o_orderkey, version, lag(version) OVER w AS previous, round(metric - coalesce(lag(metric) OVER w, 0), 2) AS delta, string_split(max(printf('%03d.%03d.%03d', split_part(version, '.', 1)::INT, split_part(version, '.', 2)::INT, split_part(version, '.', 3)::INT)) OVER (PARTITION BY model), '.')[1]::INT AS top_major FROM v WINDOW w AS (PARTITION BY model ORDER BY created, o_orderkey)""",
)
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    v = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("model"), F.col("o_orderdate").alias("created"), "o_orderkey", F.col("o_totalprice").alias("metric"),
        F.concat_ws(".", (k % 3).cast("string"), (k % 5).cast("string"), (k % 11).cast("string")).alias("version"),
    )
    w = Window.partitionBy("model").orderBy("created", "o_orderkey")
    parts = F.transform(F.split("version", r"\."), lambda x: x.cast("int"))
    return v.select(
        "model", "o_orderkey", "version", F.lag("version").over(w).alias("previous"), F.round(F.col("metric") - F.coalesce(F.lag("metric").over(w), F.lit(0.0)), 2).alias("delta"),
        F.get(F.max(parts).over(Window.partitionBy("model")), F.lit(0)).alias("top_major"),
    )


_WORDS = "list_filter(string_split(trim(regexp_replace(lower(coalesce({0}, '')), '\\s+', ' ', 'g')), ' '), lambda s: s <> '')"


@query(
    "W22 T03 X16",
    f"""WITH q AS (SELECT item_id, list_distinct({_WORDS.format("text")}) AS qs FROM benchmark), d AS (SELECT doc_id, len({_WORDS.format("text")}) AS tokens, unnest(list_distinct({_WORDS.format("text")})) AS w FROM documents),
h AS (SELECT item_id, doc_id, any_value(tokens) AS tokens, count(*) AS hits FROM (SELECT item_id, unnest(qs) AS w FROM q) JOIN d USING (w) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) AS place FROM h QUALIFY place <= 20), c AS (SELECT *, sum(tokens) OVER (PARTITION BY item_id ORDER BY place) AS used FROM r)
SELECT item_id, doc_id, hits, place FROM c WHERE used <= 4000 AND place <= 5""",
)
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by distinct words shared with a query, the best within a budget of tokens: stop at the first that exceeds it.

    An inverted index is read rarest words first, and words and blocks that can't bring a document among the best are skipped.
    """
    top, _ = keyword_top(spark, sf_dir)
    used = F.sum("tokens").over(Window.partitionBy("item_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return top.withColumn("used", used).where("used <= 4000 AND place <= 5").select("item_id", "doc_id", "hits", "place")


def keyword_top(spark: SparkSession, sf_dir: str, k: int = 20) -> tuple[DataFrame, DataFrame]:
    """The best documents of each benchmark item by shared words, and the postings read and there are."""
    q = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(words(F.lower("text"))).alias("ws"))
    d = table(spark, sf_dir, "documents").select("doc_id", words(F.lower("text")).alias("ws"))
    return WordIndex(d.select("doc_id", F.size("ws").alias("tokens"), F.array_distinct("ws").alias("ws")), q).top(q, k)


@query(
    "T04 J22 T06 T10",
    """WITH q AS (SELECT vec_id AS query_id, embedding AS q, label AS query_label FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, query_label, vec_id, label, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::DOUBLE * q[i]::DOUBLE)), 5) AS score FROM q, embeddings WHERE vec_id <> query_id)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place, (label = query_label) AS same FROM s QUALIFY place <= 5""",
)
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of each query by dot product. Queries are a stated set, which all rows pass."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("query_label"))
    rows = best_candidates(e.select("vec_id", "embedding", "label"), q, "vec_id", "embedding", "query_id", "q", 5, "dot")
    rows = rows.select("query_id", "vec_id", F.round("score", 5).alias("score"), (F.col("label") == F.col("query_label")).alias("same"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("place", F.row_number().over(order).cast("long")).where("place <= 5").select("query_id", "vec_id", "score", "place", "same")


def _cells(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    index = CellIndex(e, "vec_id", "embedding")
    probes, _ = index.measured_probes(5, metric)
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("k"), F.col("embedding").cast("array<double>").alias("v"))
    found = index.search(queries, 5, probes, metric)
    return found.select("query_id", F.col("k").alias("vec_id"), F.round(F.abs("score") if metric != "dot" else "score", 5).alias("score"), "place")


@query("T04 J22 T06 T10")
def vector_search_in_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``vector_search``, from an index of cells: as many are read as give a measured recall of 0.95."""
    return _cells(spark, sf_dir, "dot")


@query("J15")
def nearest_nodes_in_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir, "euclid").withColumnRenamed("score", "distance")


@query(
    "J15",
    """WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, round(sqrt(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: (embedding[i]::DOUBLE - q[i]::DOUBLE) ** 2))), 5) AS distance FROM q, embeddings WHERE vec_id <> query_id)
SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS place FROM s QUALIFY place <= 5""",
)
def nearest_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest other vectors of each query by Euclidean distance; queries are a stated set, which all rows pass."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    rows = best_candidates(e.select("vec_id", "embedding"), q, "vec_id", "embedding", "query_id", "q", 5, "euclid")
    rows = rows.select("query_id", "vec_id", F.round("score", 5).alias("distance"))
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), "vec_id")
    return rows.withColumn("place", F.row_number().over(order).cast("long")).where("place <= 5")


@query(
    "W23 Z14",
    f"""WITH {SOCIAL} SELECT community, post_id, toxicity FROM social QUALIFY row_number() OVER (PARTITION BY community ORDER BY ts DESC, post_id DESC) <= 100""",
)
def recent_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred most recent posts of each community; a rank limit, which Spark applies before the shuffle too."""
    order = Window.partitionBy("community").orderBy(F.desc("ts"), F.desc("post_id"))
    return social(spark, sf_dir).withColumn("place", F.row_number().over(order)).where("place <= 100").select("community", "post_id", "toxicity")


@query(
    "Z11",
    f"""WITH {SOCIAL} SELECT post_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS recent,
  count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) <= 3 AS allowed FROM social""",
)
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sliding log: posts of the user in the six hours up to each, and whether that is within the limit."""
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-6 * 3600 * 1_000_000, 0)
    rows = social(spark, sf_dir).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return rows.select("post_id", "user_id", F.count("*").over(w).alias("recent")).withColumn("allowed", F.col("recent") <= 3)
