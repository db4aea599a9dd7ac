"""Projections, predicates, dates, numbers and JSON."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import scores as S
from plumbline.operators.columns import col_or, drop_null_keys, first_present, prefixed, wanted
from plumbline.operators.stats import quantiles
from plumbline.plans.base import AS_OF, SOCIAL, social
from plumbline.registry import query, table


@query(
    "P01 P02 P03 P05 P11 U01",
    """SELECT doc_id::VARCHAR AS sample_id, coalesce(text, '') AS text, source, coalesce(lang, 'unknown') AS language, 'docs' AS platform, 0.5::DOUBLE AS engagement FROM documents
UNION ALL SELECT 'b' || item_id, coalesce(text, ''), 'bench', 'unknown', 'bench', NULL FROM benchmark""",
)
def unify_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    body = first_present(docs, ["body", "content", "text"])
    left = docs.select(
        F.col("doc_id").cast("string").alias("sample_id"),
        F.coalesce(body, F.lit("")).alias("text"),
        "source",
        F.coalesce(col_or(docs, "lang", None), F.lit("unknown")).alias("language"),
        F.lit("docs").alias("platform"),
        col_or(docs, "engagement", 0.5).alias("engagement"),
    )
    right = bench.select(
        F.concat(F.lit("b"), "item_id").alias("sample_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.lit("bench").alias("source"),
        col_or(bench, "lang", "unknown").alias("language"),
        F.lit("bench").alias("platform"),
    )
    return left.unionByName(right, allowMissingColumns=True)


@query(
    "P04 P06 P07 P08 P09",
    """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE c_mktsegment END AS body, trim(coalesce(c_name, '') || ' ' || coalesce(c_mktsegment, '')) AS combined,
  coalesce(try_cast(CASE WHEN c_custkey % 5 = 0 THEN 'bad' ELSE c_acctbal::VARCHAR END AS DOUBLE), 0.0) AS parsed, (c_acctbal > 0)::INT AS flag, (c_acctbal > 0)::INT::DOUBLE AS flag_double FROM customer""",
)
def fallbacks_and_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("selftext", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")))
    raw = F.when(F.col("c_custkey") % 5 == 0, "bad").otherwise(F.col("c_acctbal").cast("string"))
    return c.select(
        "c_custkey",
        F.when(F.col("selftext").isNull(), F.col("c_name")).otherwise(F.col("selftext")).alias("body"),
        F.trim(F.concat_ws(" ", F.coalesce("c_name", F.lit("")), F.coalesce("c_mktsegment", F.lit("")))).alias("combined"),
        raw.try_cast("double").alias("parsed"),
        (F.col("c_acctbal") > 0).cast("int").alias("flag"),
        (F.col("c_acctbal") > 0).cast("int").cast("double").alias("flag_double"),
    ).fillna({"parsed": 0.0})


@query(
    "P10 P12 P13 P14 P15 P16 P18",
    """SELECT p_partkey, p_size::DOUBLE AS f_size, p_retailprice AS f_price, [p_size::DOUBLE, p_retailprice] AS features, p_name AS meta_name, p_size + 0.0::DOUBLE AS meta_size FROM part""",
)
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested fields flattened, numeric columns prefixed and assembled; columns that are wanted but absent are left out."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.struct(F.col("p_name").alias("name"), F.col("p_size").cast("double").alias("size")).alias("meta"), F.col("p_retailprice").alias("price"))
    flat = parts.select("p_partkey", F.col("meta.size").alias("size"), "price", F.col("meta").getField("name").alias("meta_name"))
    flat = prefixed(flat, wanted(flat, ["size", "price", "no_such_column"]), "f_")
    own = [c for c in flat.columns if c.startswith("f_")]
    return flat.withColumn("features", F.array(*own)).withColumn("meta_size", F.col("f_size"))


@query(
    "P17 J14",
    "SELECT l_orderkey, l_linenumber, dense_rank() OVER (ORDER BY l_suppkey) - 1 AS idx FROM lineitem",
)
def dense_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids to 0 .. n - 1 in their order: the distinct ids are numbered, and the numbers joined back."""
    from plumbline.operators.joins import dense_ids

    lines = table(spark, sf_dir, "lineitem")
    return lines.join(dense_ids(lines, "l_suppkey"), "l_suppkey").select("l_orderkey", "l_linenumber", "idx")


@query(
    "F01 F02 F05 F07 F08 F10 F19",
    """SELECT doc_id, length(text)::BIGINT AS n FROM documents WHERE text IS NOT NULL AND length(trim(text)) > 0 AND length(text) BETWEEN 50 AND 5000
  AND n_chars > 100 AND doc_id % 97 <> 5 AND source NOT IN ('src3') AND lang IS NOT NULL""",
)
def keep_valid_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").na.drop(subset=["text", "lang"])
    kept = docs.where((F.length(F.trim("text")) > 0) & F.length("text").between(50, 5000) & (F.col("n_chars") > 100))
    return kept.where((F.col("doc_id") % 97 != 5) & ~F.col("source").isin("src3")).select("doc_id", F.length("text").cast("long").alias("n"))


_DATES = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN 'garbage' WHEN 2 THEN NULL ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' END AS d, ts FROM events"""


@query(
    "F03 F04 D02",
    f"""WITH e AS ({_DATES}), p AS (SELECT *, CASE WHEN regexp_matches(d, '^\\d{{4}}') THEN date_trunc('second', ts) END AS t FROM e)
SELECT event_id, d, d >= '2024-01-05' AND d <= '2024-01-08' AS string_range, t IS NULL OR t BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-08' AS parsed_range FROM p WHERE d IS NOT NULL""",
)
def date_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two date filters: by string order, which leaves out most of the last day; and by time, which keeps what can't be parsed."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("event_id") % 4
    e = table(spark, sf_dir, "events").withColumn("d", F.when(k == 0, iso).when(k == 1, "garbage").when(k == 3, F.concat(iso, F.lit("Z"))))
    t = F.coalesce(F.try_to_timestamp("d", F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp("d", F.lit("yyyy-MM-dd'T'HH:mm:ssX")))
    inside = t.isNull() | t.between(F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-08").cast("timestamp"))
    return e.where("d IS NOT NULL").select("event_id", "d", F.col("d").between("2024-01-05", "2024-01-08").alias("string_range"), inside.alias("parsed_range"))


@query(
    "D01 D02 D03 D05",
    f"""SELECT event_id, epoch_us(date_trunc('second', ts)) // 1000000 AS epoch, date_trunc('second', ts) AS parsed, hour(ts)::INT AS hour, (isodow(ts) - 1)::INT AS weekday,
  floor((epoch(TIMESTAMP '{AS_OF}') - epoch(ts)) / 86400)::BIGINT AS age_days FROM events""",
)
def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch seconds, the legacy "weekday month day time zone year" form parsed without its weekday, hour, weekday, age."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    legacy = F.date_format("ts", "EEE MMM dd HH:mm:ss Z yyyy")
    parsed = F.try_to_timestamp(F.substring_index(legacy, " ", -5), F.lit("MMM dd HH:mm:ss Z yyyy")).cast("timestamp_ntz")
    age = F.floor((F.unix_micros(F.lit(AS_OF).cast("timestamp")) - F.unix_micros("ts")) / F.lit(86400e6))
    return e.select(
        "event_id",
        F.unix_seconds("ts").alias("epoch"),
        parsed.alias("parsed"),
        F.coalesce(F.hour("ts"), F.lit(12)).alias("hour"),
        F.coalesce(F.weekday("ts"), F.lit(0)).alias("weekday"),
        age.alias("age_days"),
    )


@query(
    "D04 D06",
    f"""WITH {SOCIAL} SELECT post_id, round(comments / greatest((epoch(TIMESTAMP '{AS_OF}') - epoch(ts)) / 3600, 0.5), 6) AS velocity,
  epoch(ts) < 1.2e9 OR ts > TIMESTAMP '{AS_OF}' AS odd_date FROM social""",
)
def comment_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.unix_micros(F.lit(AS_OF).cast("timestamp"))
    own = F.unix_micros(F.col("ts").cast("timestamp"))
    hours = F.greatest((now - own) / 3600e6, F.lit(0.5))
    odd = (own < F.lit(1.2e9) * 1e6) | (own > now)
    return social(spark, sf_dir).select("post_id", F.round(F.col("comments") / hours, 6).alias("velocity"), odd.alias("odd_date"))


@query(
    "N01 N02 N05 N06 N12 F14",
    f"""WITH {SOCIAL} SELECT post_id, round(least(greatest(score / 100, 0), 1), 6) AS clipped,
  CASE WHEN toxicity > -0.01 AND toxicity <= 0.3 THEN 'low' WHEN toxicity > 0.3 AND toxicity <= 0.7 THEN 'mid' WHEN toxicity > 0.7 AND toxicity <= 1.01 THEN 'high' END AS band,
  CASE WHEN toxicity > 0.7 THEN 'CRITICAL' WHEN toxicity > 0.4 THEN 'HIGH' WHEN toxicity > 0.2 THEN 'MEDIUM' ELSE 'LOW' END AS risk,
  CASE WHEN k >= 80 THEN 'critical' WHEN k >= 60 THEN 'high' WHEN k >= 40 THEN 'medium' ELSE 'low' END AS level, round(abs(k - 50) / 50.0::DOUBLE, 4) AS confidence
FROM social WHERE followers >= 100 AND (CASE WHEN k >= 80 THEN 'critical' WHEN k >= 60 THEN 'high' WHEN k >= 40 THEN 'medium' ELSE 'low' END) IN ('critical', 'high', 'low')""",
)
def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = social(spark, sf_dir).select(
        "post_id",
        "followers",
        F.round(S.clip(F.col("score") / 100, 0, 1), 6).alias("clipped"),
        S.tercile_band(F.col("toxicity")).alias("band"),
        S.risk_band(F.col("toxicity")).alias("risk"),
        S.risk_level(F.col("k")).alias("level"),
        F.round(S.confidence(F.col("k")), 4).alias("confidence"),
    )
    return rows.where((F.col("followers") >= 100) & F.col("level").isin("critical", "high", "low")).drop("followers")


@query(
    "N03 N04",
    f"""WITH {SOCIAL}, u AS (SELECT user_id, ln(1 + avg(score)) AS f, avg(sentiment) AS s, avg(toxicity) AS t, sum((score > 100 AND sentiment < -0.3)::INT) / count(*)::DOUBLE AS c FROM social GROUP BY user_id),
r AS (SELECT *, 3 * c - 2 * s + 2 * t AS risk FROM u)
SELECT user_id, round((f - avg(f) OVER ()) / (stddev_pop(f) OVER () + 1e-8), 6) AS z, round(risk, 6) AS risk, (round(risk, 9) >= round((SELECT quantile_cont(risk, 0.8) FROM r), 9))::INT AS label FROM r""",
)
def node_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log1p and z-score of a mean, a risk score, and the label of its upper fifth; the global figures are one row."""
    angry = ((F.col("score") > 100) & (F.col("sentiment") < -0.3)).cast("int")
    users = social(spark, sf_dir).groupBy("user_id").agg(
        F.log1p(F.avg("score")).alias("f"), F.avg("sentiment").alias("s"), F.avg("toxicity").alias("t"), (F.sum(angry) / F.count("*")).alias("c")
    )
    users = users.withColumn("risk", 3 * F.col("c") - 2 * F.col("s") + 2 * F.col("t"))
    cut = quantiles(users, "risk", [0.8]).select(F.get("q", F.lit(0)).alias("cut"))
    whole = users.agg(F.avg("f").alias("mean"), F.stddev_pop("f").alias("dev")).crossJoin(cut)
    z = (F.col("f") - F.col("mean")) / (F.col("dev") + 1e-8)
    return users.crossJoin(F.broadcast(whole)).select(
        "user_id", F.round(z, 6).alias("z"), F.round("risk", 6).alias("risk"), (F.round("risk", 9) >= F.round("cut", 9)).cast("int").alias("label")
    )


@query(
    "N07 N08 N09 N10 N11 C11 A17 A18 A19",
    f"""WITH {SOCIAL}, s AS (SELECT *, CASE WHEN post_id % 4 > 0 THEN toxicity END AS m1, CASE WHEN post_id % 5 > 0 THEN (1 - sentiment) / 2 END AS m2, score / 1000 AS m3 FROM social)
SELECT post_id, round(least((score + 2 * comments + 3 * k) / 1000, 1.0), 6) AS engagement, CASE WHEN followers > 0 THEN (comments / followers::DOUBLE > 0.1)::INT ELSE 0 END AS backlash,
  round((coalesce(0.5 * m1, 0) + coalesce(0.3 * m2, 0) + 0.2 * m3) / (CASE WHEN m1 IS NULL THEN 0 ELSE 0.5 END + CASE WHEN m2 IS NULL THEN 0 ELSE 0.3 END + 0.2), 6) AS ensemble,
  round((coalesce(m1, 0) + coalesce(m2, 0) + m3) / ((m1 IS NOT NULL)::INT + (m2 IS NOT NULL)::INT + 1), 6) AS mean_of, round(greatest(coalesce(m1, -1), coalesce(m2, -1), m3), 6) AS max_of,
  coalesce(m1 > 0.5, false) OR coalesce(m2 > 0.5, false) OR m3 > 0.5 AS any_of, round(CASE WHEN m1 IS NULL AND m2 IS NULL THEN 0 ELSE list_var_pop(list_filter([m1, m2, m3], lambda x: x IS NOT NULL)) END, 12) AS variance,
  len(list_distinct(list_filter([m1 > 0.5, m2 > 0.5, m3 > 0.5], lambda x: x IS NOT NULL))) > 1 AS disagree, round(exp(m3) / (exp(coalesce(m1, 0)) + exp(coalesce(m2, 0)) + exp(m3)), 6) AS softmax,
  round(1 / (1 + exp(-sentiment)), 6) AS sig, round(ln(least(greatest(toxicity, 1e-10), 1 - 1e-10)) - ln(1 - least(greatest(toxicity, 1e-10), 1 - 1e-10)), 6) AS logit FROM s""",
)
def ensembles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted, plain and largest scores over the models that have one, and how far they are apart."""
    p = F.col("post_id")
    rows = social(spark, sf_dir).withColumns(
        {"m1": F.when(p % 4 > 0, F.col("toxicity")), "m2": F.when(p % 5 > 0, (1 - F.col("sentiment")) / 2), "m3": F.col("score") / 1000}
    )
    models = [F.col(m) for m in ("m1", "m2", "m3")]
    return rows.select(
        "post_id",
        F.round(S.weighted_engagement(F.col("score"), F.col("comments"), F.col("k")), 6).alias("engagement"),
        S.backlash_ratio(F.col("comments"), F.col("followers")).alias("backlash"),
        F.round(S.weighted_mean(list(zip(models, (0.5, 0.3, 0.2), strict=True))), 6).alias("ensemble"),
        F.round(S.null_mean(models), 6).alias("mean_of"),
        F.round(F.greatest(*models), 6).alias("max_of"),
        reduce(or_, [F.coalesce(m > 0.5, F.lit(False)) for m in models]).alias("any_of"),
        F.round(S.null_variance(models), 12).alias("variance"),
        S.disagree(models, 0.5).alias("disagree"),
        F.round(F.element_at(S.softmax([F.coalesce(m, F.lit(0.0)) for m in models]), -1), 6).alias("softmax"),
        F.round(S.sigmoid(F.col("sentiment")), 6).alias("sig"),
        F.round(S.logit(F.col("toxicity")), 6).alias("logit"),
    )


@query(
    "N13 J21",
    """WITH d AS (SELECT c_custkey, c_acctbal, md5('exp1:' || c_custkey) AS h FROM customer),
b AS (SELECT *, CASE WHEN (('0x' || h[1:4])::INT + ('0x' || h[5:8])::INT + ('0x' || h[9:12])::INT + ('0x' || h[13:16])::INT + ('0x' || h[17:20])::INT + ('0x' || h[21:24])::INT + ('0x' || h[25:28])::INT + ('0x' || h[29:32])::INT) % 65535 < 32767 THEN 'treatment' ELSE 'control' END AS bucket FROM d)
SELECT c_custkey, bucket FROM b""",
)
def ab_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", S.ab_bucket(F.col("c_custkey"), "exp1").alias("bucket"))


@query(
    "N14 R04",
    """WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::DOUBLE * q[i]::DOUBLE)), 5) AS dot,
  round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm FROM embeddings, q""",
)
def vector_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    own = e.crossJoin(F.broadcast(q))
    return own.select("vec_id", F.round(S.dot(F.col("embedding"), F.col("q")), 5).alias("dot"), F.round(S.norm(F.col("embedding")), 5).alias("norm"))


@query(
    "G01 G02 G03 G04 R01 R02 R03 X33 F15",
    """WITH e AS (SELECT event_id, event_type, user_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
SELECT event_id, '{"event_type":"' || event_type || '","user_id":"' || user_id || '"}' AS metadata,
  '{' || array_to_string(list_filter([CASE WHEN k > 50 THEN '"high":' || (k - 50) END, CASE WHEN k % 2 = 1 THEN '"odd":1' END], lambda x: x IS NOT NULL), ',') || '}' AS components,
  len(range(0, least(k, 10)))::INT AS n_head, CASE WHEN event_id % 6 = 0 THEN 'bad json' WHEN event_id % 6 = 1 THEN 'missing user_id' END AS error FROM e""",
)
def json_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode maps, keep non-zero components, decode arrays, and tell broken from incomplete records."""
    k, i = F.col("k"), F.col("event_id")
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    scores = F.map_filter(
        F.create_map(F.lit("high"), F.greatest(k - 50, F.lit(0)), F.lit("odd"), k % 2), lambda _, v: v != 0
    )
    ids = F.from_json(F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(1), k + 1), lambda x: x.cast("string")), ","), F.lit("]")), "array<int>")
    raw = F.when(i % 6 == 0, '{"user_id": ').when(i % 6 == 1, '{"other": 1}').otherwise(F.to_json(F.struct(F.col("user_id").cast("string").alias("user_id"))))
    parsed = F.from_json(raw, "user_id string, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    rows = e.select("event_id", "event_type", "user_id", scores.alias("scores"), ids.alias("ids"), k.alias("k"), parsed.alias("p"))
    return rows.select(
        "event_id",
        F.to_json(F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("user_id"), F.col("user_id").cast("string"))).alias("metadata"),
        F.to_json("scores").alias("components"),
        F.least(F.size(F.slice(F.array_distinct("ids"), 1, 10)), k).alias("n_head"),
        F.when(F.col("p._corrupt_record").isNotNull(), "bad json").when(F.col("p.user_id").isNull(), "missing user_id").alias("error"),
    )


@query(
    "F09 F12 F13 F16 F17 F18",
    f"""WITH {SOCIAL}, known AS (SELECT user_id FROM social GROUP BY user_id HAVING count(*) > 60), e AS (SELECT a.post_id, a.user_id AS src, b.user_id AS dst, a.toxicity FROM social a JOIN social b ON a.parent_id = b.post_id)
SELECT post_id, src, dst FROM e WHERE src <> dst AND toxicity > 0.25 AND src IN (SELECT user_id FROM known) AND dst IN (SELECT user_id FROM known)""",
)
def edges_between_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = social(spark, sf_dir)
    known = posts.groupBy("user_id").count().where("count > 60").select("user_id")
    parents = posts.select(F.col("post_id").alias("parent_id"), F.col("user_id").alias("dst"))
    pairs = posts.where("toxicity > 0.25").join(parents, "parent_id").select("post_id", F.col("user_id").alias("src"), "dst").where("src <> dst")
    pairs = pairs.join(known.withColumnRenamed("user_id", "src"), "src", "left_semi").join(known.withColumnRenamed("user_id", "dst"), "dst", "left_semi")
    return drop_null_keys(pairs, "src", "dst").select("post_id", "src", "dst")


@query(
    "J13 X25",
    """SELECT doc_id, CASE lang WHEN 'en' THEN 0.9 WHEN 'de' THEN 0.4 ELSE 0.5 END::DOUBLE AS mapped FROM documents""",
)
def map_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.create_map(*(F.lit(x) for x in ("en", 0.9, "de", 0.4)))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.try_element_at(known, F.col("lang")), F.lit(0.5)).alias("mapped"))


_NESTED = """'{"a": [{"b": "say \\"k\\": 5, k"}, ' || props || ', [[' || props || ']]], "k": {"k": [' || event_id || ', {"k": null}]}, "d": {"e": ' || CASE WHEN event_id % 7 = 0 THEN '' ELSE '"k"' END || '}}'"""


@query(
    "S25",
    f"""WITH t AS (SELECT event_id, {_NESTED} AS j FROM events)
SELECT event_id, fullkey AS path, replace(replace(tree.value::VARCHAR, ' ', ''), chr(10), '') AS value FROM t, json_tree(j) AS tree WHERE event_id % 7 <> 0 AND tree.key = 'k'""",
)
def find_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key's values at any depth of JSON texts, some of which are broken; objects, arrays and keys within texts among them."""
    from plumbline.sources.readers import find_in_json

    texts = table(spark, sf_dir, "events").select("event_id", F.expr(_NESTED.replace("'{", "r'{", 1)).alias("j"))
    return find_in_json(texts, "j", "k", ["event_id"])


