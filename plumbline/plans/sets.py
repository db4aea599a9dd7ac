"""Set operations, deduplication, sampling and splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.sampling import cap_strata, dedup_first, folds, hash_order, in_order, normal_key, split_strata, undersample
from plumbline.operators.stats import quantiles
from plumbline.plans.base import SOCIAL, social
from plumbline.registry import query, table


@query(
    "U03 W18",
    """SELECT left(sha256(source || ':' || lower(trim(coalesce(text, '')))), 16) AS sample_id, min(doc_id) AS doc_id FROM documents GROUP BY 1""",
)
def dedup_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", normal_key(F.col("source"), F.col("text")).alias("sample_id"))
    return dedup_first(docs, ["sample_id"], ["doc_id"])


@query(
    "U04 U05",
    """SELECT md5(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY 1""",
)
def dedup_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.md5(F.col("text").cast("binary")).alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(
    "U02 U08 U09 F13 C04",
    f"""WITH {SOCIAL} SELECT DISTINCT post_id FROM (SELECT post_id FROM social WHERE toxicity > 0.5 AND sentiment < 0.1 UNION ALL SELECT post_id FROM social WHERE abs(sentiment) < 0.1 UNION ALL SELECT post_id FROM social WHERE left(md5(post_id::VARCHAR), 1) = '0')""",
)
def review_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicting, borderline and hash-chosen rows, each once."""
    p = social(spark, sf_dir)
    parts = [p.where("toxicity > 0.5 AND sentiment < 0.1"), p.where("abs(sentiment) < 0.1"), p.where(F.substring(hash_order("post_id"), 1, 1) == "0")]
    return parts[0].select("post_id").union(parts[1].select("post_id")).union(parts[2].select("post_id")).distinct()


@query("M01", "SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 100")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").orderBy(hash_order("doc_id"), "doc_id").limit(100)


@query(
    "M02 M03",
    """WITH p AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS r, count(*) OVER (PARTITION BY source, lang) AS n FROM documents)
SELECT doc_id, source, lang FROM p WHERE r <= least(n, 10)""",
)
def cap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return cap_strata(docs, ["source", "lang"], "doc_id", F.least(F.col("__size"), F.lit(10)))


@query(
    "M04 M06 M07",
    """WITH p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source, CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM p""",
)
def split_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return split_strata(docs, ["source"], "doc_id", {"train": 0.8, "val": 0.1, "test": 0.1})


@query(
    "M05 N02",
    f"""WITH {SOCIAL}, b AS (SELECT post_id, CASE WHEN toxicity <= 0.3 THEN 'low' WHEN toxicity <= 0.7 THEN 'mid' ELSE 'high' END AS band FROM social),
p AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY md5(post_id::VARCHAR), post_id) AS r, count(*) OVER (PARTITION BY band) AS n FROM b)
SELECT post_id, band, CASE WHEN r <= floor(n * 0.7) THEN 'train' WHEN r <= floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split FROM p""",
)
def split_by_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.functions.scores import tercile_band

    rows = social(spark, sf_dir).select("post_id", tercile_band(F.col("toxicity")).alias("band"))
    return split_strata(rows, ["band"], "post_id", {"train": 0.7, "val": 0.15, "test": 0.15})


@query(
    "M08",
    """SELECT event_id, CASE WHEN q <= 0.8 THEN 'train' WHEN q <= 0.9 THEN 'val' ELSE 'test' END AS split FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) / count(*) OVER () AS q FROM events)""",
)
def split_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strictly by time: each row's place among all of them, by range of times, decides; ties follow the key."""
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    rows = in_order(e, ["ts", "event_id"])
    share = F.col("__place") / F.col("__size")
    return rows.select("event_id", F.when(share <= 0.8, "train").when(share <= 0.9, "val").otherwise("test").alias("split"))


@query(
    "M09",
    """WITH l AS (SELECT doc_id, toxic AS label, row_number() OVER (PARTITION BY toxic ORDER BY md5(doc_id::VARCHAR), doc_id) AS r, count(*) FILTER (toxic = 1) OVER () AS pos FROM labels)
SELECT doc_id, label FROM l WHERE label = 1 OR r <= floor(pos * (1 - 0.3::DOUBLE) / 0.3::DOUBLE)""",
)
def undersample_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return undersample(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")), "label", "doc_id", 0.3)


@query("M10")
def oversample_minority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic rows between minority rows and neighbours of theirs, after the majority is undersampled.

    Neighbours are sought among rows of one random-projection cell, so that no row meets all others.
    """
    from plumbline.operators.vectors import smote

    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", (F.col("label") == 0).cast("int").alias("label"))
    return smote(e, "vec_id", "embedding", "label", factor=2)


@query(
    "M12 M13",
    """SELECT c_custkey, ('0x' || left(md5(c_custkey::VARCHAR), 8))::BIGINT % 5 AS client, CASE WHEN ('0x' || left(md5(c_custkey::VARCHAR), 8))::BIGINT // 5 % 5 = 0 THEN 'test' ELSE 'train' END AS part FROM customer""",
)
def partition_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey")
    part = F.when(F.floor(folds("c_custkey", 1 << 32) / 5) % 5 == 0, "test").otherwise("train")
    return c.select("c_custkey", folds("c_custkey", 5).alias("client"), part.alias("part"))


@query(
    "J18 J19 K12 K13",
    """SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def new_rows_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query(
    "C07 K05",
    """WITH s AS (SELECT DISTINCT ON (left(sha256(source || ':' || lower(trim(coalesce(text, '')))), 16)) doc_id, source, coalesce(l.toxic, 0) AS label FROM documents d LEFT JOIN labels l USING (doc_id) WHERE length(trim(coalesce(text, ''))) >= 10 ORDER BY left(sha256(source || ':' || lower(trim(coalesce(text, '')))), 16), doc_id),
c AS (SELECT *, row_number() OVER (PARTITION BY source, label ORDER BY md5(doc_id::VARCHAR), doc_id) AS r FROM s), k AS (SELECT doc_id, source, label FROM c WHERE r <= 5000),
p AS (SELECT *, row_number() OVER (PARTITION BY source, label ORDER BY md5(doc_id::VARCHAR), doc_id) AS r, count(*) OVER (PARTITION BY source, label) AS n FROM k)
SELECT source, label, CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM p GROUP BY ALL""",
)
def unified_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validate, deduplicate, balance, split and count, as one plan."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    docs = docs.where(F.length(F.trim(F.coalesce("text", F.lit("")))) >= 10)
    docs = docs.select("doc_id", "source", F.coalesce("toxic", F.lit(0)).alias("label"), normal_key(F.col("source"), F.col("text")).alias("sample_id"))
    own = dedup_first(docs, ["sample_id"], ["doc_id"]).drop("sample_id")
    own = cap_strata(own, ["source", "label"], "doc_id", F.lit(5000))
    own = split_strata(own, ["source", "label"], "doc_id", {"train": 0.8, "val": 0.1, "test": 0.1})
    return own.groupBy("source", "label", "split").agg(F.count("*").alias("n"))


@query(
    "C08 N01 P06",
    """WITH u AS (SELECT 'labels' AS source, quality::DOUBLE AS level FROM labels UNION ALL SELECT 'events', value / 100 FROM events UNION ALL SELECT 'docs', NULL FROM documents), c AS (SELECT source, CASE WHEN level IS NULL THEN 0.5 ELSE least(greatest(level, 0), 1) END AS level FROM u)
SELECT source, count(*) AS n, round(avg(level), 9) AS mean, round(avg((level > 0.5)::INT), 9) AS positive, round(median(level), 9) AS median FROM c GROUP BY source""",
)
def consolidated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.functions.scores import clip

    parts = [
        table(spark, sf_dir, "labels").select(F.lit("labels").alias("source"), F.col("quality").cast("double").alias("level")),
        table(spark, sf_dir, "events").select(F.lit("events").alias("source"), (F.col("value") / 100).alias("level")),
        table(spark, sf_dir, "documents").select(F.lit("docs").alias("source"), F.lit(None).cast("double").alias("level")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("level", F.coalesce(clip(F.col("level"), 0, 1), F.lit(0.5)))
    medians = quantiles(rows, "level", [0.5], "source").select("source", F.round(F.get("q", F.lit(0)), 9).alias("median"))
    whole = rows.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("level"), 9).alias("mean"), F.round(F.avg((F.col("level") > 0.5).cast("int")), 9).alias("positive"))
    return whole.join(medians, "source")
