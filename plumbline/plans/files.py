"""Sources and sinks: what is written is read back, so that each query shows the format's whole way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.base import AS_OF, EDGES, edges
from plumbline.registry import query, table
from plumbline.sources import readers as R
from plumbline.sources import writers as W
from plumbline.storage import new_path

_ORDERS = "SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice FROM orders"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")


@query("S01 K01 K18 S08", _ORDERS)
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = orders(spark, sf_dir)
    W.write_csv(own, path := new_path(spark, "orders") + ".csv")
    return R.read_any(spark, path, own.schema)


@query("S02 S03 K02 K08", _ORDERS)
def parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two folders of zstandard files, read as one by a glob."""
    own, path = orders(spark, sf_dir), new_path(spark, "orders")
    W.write_parquet(own.where("o_orderkey % 2 = 0"), f"{path}/a.parquet", max_rows=5000)
    W.write_parquet(own.where("o_orderkey % 2 = 1"), f"{path}/b.parquet")
    return spark.read.option("mergeSchema", "true").parquet(f"{path}/*.parquet")


@query("S07 K03", _ORDERS)
def arrow_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrow IPC files written by tasks and read by blocks of record batches."""
    W.write_blobs(W.arrow_files(orders(spark, sf_dir), 2000), path := new_path(spark, "orders"), ".arrow")
    return R.read_arrow(spark, path)


@query("S07 P16", "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def arrow_two_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of the columns of Arrow IPC files; the others are not read."""
    W.write_blobs(W.arrow_files(orders(spark, sf_dir), 1000), path := new_path(spark, "orders"), ".arrow")
    own = R.read_arrow(spark, path, ["o_totalprice", "o_orderpriority"], batches=1)
    return own.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "S05 S06 S16 G02",
    "SELECT event_id, user_id, 'ok' AS state FROM events WHERE event_id % 10 <> 3 UNION ALL SELECT NULL, NULL, 'broken' FROM events WHERE event_id % 10 = 3",
)
def json_lines_with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of which a tenth is cut off: good rows and broken lines, none lost."""
    e = table(spark, sf_dir, "events")
    text = F.to_json(F.struct("event_id", "user_id"))
    line = F.when(F.col("event_id") % 10 == 3, F.expr("substring(t, 1, length(t) - 4)")).otherwise(F.col("t"))
    e.select(F.col("event_id"), text.alias("t")).select(line.alias("value")).write.text(path := new_path(spark, "events"))
    good, bad = R.read_json_lines(spark, path, "event_id long, user_id long")
    null = F.lit(None).cast("long")
    return good.select("event_id", "user_id", F.lit("ok").alias("state")).unionByName(bad.select(null.alias("event_id"), null.alias("user_id"), F.lit("broken").alias("state")))


@query(
    "S05",
    """SELECT event_id, user_id, 1 AS n FROM events WHERE event_id % 10 <> 3 UNION ALL SELECT NULL, NULL, count(*) FROM events WHERE event_id % 10 = 3""",
)
def zstd_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zstandard JSON lines, a file streamed chunk by chunk: good rows, and in one row how many lines are broken and skipped."""
    text = F.to_json(F.struct("event_id", "user_id"))
    line = F.when(F.col("event_id") % 10 == 3, F.expr("substring(t, 1, length(t) - 4)")).otherwise(F.col("t"))
    lines = table(spark, sf_dir, "events").select("event_id", text.alias("t")).select(line.alias("value"))
    W.write_blobs(W.zstd_files(lines), path := new_path(spark, "zstd"), ".ndjson.zst")
    good, broken = R.read_zstd_lines(spark, path, "event_id long, user_id long")
    null = F.lit(None).cast("long")
    return good.withColumn("n", F.lit(1).cast("long")).unionByName(broken.agg(F.count("*").alias("n")).select(null.alias("event_id"), null.alias("user_id"), "n"))


@query(
    "S04",
    "SELECT CASE WHEN conv_id % 2 = 0 THEN 'comment' ELSE 'submission' END AS kind, count(*) AS n FROM conversations GROUP BY 1",
)
def json_tree_with_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, path = table(spark, sf_dir, "conversations").select("conv_id", "turn"), new_path(spark, "dump")
    own.where("conv_id % 2 = 0").write.json(f"{path}/x/comments")
    own.where("conv_id % 2 = 1").write.json(f"{path}/y/posts")
    return R.read_json_lines_with_kind(spark, path, "conv_id long, turn long").groupBy("kind").agg(F.count("*").alias("n"))


@query("S09 S10 K07", _ORDERS)
def latest_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs named by run; the last is read, if the preferred place has none."""
    own, path = orders(spark, sf_dir), new_path(spark, "runs")
    W.write_parquet(own.limit(1), f"{path}/train_20240101.parquet")
    W.write_parquet(own, f"{path}/train_20240201.parquet")
    return R.read_any(spark, R.first_existing(spark, [f"{path}/none.parquet", R.latest(spark, f"{path}/train_*.parquet")]))


@query("S11 S18 S19 S22", "SELECT event_id, ts FROM events WHERE user_id = 8 AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20' ORDER BY ts, event_id LIMIT 20")
def posts_of_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point and range lookup with a limit; both predicates reach the scan."""
    e = table(spark, sf_dir, "events").where("user_id = 8 AND ts BETWEEN timestamp_ntz '2024-01-03 00:00:00' AND timestamp_ntz '2024-01-20 00:00:00'")
    return e.orderBy("ts", "event_id").limit(20).select("event_id", "ts")


@query("S12 K04 X33", "SELECT user_id, count(*) AS n, date_trunc('day', ts)::DATE::VARCHAR AS date FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-04' GROUP BY 1, 3")
def offline_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date partitions of a feature view, one of them written twice, and an inclusive range read back."""
    daily = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    path = new_path(spark, "features")
    for day in ("2024-01-01", "2024-01-02", "2024-01-03", "2024-01-02"):
        W.write_offline(daily.where(F.col("day") == F.lit(day).cast("date")).drop("day"), path, day)
    return W.read_offline(spark, path, "2024-01-02", "2024-01-03").withColumn("date", F.col("date").cast("string"))


@query(
    "S13 P12 R01",
    """WITH p AS (SELECT DISTINCT o_custkey, o_orderkey % 100 AS target, CASE o_orderkey % 3 WHEN 0 THEN 'follows' WHEN 1 THEN 'mentions' ELSE 'liked' END AS type FROM orders)
SELECT 'twitter_' || o_custkey AS source, 'twitter_' || target AS target, type, count(*) AS n FROM p WHERE o_custkey <> target GROUP BY ALL""",
)
def nested_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderkey") % 3 == 0, "follow").when(F.col("o_orderkey") % 3 == 1, "mention").otherwise("liked")
    o = orders(spark, sf_dir).select("o_custkey", F.struct(kind.alias("type"), (F.col("o_orderkey") % 100).cast("string").alias("target")).alias("i"))
    posts = o.groupBy("o_custkey").agg(F.collect_set("i").alias("interactions")).select(F.struct(F.col("o_custkey").cast("string").alias("id")).alias("user"), "interactions")
    posts.write.json(path := new_path(spark, "posts"))
    read = spark.read.schema("user struct<id:string>, interactions array<struct<type:string,target:string>>").json(path)
    return R.expand_interactions(read)[1].groupBy("source", "target", "type").agg(F.count("*").alias("n"))


@query("S14")
def directory_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files under a directory as documents with previews and identifiers."""
    own = table(spark, sf_dir, "benchmark").select("text")
    own.repartition(4).write.text(path := new_path(spark, "tree"))
    return R.index_directory(spark, path).select(F.length("preview").alias("preview_chars"), "tokens", F.size("keywords").alias("keywords"))


@query("S26")
def random_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.synthetic_graph(spark, 500)


@query(
    "K05",
    "SELECT quality::VARCHAR AS label, count(*) AS n, (SELECT count(*) FROM labels) AS total FROM labels GROUP BY 1",
)
def parquet_with_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = W.write_with_stats(table(spark, sf_dir, "labels"), new_path(spark, "labels"), "quality", "toxic")
    rows = [(k, n, stats["total"]) for k, n in stats["labels"].items()]
    return spark.createDataFrame(rows, "label string, n long, total long")


@query("K06", "SELECT count(*) AS n, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS bytes FROM documents")
def tar_sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tar shards written as files and opened again, streamed member by member: members and bytes."""
    shards = W.write_tar_shards(table(spark, sf_dir, "documents"), "doc_id", "text", 100, new_path(spark, "tar"))

    def opened(batches):
        import tarfile

        import pyarrow as pa
        from pyarrow import fs

        for b in batches:
            for uri in b.column(0).to_pylist():
                store, own = fs.FileSystem.from_uri(uri)
                with store.open_input_stream(own) as stream, tarfile.open(fileobj=stream, mode="r|") as tar:
                    sizes = [m.size for m in tar]
                yield pa.RecordBatch.from_pydict({"n": pa.array([len(sizes)], pa.int64()), "bytes": pa.array([sum(sizes)], pa.int64())})

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return shards.select("file").repartition(n, "file").mapInArrow(opened, "n long, bytes long").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))


@query("K09 K12 K13", "SELECT c_custkey, c_name FROM customer")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append what isn't there; rows that are, and repeated ones, are ignored."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    c.where("c_custkey % 3 = 0").write.parquet(path := new_path(spark, "customers"))
    known = spark.read.schema(c.schema).parquet(path)
    W.insert_new(known, c.unionByName(c), ["c_custkey"]).write.mode("append").parquet(path)
    return spark.read.schema(c.schema).parquet(path)


@query(
    "K14 K15 K16",
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'new' WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 1 THEN 'created' ELSE c_mktsegment END AS segment, c_acctbal AS balance FROM customer""",
)
def upsert_and_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in the store: rows replaced by key, then nodes merged, where null leaves what is known and new ones get what is theirs."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    path = new_path(spark, "nodes")
    W.replace_table(c.where("id % 3 > 0").withColumn("balance", F.lit(0.0)), path)
    W.replace_table(W.upsert(W.read_table(spark, path), c.where("id % 2 = 0"), ["id"]), path)
    newer = c.select("id", F.when(F.col("id") % 4 == 0, "new").alias("segment"), F.when(F.col("id") % 2 == 1, F.col("balance")).alias("balance"))
    on_create = {"segment": F.lit("created"), "balance": F.lit(-1.0)}
    W.replace_table(W.merge_nodes(W.read_table(spark, path), newer, "id", on_create=on_create), path)
    return W.read_table(spark, path)


@query("K17 K22 K23", f"""WITH {EDGES} SELECT src, dst, type, round(sum(weight) * 2, 6) AS weight FROM edges WHERE type <> 'retweet' GROUP BY ALL""")
def merge_edge_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of edges merged by adding weights; one type is deleted; null targets are left out, null weights are 1."""
    e = edges(spark, sf_dir).select("src", "dst", "type", "weight")
    merged = W.merge_edges(W.merge_edges(e.limit(0), e), e).where("type <> 'retweet'")
    return merged.where("dst IS NOT NULL").fillna(1.0, ["weight"]).withColumn("weight", F.round("weight", 6))


@query("K15 S21", f"""SELECT user_id, count(*) AS n FROM events WHERE ts + INTERVAL 7 DAY > TIMESTAMP '{AS_OF}' GROUP BY user_id""")
def online_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with a time to live: expired ones are not read."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return W.alive(W.with_expiry(e, "ts", 7 * 86400), F.lit(AS_OF).cast("timestamp")).groupBy("user_id").agg(F.count("*").alias("n"))


@query("K20", "SELECT event_type, 2 * count(*) AS n FROM events GROUP BY event_type")
def appended_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of JSON lines appended to twice."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    path = new_path(spark, "log")
    for _ in range(2):
        W.append_log(e, path)
    return spark.read.schema("event_id long, event_type string").json(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("K19 C12", "SELECT 'rows' AS check_name, count(*) >= 10 AS passed, count(*)::DOUBLE AS value FROM documents UNION ALL SELECT 'null_text', count(*) FILTER (text IS NULL) = 0, count(*) FILTER (text IS NULL) FROM documents")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report written as JSON and HTML; the JSON is read back."""
    from plumbline.operators.validate import validate

    figures = {"n": F.count("*"), "nulls": F.count_if(F.col("text").isNull())}
    results = validate(table(spark, sf_dir, "documents"), figures, {"rows": ("n", "n >= 10"), "null_text": ("nulls", "nulls = 0")})
    W.write_report(results, path := new_path(spark, "report"), "documents")
    schema = "checks array<struct<check_name:string, passed:boolean, value:double>>"
    return spark.read.schema(schema).json(f"{path}.json").select(F.explode("checks").alias("c")).select("c.*")


@query("K21 A32", "SELECT o_custkey, count(*) AS n, 1::BIGINT AS second_runs FROM orders GROUP BY o_custkey")
def resumed_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stages; the second run finds the first complete and runs the other only."""
    from plumbline.operators.stages import run_stages

    first = ("orders", lambda s, _: table(s, sf_dir, "orders").select("o_orderkey", "o_custkey"))
    second = ("counts", lambda s, df: df.groupBy("o_custkey").agg(F.count("*").alias("n")))
    folder = new_path(spark, "stages")
    run_stages(spark, folder, [first])
    out, report = run_stages(spark, folder, [first, second])
    return out.withColumn("second_runs", F.lit(sum(r["ran"] for r in report)).cast("long"))
