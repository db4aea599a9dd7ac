"""Sources: files of several formats, partial and broken input, lookups, and unbounded streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.sources.datasources import CHUNK, ArrowBlocks, ZstdLines
from plumbline.storage import materialize


class UnknownFormat(ValueError):
    """A path whose suffix names no format."""


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or glob) has anything, in whatever store Spark reads."""
    jvm = spark.sparkContext._jvm
    own = jvm.org.apache.hadoop.fs.Path(path)
    found = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(own)
    return found is not None and len(found) > 0


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first of the paths that exists."""
    for path in paths:
        if path_exists(spark, path):
            return path
    raise FileNotFoundError(f"none of {paths} exists")


def latest(spark: SparkSession, pattern: str) -> str:
    """The last path by name of those that match."""
    jvm = spark.sparkContext._jvm
    own = jvm.org.apache.hadoop.fs.Path(pattern)
    found = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(own)
    names = sorted(s.getPath().toString() for s in found or [])
    if not names:
        raise FileNotFoundError(f"nothing matches {pattern}")
    return names[-1]


def read_any(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Dispatch by suffix: parquet, csv with header, JSON lines, zstandard JSON lines, Arrow IPC."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    bare = path.rstrip("/*")
    if bare.endswith(".parquet"):
        return reader.option("mergeSchema", "true").parquet(path)
    if bare.endswith(".csv"):
        return reader.csv(path, header=True, inferSchema=schema is None)
    if bare.endswith((".json", ".jsonl", ".ndjson")):
        return reader.json(path)
    if schema is not None and bare.endswith(".zst"):
        return read_zstd_lines(spark, path, schema)[0]
    if schema is not None and bare.endswith((".arrow", ".feather")):
        return read_arrow(spark, path, (StructType.fromDDL(schema) if isinstance(schema, str) else schema).names)
    raise UnknownFormat(f"no format, or no schema for it: {path}")


def _parsed(lines: DataFrame, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """Good rows of a column ``value`` of JSON texts, and the texts that are broken."""
    ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    parsed = F.from_json("value", f"{ddl}, __broken string", {"columnNameOfCorruptRecord": "__broken"})
    rows = lines.where(F.length(F.trim("value")) > 0).select("value", parsed.alias("r"))
    good = rows.where("r.__broken IS NULL").select("r.*").drop("__broken")
    return good, rows.where("r.__broken IS NOT NULL").select("value")


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str, recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """JSON lines: good rows, and the lines that could not be parsed; blank lines are skipped."""
    return _parsed(spark.read.option("recursiveFileLookup", str(recursive).lower()).text(path), schema)


def read_json_lines_with_kind(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A tree of JSON-lines files; ``kind`` is comment or submission by the file's name."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    lines = lines.select("value", F.when(F.lower(F.col("_metadata.file_path")).contains("comment"), "comment").otherwise("submission").alias("kind"))
    return lines.select("kind", F.from_json("value", schema if isinstance(schema, str) else schema).alias("r")).select("kind", "r.*")


def read_zstd_lines(spark: SparkSession, path: str, schema: StructType | str, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Zstandard JSON lines: good rows, and the lines that are broken, as text or as JSON; a task streams a file chunk by chunk."""
    spark.dataSource.register(ZstdLines)
    lines = spark.read.format("zstd_lines").option("chunk", chunk).load(path)
    good, broken = _parsed(lines.where("NOT broken"), schema)
    return good, broken.unionByName(lines.where("broken").select("value"))


def read_arrow(spark: SparkSession, path: str, columns: list[str] | None = None, batches: int = 16) -> DataFrame:
    """Arrow IPC files, so many record batches a task; only the wanted columns are read."""
    spark.dataSource.register(ArrowBlocks)
    own = spark.read.format("arrow_blocks").option("batches", batches)
    return (own.option("columns", ",".join(columns)) if columns else own).load(path)


def find_in_json(rows: DataFrame, text: str, key: str, keep: list[str]) -> DataFrame:
    """Every value of a key, at any depth of a JSON text: the columns ``keep``, the value's ``path``, and ``value`` as JSON.

    Texts become VARIANT and are opened level by level, objects by key and arrays by place, so that a key inside a text is none,
    and a value may be an object or an array, whose own keys are searched too. A level is written before the next, as there
    are as many as the deepest text has. Null texts and those that are no JSON have no values.
    """
    spark, names = rows.sparkSession, [f"__k{i}" for i in range(len(keep))]
    own = [F.col(c).alias(n) for c, n in zip(keep, names, strict=True)]
    level = rows.select(*own, F.lit("$").alias("__path"), F.try_parse_json(text).alias("__v")).where("__v IS NOT NULL")
    found = None
    while found is None or not level.isEmpty():
        open_ = level.lateralJoin(spark.tvf.variant_explode(F.col("__v").outer()))
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), "key"))
        open_ = open_.select(*names, F.concat("__path", step).alias("__path"), F.col("key").alias("__key"), F.col("value").alias("__v"))
        open_ = materialize(open_, "json-level")
        hits = open_.where(F.col("__key") == key).select(*names, "__path", F.to_json("__v").alias("value"))
        found = hits if found is None else found.unionByName(hits)
        level = open_.where(F.schema_of_variant("__v").rlike("^(OBJECT|ARRAY)")).select(*names, "__path", "__v")
    return found.select(*(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), F.col("__path").alias("path"), "value")


#: Types of interactions and the names of their edges; fixed values.
EDGE_NAMES = {"follow": "follows", "mention": "mentions", "retweet": "retweets", "reply": "replies_to"}


def edge_name(kind: Column) -> Column:
    """The edge's name of an interaction's type, in any case; an unknown type is its own name, in lower case."""
    names = F.create_map(*(F.lit(x) for pair in EDGE_NAMES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, F.lower(kind)), F.lower(kind))


def expand_interactions(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Users and edges of posts with a nested ``user`` and an array ``interactions``; known types get their edge names."""
    users = posts.select("user.*").dropDuplicates(["id"])
    rows = posts.select(F.col("user.id").alias("source"), F.explode("interactions").alias("i"))
    kind = edge_name(F.col("i.type"))
    edges = rows.select(F.concat(F.lit("twitter_"), "source").alias("source"), F.concat(F.lit("twitter_"), "i.target").alias("target"), kind.alias("type"))
    return users, edges.where("source <> target")


def index_directory(spark: SparkSession, root: str, *, preview: int = 2000, keywords: int = 100, limit: int = 200, skip: tuple[str, ...] = (".git", "node_modules", "__pycache__")) -> DataFrame:
    """Text files under a directory as documents: path, preview, distinct identifiers and size."""
    from plumbline.functions.text import identifier_keywords, word_count

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    for name in skip:
        files = files.where(~F.col("path").contains(f"/{name}/"))
    text = F.decode("content", "UTF-8")
    rows = files.orderBy("path").limit(limit).select("path", F.substring(text, 1, preview).alias("preview"), text.alias("text"))
    return rows.select("path", "preview", F.slice(identifier_keywords(F.col("text")), 1, keywords).alias("keywords"), word_count(F.col("text")).alias("tokens"))


def synthetic_graph(spark: SparkSession, users: int, seed: int = 7) -> DataFrame:
    """A random graph: four edges from each user, by hashes of user and place."""
    rows = spark.range(users).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("i"))
    return rows.select("src", F.pmod(F.xxhash64("src", "i", F.lit(seed)), F.lit(users)).alias("dst")).where("src <> dst").distinct()


def kafka_source(spark: SparkSession, servers: str, topic: str, starting: str = "latest") -> DataFrame:
    """A Kafka topic as a stream of ``key``, ``value`` texts and ``timestamp``; it needs Spark's Kafka package."""
    rows = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting).load()
    return rows.select(F.col("key").cast("string"), F.col("value").cast("string"), "timestamp")


def rate_source(spark: SparkSession, per_second: int = 10) -> DataFrame:
    """A stream of numbered rows, in place of a message queue."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
