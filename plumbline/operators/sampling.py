"""Deduplication, sampling and splitting, all by hashes of keys: a rerun, or a retried task, chooses the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.storage import materialize


def hash_order(*keys: str) -> Column:
    """A hexadecimal digest of the keys, to order rows by instead of chance."""
    return F.md5(F.concat_ws(":", *(F.col(k).cast("string") for k in keys)).cast("binary"))


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the first by ``order``.

    Rows are combined before the shuffle, so that a key of very many rows doesn't gather in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return first.select(*keys, *(F.col("__row").getField(c).alias(c) for c in rest)).select(*df.columns)


def normal_key(source: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat(source, F.lit(":"), F.lower(F.trim(F.coalesce(text, F.lit("")))) ).cast("binary"), 256), 1, 16)


def placed(df: DataFrame, strata: list[str], key: str) -> DataFrame:
    """Each row's place (1 on) in its stratum in hash order, and the stratum's size: ``__place``, ``__size``.

    The order within a stratum is by range of the digest: rows are dealt by (stratum, first digit), numbered there, and
    shifted by the rows of the digits before, so that a stratum of a third of all rows is spread over sixteen tasks.
    """
    rows = df.withColumn("__hash", hash_order(key)).withColumn("__digit", F.substring("__hash", 1, 1))
    sizes = rows.groupBy(*strata, "__digit").agg(F.count("*").alias("__n"))
    run = Window.partitionBy(*strata).orderBy("__digit").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*strata, "__digit", F.coalesce(F.sum("__n").over(run), F.lit(0)).alias("__base"), F.sum("__n").over(Window.partitionBy(*strata)).alias("__size"))
    local = F.row_number().over(Window.partitionBy(*strata, "__digit").orderBy("__hash", key))
    same = reduce(lambda a, b: a & b, [F.col(f"__l.{c}").eqNullSafe(F.col(f"__r.{c}")) for c in [*strata, "__digit"]])
    out = rows.withColumn("__local", local).alias("__l").join(sizes.alias("__r"), same)
    return out.select("__l.*", (F.col("__local") + F.col("__base")).alias("__place"), "__size").drop("__hash", "__digit", "__local")


def by_range(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows dealt by range of ``order``, with their range's number ``__range``; written, so that every use sees the same deal."""
    return materialize(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "by-range")


def in_order(df: DataFrame, order: list[str]) -> DataFrame:
    """Each row's place (1 on) among all rows in order, and their number: ``__place``, ``__size``.

    Rows are dealt by range and written, so that every use sees the same deal; a place is the row's number in its range plus
    the rows of the ranges before, of which there is one row each. No task sees all rows.
    """
    rows = by_range(df, order)
    local = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    run = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("__range").agg(F.count("*").alias("__n"))
    whole = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    sizes = sizes.select("__range", F.coalesce(F.sum("__n").over(run), F.lit(0)).alias("__base"), whole.alias("__size"))
    out = rows.withColumn("__local", local).join(sizes, "__range")
    return out.withColumn("__place", F.col("__local") + F.col("__base")).drop("__range", "__local", "__base")


def cap_strata(df: DataFrame, strata: list[str], key: str, limit: Column) -> DataFrame:
    """At most ``limit`` (over ``__size``) rows of each stratum."""
    return placed(df, strata, key).where(F.col("__place") <= limit).drop("__place", "__size")


def split_strata(df: DataFrame, strata: list[str], key: str, shares: dict[str, float]) -> DataFrame:
    """Column ``split``: floors of the shares of each stratum in their order, the rest to the last name."""
    rows = placed(df, strata, key)
    bound, out = F.lit(0), None
    names = list(shares)
    for name in names[:-1]:
        bound = bound + F.floor(F.col("__size") * shares[name])
        condition = F.col("__place") <= bound
        out = F.when(condition, name) if out is None else out.when(condition, name)
    split = F.lit(names[-1]) if out is None else out.otherwise(names[-1])
    return rows.withColumn("split", split).drop("__place", "__size")


def undersample(df: DataFrame, label: str, key: str, ratio: float) -> DataFrame:
    """All rows of label 1 and so many of label 0 that label 1 has the share ``ratio``."""
    sizes = df.agg(F.count_if(F.col(label) == 1).alias("__pos"))
    rows = placed(df.where(F.col(label).isin(0, 1)), [label], key).crossJoin(F.broadcast(sizes))
    wanted = F.floor(F.col("__pos") * (1 - ratio) / ratio)
    return rows.where((F.col(label) == 1) | (F.col("__place") <= wanted)).drop("__place", "__size", "__pos")


def folds(key: str, n: int) -> Column:
    return F.conv(F.substring(hash_order(key), 1, 8), 16, 10).cast("long") % n
