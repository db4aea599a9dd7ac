"""Ordered scans of a key's rows in parts, so that a key may hold any share of the rows.

Rows are dealt by range of (key, order): a task has a stretch of the order, in which a key that holds many rows has several. Each
stretch is scanned by itself. What a stretch needs of those before it is carried over to it: only the first key of a
stretch can go on from the one before, so there are fewer rows to carry than stretches, and they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.sampling import by_range


def in_stretches(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows dealt by range, with their stretch ``__range`` and their place in it and its key, ``__local`` (1 on)."""
    dealt = by_range(rows, [key, *order])
    return dealt.withColumn("__local", F.row_number().over(within(key, order)))


def within(key: str, order: list[str]):
    """The window of a key's rows in a stretch."""
    return Window.partitionBy("__range", key).orderBy(*order)


def _before(key: str):
    return Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)


def carried_last(stretches: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``__range``, ``key`` and ``__carried``: the last ``value`` that is not null in the stretches before, where there is one."""
    ends = stretches.groupBy("__range", key).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("__end"))
    return ends.select("__range", key, F.last("__end", True).over(_before(key)).alias("__carried")).where("__carried IS NOT NULL")


def carried_rows(stretches: DataFrame, key: str, order: list[str], columns: list[str], keep: int) -> DataFrame:
    """For stretches of keys that have several: ``__base`` (rows before), ``__total`` (in all) and ``__previous``, an array of
    the last ``keep`` rows before as structs of ``columns``, in order."""
    whole = Window.partitionBy("__range", key)
    tail = F.when(F.col("__local") > F.count("*").over(whole) - keep, F.struct("__local", *columns))
    ends = stretches.withColumn("__tail", tail).groupBy("__range", key)
    ends = ends.agg(F.count("*").alias("__n"), F.array_sort(F.collect_list("__tail")).alias("__tail"))  # nulls are left out
    near = Window.partitionBy(key).orderBy("__range").rowsBetween(-keep, -1)
    every = Window.partitionBy(key)
    previous = F.flatten(F.collect_list("__tail").over(near))
    out = ends.select(
        "__range", key, F.coalesce(F.sum("__n").over(_before(key)), F.lit(0)).alias("__base"), F.sum("__n").over(every).alias("__total"),
        F.count("*").over(every).alias("__stretches"), F.slice(previous, F.greatest(F.size(previous) - keep + 1, F.lit(1)), keep).alias("__previous"),
    )
    return out.where("__stretches > 1").drop("__stretches")


def with_carried(stretches: DataFrame, carried: DataFrame, key: str) -> DataFrame:
    """The rows with what is carried to their stretch, or nulls."""
    own = carried.withColumnsRenamed({"__range": "__r", key: "__k"})
    return stretches.join(F.broadcast(own), (F.col("__range") == F.col("__r")) & F.col(key).eqNullSafe(F.col("__k")), "left").drop("__r", "__k")


def lagged(column: str, key: str, order: list[str], n: int = 1) -> Column:
    """The value of the row ``n`` before, in its stretch or carried from before it."""
    back = n - F.col("__local") + 1  # 1 for the last row carried, 2 for the one before
    carried = F.get("__previous", F.size("__previous") - back).getField(column)
    return F.coalesce(F.lag(F.struct(column), n).over(within(key, order)).getField(column), F.when(F.col("__local") <= n, carried))
