"""Joins of many rows to a table with one row a key, where a key may hold any share of the rows; rows of few keys, unshuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot with more than a ``SHARE``-th of all rows, and ``LEAST`` rows at least; so there are ``SHARE`` hot keys at most.
SHARE, LEAST = 10_000, 1000
#: Groups that rows of hot keys are dealt to.
DEALT = 1024
#: Bits of the filter for wanted keys, as powers of two: sixteen a key between them; beyond, it lets more rows pass.
FILTER_BITS = (20, 27)


def join_by_key(rows: DataFrame, table: DataFrame, key: str, copies: str = "copies", *, total: int | None = None) -> DataFrame:
    """``rows`` with the columns of ``table`` of the same key; rows of a key that it lacks, or of none, have nulls.

    ``table`` has a row for each key, with the number of rows of the key in ``copies``, which is dropped, and no null key. Hot keys
    are broadcast, at most ``SHARE`` of them, and their rows, as those of a null key, are dealt by their hash; all others meet by key, where none
    has more than a ``SHARE``-th of the rows. ``total`` is the number of rows, counted if not given.
    """
    least = max(LEAST, (rows.count() if total is None else total) // SHARE)
    more = [c for c in table.columns if c not in (key, copies)]
    named = table.select(F.col(key).alias("__key"), F.struct(*more).alias("__more"), F.col(copies).alias("__copies"))
    hot = named.where(F.col("__copies") > least).select(F.col("__key").alias("__hot_key"), F.col("__more").alias("__hot_more"))
    rest = named.where(F.col("__copies") <= least).select("__key", "__more", F.lit(0).alias("__part"))
    dealt = F.when(F.col("__hot_key").isNotNull() | F.col(key).isNull(), 1 + F.pmod(F.xxhash64(*rows.columns), F.lit(DEALT))).otherwise(0).cast("int")
    near = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot_key"), "left").withColumn("__row_part", dealt)
    both = near.join(rest, (F.col(key) == F.col("__key")) & (F.col("__row_part") == F.col("__part")), "left")
    found = F.coalesce("__hot_more", "__more")
    return both.select(*rows.columns, *(found.getField(c).alias(c) for c in more))


def likely(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of keys that ``wanted`` has, and few others, for an exact join that follows: wide rows of other keys aren't shuffled.

    A filter of some bits a key is broadcast as the words that have any, so its size is bounded whatever ``wanted`` has.
    """
    low, high = FILTER_BITS
    bits = min(max(low, (16 * max(wanted.count(), 1)).bit_length()), high)
    at = F.shiftrightunsigned(F.xxhash64(key), 64 - bits)
    named = {"w": F.shiftright(at, 6), "bit": F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))}
    words = wanted.select(*(c.alias(n) for n, c in named.items())).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    words = words.select(F.col("w").alias("__w"), F.col("bits").alias("__bits"))
    return rows.join(F.broadcast(words), (named["w"] == F.col("__w")) & (named["bit"].bitwiseAND(F.col("__bits")) != 0), "left_semi")
