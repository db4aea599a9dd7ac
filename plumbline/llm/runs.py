"""Periodic runs of words by an all-lag vectorised scan.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are identical) of at least
``max(SHORTEST, EXPONENT * q)`` words that no neighbouring word extends.

1. Words become numbers, different in every text, so that many texts lie behind each other in one array, longest first, and
   no word equals one of another text.
2. For each lag up to half of the longest text the array is compared with itself shifted by the lag, over the texts that
   are long enough. A stretch of ``m`` equal places is a run of ``m`` plus the lag words.
3. Stretches are read off in groups of eight places: a stretch of fifteen or more holds an aligned group that is true
   throughout, so only such groups and their neighbours are looked at; shorter stretches matter for the least lags only.
4. A stretch of a multiple of its smallest period has the same bounds as that of the period itself, so of equal bounds the
   least lag stays.

Work is quadratic in a text's words, as the method has it. Texts over ``LONG_BYTES`` are dealt by ranges of lags of
``RANGE_WORK`` comparisons to tasks of their own, and their stretches are met by bounds with a map-side minimum; runs of a
text are fewer than its words. All other texts are scanned where they are read, with no shuffle. Both ways give the same.

Defined cases: a null text has no words; empty and wordless texts have no runs and collapse to an empty text; texts are read
whole, however long; keys may be null or repeat, and repeated rows give a row each; equal lengths are told apart by start and
period; other columns are not read, so they may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shingles import slices, text_buffer
from plumbline.llm.storage import arrow_schema, with_rows

SHORTEST, EXPONENT = 12, 2
#: Texts from so many bytes on are dealt by ranges of lags, each of so many comparisons at most.
LONG_BYTES, RANGE_WORK = 64 << 10, 1 << 28
#: Text bytes a task holds as words at once, and words that are compared at once.
SLICE_BYTES, WORDS = 2 << 20, 1 << 17
#: What parts words.
SPACE = r"[\x20\x09-\x0D]+"
_ONES = np.uint64(0x0101010101010101)
_PIECE, _CUT = 4 << 20, re.compile(rb"[\x20\x09-\x0D]")
RUNS = "array<struct<start:long,length:long,period:long>>"


def words_of(body: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, in pieces of a long one."""
    at = 0
    while len(body) - at > _PIECE:
        cut = _CUT.search(body, at + _PIECE)
        if cut is None:
            break
        yield body[at : cut.start()].split()
        at = cut.start()
    yield body[at:].split()


def _numbers(body: bytes, fresh) -> np.ndarray:
    """The number of each word; ``fresh`` gives numbers that no other text has."""
    number = defaultdict(fresh)
    return np.concatenate([np.fromiter(map(number.__getitem__, w), np.int32, len(w)) for w in words_of(body)])


def _stretches(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the true stretches of at least ``least`` places. ``same`` starts and ends with eight false ones at least."""
    if least < 15:
        edge = np.flatnonzero(same[1:] != same[:-1]) + 1
        start, end = edge[::2], edge[1::2]
    else:
        groups = np.flatnonzero(same[: len(same) & ~7].view(np.uint64) == _ONES)
        if not len(groups):
            return groups, groups
        parted = np.flatnonzero(np.diff(groups) > 1) + 1
        first, last = groups[np.concatenate([[0], parted])], groups[np.concatenate([parted - 1, [len(groups) - 1]])]
        before = same[(first * 8 - 8)[:, None] + np.arange(8)]
        after = same[(last * 8 + 8)[:, None] + np.arange(8)]
        start, end = first * 8 - before[:, ::-1].argmin(1), last * 8 + 8 + after.argmin(1)
    wide = end - start >= least
    return start[wide], end[wide]


def scan_lags(texts: list[np.ndarray], low: int = 1, high: int | None = None, *, shortest: int = SHORTEST, exponent: int = EXPONENT) -> tuple[np.ndarray, ...]:
    """Text, start, length and lag of the stretches found with lags ``low`` to ``high``; of equal bounds the least lag only."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    ends = np.cumsum(sizes)
    flat = np.concatenate([np.zeros(0, np.int32), *(texts[i] for i in order)])
    most = int(sizes[0]) // exponent if len(sizes) else 0
    found = [np.zeros((0, 3), np.int64)]
    same = np.zeros(len(flat) + 32, bool)
    for lag in range(low, min(most, high or most) + 1):
        enough = int(np.searchsorted(-sizes, -max(shortest, exponent * lag), side="right"))
        if not enough:
            break
        n = int(ends[enough - 1]) - lag
        np.equal(flat[:n], flat[lag : n + lag], out=same[8 : 8 + n])
        same[8 + n : n + 24] = False
        start, end = _stretches(same[: n + 24], max(shortest - lag, (exponent - 1) * lag))
        if len(start):
            found.append(np.stack([start - 8, end - start + lag, np.full(len(start), lag)], 1))
    start, length, lag = np.concatenate(found).T
    first = np.lexsort((lag, length, start))
    start, length, lag = start[first], length[first], lag[first]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, lag = start[new], length[new], lag[new]
    at = np.searchsorted(ends, start, side="right")
    return np.array(order, np.int64)[at], start - (ends[at] - sizes[at]), length, lag


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by spaces, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int32)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)])


def _chunks(numbers: list[np.ndarray]) -> Iterator[list[int]]:
    """Texts of like lengths, about ``WORDS`` words together."""
    own, size = [], 0
    for i in sorted(range(len(numbers)), key=lambda i: -len(numbers[i])):
        own.append(i)
        size += len(numbers[i])
        if size >= WORDS:
            yield own
            own, size = [], 0
    if own:
        yield own


def _whole(bodies: list[bytes], **limits) -> list[list[tuple[int, int, int]]]:
    """The runs ``(start, length, period)`` of each text, by start and period."""
    fresh = count().__next__
    numbers = [_numbers(b, fresh) for b in bodies]
    out: list[list] = [[] for _ in bodies]
    for chunk in _chunks(numbers):
        text, start, length, lag = scan_lags([numbers[i] for i in chunk], **limits)
        for t, *run in zip(text.tolist(), start.tolist(), length.tolist(), lag.tolist(), strict=True):
            out[chunk[t]].append(tuple(run))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def _rows(keys: pa.Array, bodies: list[bytes], runs: list[list[tuple[int, int, int]]], schema: pa.Schema) -> pa.RecordBatch:
    words = [[w for piece in words_of(b) for w in piece] for b in bodies]
    ends = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
    flat = np.array([x for r in runs for x in r], np.int64).reshape(-1, 3)
    structs = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=["start", "length", "period"])
    collapsed = pa.array([collapse(w, r) for w, r in zip(words, runs, strict=True)], pa.binary()).cast(pa.string())
    columns = [keys, pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), structs), collapsed]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def find_runs(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, exponent: int = EXPONENT, long_bytes: int = LONG_BYTES, range_work: int = RANGE_WORK
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words long, runs, collapsed string``.

    ``runs`` has ``start, length, period`` in words, by start and period; ``collapsed`` the words, joined by one space,
    without those a run holds after its first period.
    """
    schema = f"doc_id {docs.schema[key].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string"
    fields, limits = arrow_schema(schema), {"shortest": shortest, "exponent": exponent}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_buffer(batch.column(1))
            for i, j in slices(offsets, SLICE_BYTES):
                bodies = batch.column(1).slice(i, j - i).to_pylist()
                yield _rows(batch.column(0).slice(i, j - i), bodies, _whole(bodies, **limits), fields)

    def scan_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, body, low, high in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                _, start, length, lag = scan_lags([_numbers(body, count().__next__)], low, high, **limits)
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(start), pa.int64()), *map(pa.array, (start, length, lag))], names=["row", "start", "length", "period"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(1).to_pylist()
            runs = [sorted(((r["start"], r["length"], r["period"]) for r in own or []), key=lambda r: (r[0], r[2])) for own in batch.column(2).to_pylist()]
            yield _rows(batch.column(0), bodies, runs, fields)

    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    long = F.octet_length("body") > long_bytes
    short = rows.where(~long).mapInArrow(scan, schema)

    longs, row = with_rows(rows.where(long), "run-texts")
    longs = longs.select(F.col(row).alias("row"), "doc_id", "body", F.regexp_count(F.col("body").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")).alias("n"))
    step = F.greatest(F.floor(F.lit(range_work) / F.col("n")), F.lit(1)).cast("int")
    lags = F.when(F.col("n") >= exponent, F.sequence(F.lit(1), F.floor(F.col("n") / exponent).cast("int"), step)).otherwise(F.array().cast("array<int>"))
    ranges = longs.withColumn("step", step).select("row", "body", F.explode(lags).alias("low"), "step")
    ranges = ranges.select("row", "body", "low", (F.col("low") + F.col("step") - 1).alias("high"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretches = ranges.repartition(n, "row", "low").mapInArrow(scan_range, "row long, start long, length long, period long")
    least = stretches.groupBy("row", "start", "length").agg(F.min("period").alias("period"))
    runs = least.groupBy("row").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    return short.unionByName(longs.join(runs, "row", "left").select("doc_id", "body", "runs").mapInArrow(finish, schema))
