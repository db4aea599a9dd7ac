"""Best-fit packing of token pieces into sequences of a fixed capacity, by best-two-fit.

A sequence is filled greedily: the longest unpacked piece that fits its gap, again and again. Then its smallest piece is
replaced by the two unpacked pieces that together fill the widened gap best, if they fill it better than that piece did.

Which piece of a length is taken doesn't matter, so the packing is planned on the histogram of lengths, which has at most
``capacity`` rows whatever the corpus: a plan is a list of patterns (how many pieces of which lengths share a sequence,
and how many such sequences there are). It equals packing piece by piece, since a pattern is repeated only while each of
its lengths lasts. Pieces then find their place by their rank within their length: ranks come from a range-partitioned
sort, so that a length which a third of all pieces share is spread over tasks.

Defined cases: a null text is an empty one, a single end id; an empty table gives no pieces; repeated rows are packed once
each; ties between equal lengths go by key, piece and start. Keys must be whole numbers; a text of any length is cut in pieces. Of
``docs`` other columns are not read; pieces must not have columns ``task, nth, rank, base, sequence_id, offset``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.storage import materialize
from plumbline.llm.words import Vocabulary, text_slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, *, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """The documents' ids, each document followed by ``end_id``, cut into pieces of at most ``capacity`` ids.

    One row per piece; with ``with_ids`` also the ids themselves (``ids binary``, little-endian unsigned 32-bit).
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(tokenizer)
        for batch in batches:
            at = 0
            for texts in text_slices(batch.column(1).to_pylist()):
                ids, bounds = words.encode(texts)
                ids, bounds = np.insert(ids, bounds[1:], end_id).astype("<u4"), bounds + np.arange(len(bounds))
                pieces = -(-np.diff(bounds) // capacity)
                doc = np.repeat(np.arange(len(texts)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                begin = bounds[doc] + piece * capacity
                end = np.minimum(begin + capacity, bounds[doc + 1])
                view = memoryview(ids.tobytes())
                parts = [view[a:b] for a, b in zip((begin * 4).tolist(), (end * 4).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(doc + at)),
                        pa.array(piece.astype(np.int32)),
                        pa.array(piece * capacity),
                        pa.array(end - begin),
                        pa.array(list(map(zlib.crc32, parts)), pa.int64()),
                    ]
                    + [pa.array([bytes(p) for p in parts], pa.binary())] * with_ids,
                    schema=schema,
                )
                at += len(texts)

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(cut, PIECES + ", ids binary" * with_ids)


def plan_patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns by best-two-fit of ``counts`` pieces by length: (number of sequences, [(length, pieces of it), ...])."""
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit a sequence of {capacity}")
        left[length] += n
    lengths = sorted((x for x in range(1, capacity + 1) if left[x]), reverse=True)
    out = []
    while lengths:
        held: dict[int, int] = {}
        gap = capacity
        for x in lengths:  # descending: the longest that fits, as often as it fits
            if x <= gap:
                held[x] = n = min(left[x], gap // x)
                gap -= n * x
                if not gap:
                    break
        if gap:
            small = min(held)
            room = gap + small
            free = [x for x in lengths if x <= room and left[x] > held.get(x, 0)]
            best, pair = small, None
            i, j = 0, len(free) - 1
            while i <= j:  # free descends: i is the longer one
                total = free[i] + free[j]
                if total > room:
                    i += 1
                    continue
                if total > best and (i < j or left[free[i]] - held.get(free[i], 0) > 1):
                    best, pair = total, (free[i], free[j])
                j -= 1
            if pair:
                held[small] -= 1
                for x in pair:
                    held[x] = held.get(x, 0) + 1
                held = {x: n for x, n in held.items() if n}
        times = min(left[x] // n for x, n in held.items())
        for x, n in held.items():
            left[x] -= n * times
        out.append((times, sorted(held.items(), reverse=True)))
        lengths = [x for x in lengths if left[x]]
    return out


def _places(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """Runs of ranks by length, sorted: from which rank on, how many pieces a sequence, the first sequence, the offset."""
    rows, used, sequence = [], {}, 0
    for times, items in patterns:
        offset = 0
        for length, n in items:
            rows.append((length, used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "sequence", "offset"), table.T, strict=True))


def pack(pieces: DataFrame, capacity: int, *, order: tuple[str, ...] = ("doc_id", "piece", "start")) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces``, which has a ``length`` of 1 to ``capacity``.

    ``pieces`` is read three times; give it materialised. The driver sees the histogram of lengths only.
    """
    spark = pieces.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = _places(plan_patterns({r[0]: r[1] for r in pieces.groupBy("length").count().collect()}, capacity))
    columns = pieces.columns
    ranked = pa.schema([("task", pa.int32()), ("nth", pa.int64())])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            lengths = batch.column("length").to_numpy()  # ascending within the task
            first = np.searchsorted(lengths, lengths)
            nth = seen[lengths] + np.arange(len(lengths)) - first
            seen += np.bincount(lengths, minlength=capacity + 1)
            more = [pa.array(np.full(len(batch), task, np.int32)), pa.array(nth)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *ranked.names])

    spread = pieces.repartitionByRange(n, "length", *order).sortWithinPartitions("length", *order)
    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    spread = materialize(spread.mapInArrow(rank, f"{schema}, task int, nth long"), "pack-ranks")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    # A row per length and task that holds it: as many as lengths and tasks together, since tasks hold ranges.
    base = spread.groupBy("length", "task").count().select("length", "task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.int64(1) << np.int64(45)
        runs = places["length"] * shift + places["rank"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            k = np.searchsorted(runs, length * shift + rank, side="right") - 1
            within = rank - places["rank"][k]
            sequence = places["sequence"][k] + within // places["each"][k]
            offset = places["offset"][k] + within % places["each"][k] * length
            own = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    joined = spread.join(F.broadcast(base), ["length", "task"]).select(*columns, (F.col("nth") + F.col("base")).cast("long").alias("rank"))
    return joined.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def packed_sequences(placed: DataFrame) -> DataFrame:
    """The sequences themselves, from placed pieces with ``ids``: ``sequence_id, ids binary``, pieces in place order."""
    return placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("own")).select(
        "sequence_id", F.aggregate("own", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids")
    )
