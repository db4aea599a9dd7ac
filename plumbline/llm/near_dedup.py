"""Near-duplicate documents by SuperMinHash signatures, banding, verification on full sets and union-find.

1. Each text gets its distinct word shingles and a SuperMinHash signature: an element visits the registers
   in the order of a random permutation of its own and offers its ``j``-th register the value ``j`` plus a fraction. Ranks
   of one element are thus correlated, which lowers the variance against independent hashes; and once every register of a
   document holds a value below ``j + 1``, later offers can change nothing and the document stops.
2. Equal texts are one node, named by their SHA-256. Signatures are cut into bands; nodes that share a band are in
   one bucket, and every two nodes of a bucket are a candidate pair.
3. Candidates are verified on their full sets, shingle by shingle, in cells of bounded size (``cells``).

A pair at the threshold 0.85 is missed by all bands with probability 4e-7 (25 bands of 5), one at 0.80, from which the
pipeline links, with 5e-5, and then only if nothing else connects it.

Defined cases: null and wordless texts have an empty set and are linked with nothing; fewer words than a shingle make one
shingle of all of them; repeated rows are near-duplicates of each other. Keys may be null or repeat, as nodes are texts: a
component's id is its smallest key that is not null, and null where it has none; ``kept`` is true for a row whose key
is that id or null like it. Other columns are not read, so they may have any name. A long text is split and its signature
made piece by piece. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.cells import bucketed, find, linked
from plumbline.llm.components import connected_components
from plumbline.llm.hot import join_by_key
from plumbline.llm.shingles import WordHashes, exact_sets, mix64, shingle_sets, slices, text_buffer
from plumbline.llm.storage import materialize, with_rows

SHINGLE, PERCENT = 5, 85
REGISTERS, BANDS, ROWS = 128, 25, 5
#: Text bytes a task turns into shingles at once, and elements that visit the registers together.
SLICE_BYTES, ELEMENTS = 2 << 20, 1 << 15
_STEP = 0x9E3779B97F4A7C15


def super_minhash(values: np.ndarray, bounds: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Signatures (documents x registers, uint64) of the sets ``values[bounds[i]:bounds[i + 1]]``; all ones if empty.

    Elements come in blocks; a document that lies in several goes on with the registers it has.
    """
    docs = len(bounds) - 1
    out = np.full((docs, registers), np.uint64(2**64 - 1))
    for a in range(0, len(values), ELEMENTS):
        b = min(a + ELEMENTS, len(values))
        first, last = int(np.searchsorted(bounds, a, "right")) - 1, int(np.searchsorted(bounds, b, "left"))
        part = out[first:last].reshape(-1)
        doc = np.repeat(np.arange(last - first), np.diff(np.clip(bounds[first : last + 1], a, b)))
        order = np.tile(np.arange(registers, dtype=np.uint8), (b - a, 1))
        own = np.arange(b - a)
        for j in range(registers):
            if not len(own):
                break
            draw = mix64(values[a + own] + np.uint64((j + 1) * _STEP & 2**64 - 1))
            swap = j + (draw % np.uint64(registers - j)).astype(np.int64)
            register = order[own, swap]
            order[own, swap] = order[own, j]
            np.minimum.at(part, doc[own] * registers + register, np.uint64(j) << np.uint64(40) | draw >> np.uint64(24))
            full = (part.reshape(-1, registers) < np.uint64(j + 1) << np.uint64(40)).all(1)
            own = own[~full[doc[own]]]
    return out


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    keys = np.zeros((len(signatures), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
    for i in range(rows):
        keys = mix64(keys * np.uint64(_STEP) + signatures[:, i : bands * rows : rows])
    return keys.view(np.int64)


def _body(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def _node(text: str) -> Column:
    """The name of a text: the first 16 bytes of its SHA-256."""
    return F.unhex(F.substring(F.sha2(_body(text), 256), 1, 32))


def sketches(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """``doc_id, node, n_shingles`` and ``bands`` of every row; an empty set has no bands."""
    id_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            bodies = batch.column(2)
            _, offsets = text_buffer(bodies)
            for i, j in slices(offsets, SLICE_BYTES):
                values, bounds = shingle_sets(bodies.slice(i, j - i).to_pylist(), hashes, k)
                sizes = np.diff(bounds)
                bands = band_keys(super_minhash(values, bounds))
                ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands[sizes > 0].ravel()))
                own = [batch.column(c).slice(i, j - i) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(sizes), lists], names=["doc_id", "node", "n_shingles", "bands"])

    rows = docs.select(F.col(key), _node(text).alias("node"), _body(text).alias("body"))
    return rows.mapInArrow(run, f"doc_id {id_type}, node binary, n_shingles long, bands array<long>")


def link_sets(codes: np.ndarray, bounds: np.ndarray, pivots: int, others: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect as all do, between sets ``0 .. pivots - 1`` and sets from ``others`` on.

    Every pair of the two with ``100 * intersection >= percent * union`` is found; of those that close a circle only some
    are given. Sets must not be empty.
    """
    sizes = np.diff(bounds)
    tail, starts, rest = codes[bounds[others] :], bounds[others:-1] - bounds[others], sizes[others:]
    mark, up, out = np.zeros(int(codes.max(initial=0)) + 1, bool), list(range(len(sizes))), []
    for i in range(pivots):
        own = codes[bounds[i] : bounds[i + 1]]
        mark[own] = True
        both = np.add.reduceat(mark[tail], starts, dtype=np.int64)
        mark[own] = False
        for j in (np.flatnonzero(100 * both >= percent * (sizes[i] + rest - both)) + others).tolist():
            x, y = find(up, i), find(up, j)
            if x != y:
                up[max(x, y)] = min(x, y)
                out.append((i, j))
    return out


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``."""
    rows = materialize(sketches(docs, key=key, text=text, k=k), "near-sketches")
    sets = rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    sets = materialize(sets, "near-sets")
    buckets = bucketed(sets.select("node", F.col("n_shingles").alias("weight"), F.posexplode("bands").alias("band", "value")), "near-buckets")
    texts = docs.select(_node(text).alias("node"), _body(text).alias("body")).groupBy("node").agg(F.first("body").alias("body"))
    bodies = materialize(texts.join(buckets.select("node").distinct(), "node", "left_semi"), "near-bodies")

    def link(texts: list[bytes], pivots: int, others: int) -> list[tuple[int, int]]:
        return link_sets(*exact_sets(texts, k), pivots, others, percent)

    roots = connected_components(linked(buckets, bodies, link)).select("node", F.col("component").alias("root"))
    own = materialize(sets.select("node", "low", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "near-roots")
    lows = own.groupBy("root").agg(F.min("low").alias("component"), F.count("*").alias("members"))
    ids = join_by_key(own.drop("low"), lows, "root", "members").select("node", "copies", "component", F.lit(True).alias("linked"))
    out = join_by_key(rows.drop("bands"), materialize(ids, "near-ids"), "node")
    component = F.when(F.col("linked"), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component only: of the smallest key, where a null is the least, then by the text's hash.

    Rows are told apart by numbers of their own, so keys may be null or repeat.
    """
    rows, row = with_rows(docs, "near-rows")
    found = near_duplicates(rows, key=row, text=text, percent=percent).select(F.col("doc_id").alias("row"), "component_id")
    order = rows.select(F.col(row).alias("row"), F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("hash"), F.col(row).alias("row")).alias("order"))
    kept = found.join(order, "row").groupBy("component_id").agg(F.min("order").alias("least")).select(F.col("least.row").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)
