"""Links between the members of overlapping buckets, verified in cells of bounded size, without all pairs of a bucket.

A bucket holds nodes every two of which are a candidate pair. First each node meets the most central node of its buckets,
a few members a cell, which joins nearly all groups of copies. Buckets that are still in several components are gone
through whole: small ones in one cell; large ones that overlap together, those outside the largest component cut in
blocks that meet each other and the blocks of the rest. Pairs that are connected already need not meet, so the components
of the links are those of all candidate pairs that hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import connected_components
from plumbline.llm.storage import materialize

#: Members that meet a central node in one cell; members of a bucket that meet in one cell; members and weight of a block.
STAR, SMALL, BLOCK, BLOCK_WEIGHT = 32, 64, 128, 1 << 20
#: Nodes of a bucket that one task joins with what is known of the bucket.
PART = 256
#: Bytes of members that pass a cell's pivots at once.
PASS_BYTES = 2 << 20
#: Roles in a cell: compared with the pivots and a pivot; a pivot only; compared with the pivots only.
BOTH, PIVOT, MEMBER = 0, 1, 2

#: Links ``(i, j)`` between bodies ``0 .. pivots - 1`` and those from ``others`` on that connect as all of them do.
Link = Callable[[list[bytes], int, int], list[tuple[int, int]]]


def find(up: list[int], x: int) -> int:
    """The root of ``x`` in a union-find forest."""
    while up[x] != x:
        up[x] = x = up[up[x]]
    return x


def bucketed(rows: DataFrame, name: str) -> DataFrame:
    """``node, weight, band, value`` rows of buckets of two nodes and more, with the bucket's size ``n`` and the node's part."""
    shared = rows.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    part = F.pmod(F.xxhash64("node"), F.floor(F.col("n") / PART) + 1).cast("int")
    return materialize(rows.join(shared, ["band", "value"]).withColumn("part_no", part), name)


def linked(buckets: DataFrame, bodies: DataFrame, link: Link) -> DataFrame:
    """Links ``a, b`` of nodes, found by ``link``; ``bodies`` has the ``node, body`` of each."""
    links = materialize(_verified(_star_cells(buckets), bodies, link), "cell-links")
    left = _open_buckets(buckets, links)
    more = materialize(_verified(_small_cells(left).unionByName(_block_cells(left)), bodies, link), "cell-links")
    return links.unionByName(more)


def _verified(cells: DataFrame, bodies: DataFrame, link: Link) -> DataFrame:
    """Links ``a, b`` of nodes that meet in a cell: ``cell long, role int, node`` rows, streamed cell by cell.

    A task holds the pivots of one cell and ``PASS_BYTES`` of the members that pass them.
    """
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, pivots, waiting, size = None, [], [], 0

        def links() -> pa.RecordBatch:
            both = not waiting or waiting[0][0] == BOTH
            rows = pivots + [w[1:] for w in waiting if w[0] != BOTH]
            found = link([body for _, body in rows], len(pivots), 0 if both else len(pivots))
            return pa.RecordBatch.from_arrays([pa.array([rows[p[x]][0] for p in found], pa.binary()) for x in (0, 1)], names=["a", "b"])

        for batch in batches:
            for c, role, node, body in zip(*(batch.column(x).to_pylist() for x in ("cell", "role", "node", "body")), strict=True):
                if c != cell:
                    if waiting and pivots:
                        yield links()
                    cell, pivots, waiting, size = c, [], [], 0
                if role != MEMBER:
                    pivots.append((node, body))
                if role != PIVOT:
                    waiting.append((role, node, body))
                    size += len(body)
                if role == MEMBER and size > PASS_BYTES and pivots:
                    yield links()
                    waiting, size = [], 0
        if waiting and pivots:
            yield links()

    met = cells.join(bodies, "node").select("cell", "role", "node", "body")
    return met.repartition(n, "cell").sortWithinPartitions("cell", "role").mapInArrow(run, "a binary, b binary")


def _in_parts(buckets: DataFrame) -> DataFrame:
    """A row for each part of each bucket (``band, value, n``): a large bucket's nodes are dealt to several, for joins."""
    return buckets.withColumn("part_no", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / PART).cast("int"))))


def _star_cells(buckets: DataFrame) -> DataFrame:
    """Each node with the most central node of its buckets (the one whose buckets hold most), ``STAR`` members a cell."""
    scores = buckets.groupBy("node").agg(F.sum("n").alias("score"))
    heads = buckets.join(scores, "node").groupBy("band", "value", "n").agg(F.max(F.struct("score", "node")).alias("head"))
    stars = buckets.join(_in_parts(heads).drop("n"), ["band", "value", "part_no"]).groupBy("node").agg(F.max("head").alias("head"))
    stars = materialize(stars.select("node", F.col("head.node").alias("head")).where("node <> head"), "cell-stars")
    sizes = stars.groupBy("head").agg(F.ceil(F.count("*") / STAR).alias("parts"))
    own = F.xxhash64(F.lit("star"), "head", F.pmod(F.xxhash64("node"), F.col("parts")))
    members = stars.join(sizes, "head").select("head", "node", own.alias("cell"))
    pivots = members.select("cell", F.lit(PIVOT).alias("role"), F.col("head").alias("node")).distinct()
    return pivots.unionByName(members.select("cell", F.lit(MEMBER).alias("role"), "node"))


def _open_buckets(buckets: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of buckets in which nodes of several components still meet, with the node's component ``part``."""
    parts = connected_components(links).select("node", F.col("component").alias("part"))
    rows = buckets.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    still = rows.groupBy("band", "value", "n").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high")
    return materialize(rows.join(_in_parts(still).select("band", "value", "part_no"), ["band", "value", "part_no"]), "cell-open")


def _small_cells(rows: DataFrame) -> DataFrame:
    """A cell for each bucket of up to ``SMALL`` nodes; one of those that hold the same nodes."""
    small = rows.where(F.col("n") <= SMALL)
    seen = small.groupBy("band", "value", "n").agg(F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"))
    once = seen.groupBy("n", "x", "y").agg(F.min(F.struct("band", "value")).alias("first")).select("first.band", "first.value")
    return small.join(once, ["band", "value"]).select(F.xxhash64(F.lit("small"), "band", "value").alias("cell"), F.lit(BOTH).alias("role"), "node")


def _block_cells(rows: DataFrame) -> DataFrame:
    """Cells of the larger buckets, joined to families where they overlap.

    A family's nodes outside its largest component are cut into blocks, and so are those inside; each outer block is a cell
    by itself, with each later outer block, and with each inner block.
    """
    large = rows.where(F.col("n") > SMALL)
    heads = _in_parts(large.groupBy("band", "value", "n").agg(F.min("node").alias("head"))).drop("n")
    edges = large.join(heads, ["band", "value", "part_no"]).select(F.col("node").alias("a"), F.col("head").alias("b"))
    families = connected_components(edges).select("node", F.col("component").alias("family"))
    nodes = materialize(families.join(large.select("node", "part", "weight").distinct(), "node"), "cell-families")
    parts = nodes.groupBy("family", "part").agg(F.count("*").alias("m"), F.sum("weight").alias("s"))
    top = F.max(F.struct("m", "part", "s")).alias("top")
    sizes = parts.groupBy("family").agg(top, F.sum("m").alias("m"), F.sum("s").alias("s"))

    def blocks(m: Column, s: Column) -> Column:
        return F.greatest(F.ceil(m / BLOCK), F.ceil(s / BLOCK_WEIGHT), F.lit(1)).cast("int")

    sizes = sizes.select(
        "family",
        F.col("top.part").alias("inner"),
        blocks(F.col("m") - F.col("top.m"), F.col("s") - F.col("top.s")).alias("n_outer"),
        blocks(F.col("top.m"), F.col("top.s")).alias("n_inner"),
    )
    inner = F.col("part") == F.col("inner")
    own = nodes.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.when(inner, F.col("n_inner")).otherwise(F.col("n_outer"))).cast("int"))

    def cell(kind: str, i: Column, j: Column, role: Column) -> Column:
        return F.struct(F.xxhash64(F.lit(kind), "family", i, j).alias("cell"), role.alias("role"))

    def upto(n: str) -> Column:
        return F.sequence(F.lit(0), F.col(n) - 1)

    block = F.col("block")
    among = F.transform(upto("n_outer"), lambda j: cell("outer", F.least(block, j), F.greatest(block, j), F.when(j == block, BOTH).when(block < j, PIVOT).otherwise(MEMBER)))
    against = F.transform(upto("n_inner"), lambda j: cell("inner", block, j, F.lit(PIVOT)))
    passing = F.transform(upto("n_outer"), lambda i: cell("inner", i, block, F.lit(MEMBER)))
    cells = F.explode(F.when(inner, passing).otherwise(F.concat(among, against)))
    return own.select("node", cells.alias("c")).select("c.cell", "c.role", "node")
