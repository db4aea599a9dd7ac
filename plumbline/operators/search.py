"""Top-k search by an inverted index with upper bounds, and by inverted lists of vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scores import dot
from plumbline.operators.vectors import against_all
from plumbline.storage import materialize

#: Postings read to find a first threshold, as a multiple of k.
SEED_POSTINGS = 4
#: Vectors a part of a cell holds, about; queries that meet a part at once; vectors that k-means sees at most; cells at most.
PART_ROWS, QUERY_BLOCK, SAMPLE_ROWS, MOST_CELLS = 4096, 1024, 20_000, 1024
#: Queries for which recall is measured, and the recall that the number of probes is chosen for.
MEASURED, RECALL = 64, 0.95


class WordIndex:
    """Postings of the distinct words of documents (``doc_id, tokens, ws``), in blocks by word and size of document.

    A document can share no more words with a query than it has, so a block's most words are an upper bound of its scores. Blocks are
    a table of ``w, class, size, most``; postings have ``w, class, doc_id, n``. Where an index is made for known ``queries``, words
    that none of them has are never looked up: they are left out of the words that are kept, but not of ``tokens`` and ``n``.
    """

    def __init__(self, docs: DataFrame, queries: DataFrame | None = None) -> None:
        own = docs.select("doc_id", "tokens", "ws", F.size("ws").alias("n"))
        if queries is not None:
            asked = queries.select(F.explode("ws").alias("w")).agg(F.collect_set("w").alias("asked"))
            own = own.crossJoin(F.broadcast(asked)).select("doc_id", "tokens", F.array_intersect("ws", "asked").alias("ws"), "n")
        self.docs = materialize(own, "search-docs")
        rows = self.docs.where("n > 0").select("doc_id", "n", F.floor(F.log2("n")).cast("int").alias("class"), F.explode("ws").alias("w"))
        self.postings = materialize(rows.repartition("w").sortWithinPartitions("w", "class"), "search-postings")
        self.blocks = materialize(self.postings.groupBy("w", "class").agg(F.count("*").alias("size"), F.max("n").alias("most")), "search-blocks")

    def exact(self, pairs: DataFrame, queries: DataFrame) -> DataFrame:
        """The hits of ``item_id, doc_id`` pairs: distinct words that both have."""
        own = pairs.join(queries.select("item_id", F.col("ws").alias("qs")), "item_id").join(self.docs.select("doc_id", "tokens", "ws"), "doc_id")
        return own.select("item_id", "doc_id", "tokens", F.size(F.array_intersect("ws", "qs")).cast("long").alias("hits"))

    def ranked_words(self, queries: DataFrame) -> DataFrame:
        """The words of each query that occur, rarest first: ``item_id, w, place`` (1 on), ``words`` (how many) and ``before``, the postings of rarer ones."""
        totals = self.blocks.groupBy("w").agg(F.sum("size").alias("df"))
        rows = queries.select("item_id", F.explode("ws").alias("w")).join(totals, "w")
        order = Window.partitionBy("item_id").orderBy("df", "w")
        every = Window.partitionBy("item_id")
        before = F.coalesce(F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return rows.select("item_id", "w", F.row_number().over(order).alias("place"), F.count("*").over(every).alias("words"), before.alias("before"))

    def thresholds(self, queries: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
        """``item_id, least``: hits that the ``k``-th best document has at least, by the documents that the rarest words name."""
        seeds = ranked.where(F.col("before") < SEED_POSTINGS * k).select("item_id", "w")
        some = seeds.join(self.postings.select("w", "doc_id"), "w").groupBy("item_id", "doc_id").agg(F.count("*").alias("some"))
        place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("some"), "doc_id"))
        best = some.withColumn("p", place).where(F.col("p") <= k).select("item_id", "doc_id")
        own = self.exact(best, queries).groupBy("item_id").agg(F.min("hits").alias("least"), F.count("*").alias("found"))
        return own.select("item_id", F.when(F.col("found") >= k, F.col("least")).otherwise(1).alias("least"))

    def wanted_blocks(self, ranked: DataFrame, thresholds: DataFrame) -> DataFrame:
        """The blocks a query reads. Of any document with enough hits one is among the query's rarest words but ``least - 1``;
        blocks whose documents have too few words are skipped."""
        own = ranked.join(thresholds, "item_id").where("place <= words - least + 1").select("item_id", "w", "least")
        return own.join(self.blocks, "w").where("most >= least").select("item_id", "w", "class", "size", "least")

    def top(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """The ``k`` documents with most shared words for each of ``item_id, ws``: ``item_id, doc_id, tokens, hits, place``; ties
        by id. And the postings read and there are for all queries: ``read, there``."""
        ranked = materialize(self.ranked_words(queries), "search-words")
        thresholds = materialize(self.thresholds(queries, ranked, k), "search-least")
        wanted = materialize(self.wanted_blocks(ranked, thresholds), "search-blocks")
        pairs = wanted.drop("size").join(self.postings, ["w", "class"]).where("n >= least").select("item_id", "doc_id", "least").distinct()
        hits = self.exact(pairs, queries).join(thresholds, "item_id").where("hits >= least")
        place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("hits"), "doc_id"))
        out = hits.withColumn("place", place.cast("long")).where(F.col("place") <= k).drop("least")
        there = ranked.join(self.blocks, "w").agg(F.sum("size").alias("there"))
        return out, wanted.agg(F.sum("size").alias("read")).crossJoin(there)


class CellIndex:
    """Vectors in cells around the centres of k-means, which is fitted on a bounded sample; every vector is in its nearest cell.

    The sample are the ``SAMPLE_ROWS`` vectors of least hash. Cells are cut in parts of about ``PART_ROWS`` vectors, so that one of
    many equal vectors is no single task's. Centres are on the driver, ``MOST_CELLS`` at most.
    """

    def __init__(self, vectors: DataFrame, key: str, vector: str, *, cells: int | None = None, seed: int = 5) -> None:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        self.key, self.vector = key, vector
        own = vectors.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
        n = own.count()
        sample = own.orderBy(F.xxhash64("k"), "k").limit(SAMPLE_ROWS).select(array_to_vector("v").alias("features"))
        model = KMeans(k=cells or max(1, min(MOST_CELLS, int(n**0.5))), seed=seed, maxIter=10).fit(materialize_vectors(sample))
        self.centres = np.array(model.clusterCenters())
        placed = materialize(own.mapInArrow(self._nearest(1), "k bigint, v array<double>, cell int"), "cells")
        parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
        self.parts = materialize(parts, "cell-parts")
        self.placed = placed.join(F.broadcast(self.parts), "cell").withColumn("part", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int")).drop("parts")

    def _nearest(self, probes: int):
        """A task that gives each ``k, v`` its nearest cells, a row each."""
        centres = self.centres
        square = (centres**2).sum(1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                v = np.array(batch.column(1).to_pylist(), float)
                apart = square - 2 * v @ centres.T
                cells = np.argsort(apart, axis=1, kind="stable")[:, :probes]
                at = np.repeat(np.arange(len(v)), cells.shape[1])
                columns = [c.take(pa.array(at)) for c in (batch.column(0), batch.column(1))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(cells.ravel().astype(np.int32))], names=["k", "v", "cell"])

        return run

    def search(self, queries: DataFrame, k: int, probes: int, metric: str = "dot") -> DataFrame:
        """``query_id, k, score``: the ``k`` best vectors other than the query itself in its ``probes`` nearest cells. ``queries`` has ``k, v``."""
        near = queries.mapInArrow(self._nearest(probes), "k bigint, v array<double>, cell int")
        blocks = max(1, -(-queries.count() // QUERY_BLOCK))
        near = near.withColumn("block", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")).join(F.broadcast(self.parts), "cell")
        near = near.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        rows = self.placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

        def best(left: pa.Table, right: pa.Table) -> pa.Table:
            names, types = ["query_id", "k", "score"], [pa.int64(), pa.int64(), pa.float64()]
            if not len(left) or not len(right):
                return pa.table([pa.array([], t) for t in types], names=names)
            v, q = (np.array(t.column("v").to_pylist(), float) for t in (left, right))
            ids, asked = left.column("k").to_numpy(), right.column("k").to_numpy()
            score = q @ v.T if metric == "dot" else -np.sqrt(np.maximum((q**2).sum(1)[:, None] + (v**2).sum(1) - 2 * q @ v.T, 0))
            score[asked[:, None] == ids] = -np.inf
            top = np.lexsort((np.broadcast_to(ids, score.shape), -score.round(9)), axis=1)[:, :k]
            at = np.repeat(np.arange(len(q)), top.shape[1])
            values = score[at, top.ravel()]
            kept = np.isfinite(values)
            return pa.table([pa.array(asked[at][kept]), pa.array(ids[top.ravel()][kept]), pa.array(values[kept])], names=names)

        keys = ["cell", "part", "block"]
        found = rows.groupBy(*keys).cogroup(near.groupBy(*keys)).applyInArrow(best, "query_id long, k long, score double")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "k"))
        return found.withColumn("place", place.cast("long")).where(F.col("place") <= k)

    def measured_probes(self, k: int, metric: str = "dot", *, queries: int = MEASURED, wanted: float = RECALL) -> tuple[int, float]:
        """The least power of two of probes with the recall ``wanted``, or all cells; and the recall.

        It is measured against all vectors, for the ``queries`` vectors of the next least hashes.
        """
        asked = self.placed.select("k", "v").orderBy(F.xxhash64("k", F.lit(1)), "k").limit(queries)
        asked = materialize(asked, "cell-queries")
        all_ = against_all(self.placed.select("k", "v"), asked.toDF("query_id", "q"), "k", "query_id")
        square = reduce(lambda a, b: a + b, [F.aggregate(F.zip_with("v", "q", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)])
        scored = all_.select("query_id", "k", (dot(F.col("v"), F.col("q")) if metric == "dot" else -F.sqrt(square)).alias("score"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "k"))
        truth = materialize(scored.withColumn("place", place).where(F.col("place") <= k).select("query_id", "k"), "cell-truth")
        total, probes = max(1, truth.count()), 1
        while True:
            found = self.search(asked, k, probes, metric).select("query_id", "k").join(truth, ["query_id", "k"]).count() / total
            if found >= wanted or probes >= len(self.centres):
                return min(probes, len(self.centres)), found
            probes *= 2


def materialize_vectors(sample: DataFrame) -> DataFrame:
    """Spark ML passes over its input again and again."""
    return materialize(sample, "cell-sample")
