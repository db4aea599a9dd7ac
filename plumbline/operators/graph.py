"""Graph computations over edge tables: rounds of joins, each aggregated per node before it moves on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def undirected(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    both = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"))
    return both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def mean_of_neighbours(edges: DataFrame, features: DataFrame, node: str = "node", vector: str = "v") -> DataFrame:
    """For each node the mean of its neighbours' vectors, dimension by dimension."""
    rows = edges.join(features.withColumnRenamed(node, "dst"), "dst").select(F.col("src").alias(node), F.posexplode(vector).alias("i", "x"))
    means = rows.groupBy(node, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(node).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("own")).select(node, F.transform("own", lambda s: s["x"]).alias(vector))


def sage_layer(edges: DataFrame, features: DataFrame, node: str = "node", vector: str = "v") -> DataFrame:
    """Own vector joined with the neighbours' mean (zeros without neighbours): the relational half of a GraphSAGE layer."""
    near = mean_of_neighbours(edges, features, node, vector).withColumnRenamed(vector, "__near")
    joined = features.join(near, node, "left")
    empty = F.transform(vector, lambda x: F.lit(0.0))
    return joined.select(node, F.concat(F.transform(vector, lambda x: x.cast("double")), F.coalesce("__near", empty)).alias(vector))


def random_embedding(edges: DataFrame, dims: int = 8, weights: tuple[float, ...] = (0.0, 1.0, 1.0), seed: int = 42) -> DataFrame:
    """Fast random projection: signed sparse vectors by hash of the node, averaged over neighbours once per weight."""
    pairs = undirected(edges)
    sign = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.element_at(F.array(F.lit(-1.0), F.lit(0.0), F.lit(1.0)), (F.pmod(F.xxhash64("node", i, F.lit(seed)), F.lit(3)) + 1).cast("int")))
    layer = pairs.select(F.col("src").alias("node")).distinct().withColumn("v", sign)
    total = layer.select("node", F.transform("v", lambda x: x * weights[0]).alias("sum"))
    for weight in weights[1:]:
        layer = mean_of_neighbours(pairs, layer)
        scaled = layer.select("node", F.transform("v", lambda x: x * weight).alias("more"))  # noqa: B023
        total = total.join(scaled, "node").select("node", F.zip_with("sum", "more", lambda a, b: a + b).alias("sum"))
    return total.select("node", F.col("sum").alias("v"))


def co_members(members: DataFrame, item: str, group: str, most: int) -> DataFrame:
    """Pairs ``a < b`` of the first ``most`` items of each group, the cap being the operator's meaning."""
    own = members.select(F.col(group).alias("g"), F.col(item).alias("i")).distinct()
    own = own.withColumn("__p", F.row_number().over(Window.partitionBy("g").orderBy("i"))).where(F.col("__p") <= most).drop("__p")
    return own.withColumnRenamed("i", "a").join(own.withColumnRenamed("i", "b"), "g").where("a < b").select("a", "b", "g")
