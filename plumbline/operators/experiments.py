"""Experiments: bootstrap intervals, stopping rules, privacy against utility, and models under cross-validation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import stats
from plumbline.operators.sampling import folds
from plumbline.storage import materialize

#: Blocks of rows whose sums are drawn from, of each group.
BLOCKS = 4096


def bootstrap_interval(rows: DataFrame, key: str, value: str, group: str, *, replicates: int = 10_000, share: float = 0.95, blocks: int = BLOCKS, seed: int = 7) -> DataFrame:
    """The percentile interval of the difference of means (group 1 less group 0) over so many resamples of both groups.

    All rows enter: they are summed by hash in ``blocks`` blocks a group, which are drawn with replacement instead of the rows. Where
    rows are fewer than blocks, a block is a row or few; where they are more, blocks are sums of equally many independent
    rows, so that the spread of the mean is the same, known to ``sqrt(2 / blocks)``. The block sums are ``2 * blocks`` rows at
    most; replicates are dealt to tasks, each with a generator of its own number.

    ``lower, upper, includes_zero, mean_difference, replicates``; no row for a group without values.
    """
    own = rows.where(F.col(value).isNotNull() & F.col(group).isin(0, 1))
    sums = own.groupBy(F.col(group).cast("int").alias("g"), F.pmod(F.xxhash64(key), F.lit(blocks)).alias("b")).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("double")).alias("s"))
    held = sums.orderBy("g", "b").toPandas()
    parts = [held[held["g"] == g][["n", "s"]].to_numpy(float) for g in (0, 1)]
    spark = rows.sparkSession
    if any(not len(p) for p in parts):
        return spark.createDataFrame([], "lower double, upper double, includes_zero boolean, mean_difference double, replicates long")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in batch.column(0).to_pylist():
                chance = np.random.default_rng([seed, i])
                means = []
                for p in parts:
                    n, s = chance.multinomial(len(p), np.full(len(p), 1 / len(p))) @ p
                    means.append(s / n)
                out.append(means[1] - means[0])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64())], names=["d"])

    drawn = spark.range(replicates).mapInArrow(draw, "d double")
    low, high = (1 - share) / 2, 1 - (1 - share) / 2
    ci = drawn.agg(F.percentile("d", F.array(F.lit(low), F.lit(high))).alias("ci"), F.avg("d").alias("mean_difference"), F.count("*").alias("replicates"))
    ends = ci.select(F.get("ci", F.lit(0)).alias("lower"), F.get("ci", F.lit(1)).alias("upper"), "mean_difference", "replicates")
    return ends.select("lower", "upper", ((F.col("lower") <= 0) & (F.col("upper") >= 0)).alias("includes_zero"), "mean_difference", "replicates")


def stopping_rule(n0: Column, n1: Column, lift: Column, significant: Column, days: Column, *, least: int = 1000, rollback: float = 0.05, most_days: int = 14) -> Column:
    """Whether a test ends: ``promote``, ``rollback`` or null. Both groups must have so many; a loss beyond the threshold ends it, then
    significance either way, then its longest duration."""
    return (
        F.when((n0 < least) | (n1 < least), F.lit(None).cast("string"))
        .when(lift < -rollback, "rollback")
        .when(significant & (lift > 0), "promote")
        .when(significant & (lift < 0), "rollback")
        .when(days >= most_days, F.when(lift < 0, "rollback").otherwise("promote"))
    )


def uniform(name: Column) -> Column:
    """A number between 0 and 1 by the digest of a name."""
    return (F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 32))


def laplace(name: Column, scale: Column) -> Column:
    """Laplace noise of a scale by the inverse of its distribution, at the uniform number of a name."""
    u = uniform(name) - 0.5
    return -scale * F.signum(u) * F.log(1 - 2 * F.abs(u))


def privacy_utility(rows: DataFrame, key: str, p: str, y: str, epsilons: list[float], *, clip: float = 4.0, bins: int = 20) -> DataFrame:
    """What privacy costs: for each epsilon the ``accuracy, f1, auc`` of rates of label 1 by bin of ``p``, learnt from noisy sums.

    A key's rows are scaled to a weight of ``clip`` together, so a key changes a sum by ``clip`` at most; each sum of a bin gets
    Laplace noise of ``2 * clip / epsilon``, as there are two sums (an infinite epsilon: none). Noise is by the names of epsilon,
    bin and sum, so a rerun adds the same. The bins' sums are all that is left of the rows.
    """
    weights = rows.groupBy(F.col(key).alias("__k")).agg(F.least(F.lit(1.0), clip / F.count("*")).alias("__w"))
    bin_ = F.least(F.floor(F.round(F.col(p) * bins, 9)), F.lit(bins - 1)).cast("int")
    own = rows.join(weights, rows[key] == weights["__k"]).groupBy(bin_.alias("bin")).agg(
        F.sum(F.col("__w") * F.col(y)).alias("ws"), F.sum("__w").alias("wn"), F.sum(F.col(y)).cast("double").alias("pos"), F.sum(1 - F.col(y)).cast("double").alias("neg")
    )
    named = [F.struct(F.lit(str(e)).alias("name"), F.lit(float(e)).alias("epsilon"), F.lit(0.0 if e == float("inf") else 2 * clip / e).alias("scale")) for e in epsilons]
    noisy = own.withColumn("e", F.explode(F.array(*named))).select("*", "e.*")
    names = [F.concat_ws(":", "name", F.col("bin").cast("string"), F.lit(x)) for x in ("s", "n")]
    ws, wn = F.col("ws") + laplace(names[0], F.col("scale")), F.col("wn") + laplace(names[1], F.col("scale"))
    rated = noisy.select("name", "epsilon", "bin", "pos", "neg", F.least(F.greatest(F.round(ws / F.greatest(wn, F.lit(1.0)), 9), F.lit(0.0)), F.lit(1.0)).alias("rate"))
    hit = F.col("rate") > 0.5
    tp, fp, fn, tn = (F.sum(F.when(h, F.col(c)).otherwise(0.0)) for h, c in ((hit, "pos"), (hit, "neg"), (~hit, "pos"), (~hit, "neg")))
    figures = rated.groupBy("name", "epsilon").agg(((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"), stats.ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))
    other = rated.select(F.col("name").alias("__name"), F.col("neg").alias("__neg"), F.col("rate").alias("__rate"))
    pairs = rated.join(other, F.col("name") == F.col("__name"))
    above = F.col("pos") * F.col("__neg") * F.when(F.col("rate") > F.col("__rate"), 1.0).when(F.col("rate") == F.col("__rate"), 0.5).otherwise(0.0)
    area = pairs.groupBy(F.col("name").alias("__name")).agg((F.sum(above) / F.sum(F.col("pos") * F.col("__neg"))).alias("auc"))
    return figures.join(area, F.col("name") == F.col("__name")).select(F.col("name").alias("epsilon"), *(F.round(c, 6).alias(c) for c in ("accuracy", "f1", "auc")))


def cross_validated(rows: DataFrame, key: str, features: list[str], label: str, *, parameters: tuple[float, ...] = (0.0, 0.1), n_folds: int = 5) -> DataFrame:
    """Standardised logistic regression under cross-validation over folds by hash of the key.

    The regularisation is chosen by the mean area under the curve over all folds; then a row for each fold: ``fold, parameter, n,
    accuracy, auc`` of the model that has not seen it. A model is fitted once for each fold and parameter, which gives both.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    own = rows.select(F.col(key), *(F.col(f).cast("double").alias(f) for f in features), F.col(label).cast("double").alias("label"), folds(key, n_folds).cast("int").alias("fold"))
    own = materialize(VectorAssembler(inputCols=features, outputCol="raw").transform(own).select("raw", "label", "fold"), "folds")
    evaluator = BinaryClassificationEvaluator()
    figures: dict[float, list[tuple]] = {p: [] for p in parameters}
    for fold in range(n_folds):
        seen, unseen = own.where(F.col("fold") != fold), own.where(F.col("fold") == fold)
        scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(seen)
        train, test = (scaler.transform(df).select("features", "label") for df in (seen, unseen))
        for p in parameters:
            scored = LogisticRegression(maxIter=20, regParam=p).fit(train).transform(test)
            row = scored.agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("int")).alias("accuracy")).collect()[0]
            figures[p].append((fold, float(p), row["n"], row["accuracy"], evaluator.evaluate(scored)))
    best = max(parameters, key=lambda p: np.mean([f[-1] for f in figures[p]]))
    return rows.sparkSession.createDataFrame(figures[best], "fold int, parameter double, n long, accuracy double, auc double")
