"""Statistics over tables: metrics, calibration, fairness, tests and drift. All are aggregates; ranks are by value, not row."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.sampling import by_range


def confusion(y: str = "y", p: str = "p") -> list[Column]:
    """tp, fp, fn, tn of label and prediction columns of 0 and 1."""
    return [F.count_if((F.col(p) == i) & (F.col(y) == j)).alias(n) for n, i, j in (("tp", 1, 1), ("fp", 1, 0), ("fn", 0, 1), ("tn", 0, 0))]


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(0.0)


def classification(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Metrics of a confusion: accuracy, precision, recall, F1 of class 1, macro and weighted, MCC, kappa."""
    n = tp + fp + fn + tn
    f1, f0 = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    chance = ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)
    root = F.sqrt((tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn))
    accuracy = (tp + tn) / n
    return {
        "accuracy": accuracy,
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": f1,
        "f1_macro": (f1 + f0) / 2,
        "f1_weighted": (f1 * (tp + fn) + f0 * (tn + fp)) / n,
        "mcc": ratio(tp.cast("double") * tn - fp.cast("double") * fn, root),
        "kappa": ratio(accuracy - chance, 1 - chance),
    }


def by_value(rows: DataFrame, value: str, label: str) -> DataFrame:
    """Per distinct value: rows of label 1 and 0, and those of lower values; ranks follow without numbering rows.

    Values are dealt by range: a running sum is that within the value's range plus the ranges before, of which there is one
    row each, so that no task sees all values.
    """
    own = rows.groupBy(F.col(value).alias("x")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    return own_and_below(own, ["x"], ["pos", "neg"])


def own_and_below(rows: DataFrame, order: list[str], sums: list[str], group: str | None = None) -> DataFrame:
    """The rows with, for each of the columns ``sums``, its sum over the lower rows by ``order`` (of the row's group): ``<column>_below``."""
    groups = [group] if group else []
    rows = by_range(rows, [*groups, *order])
    within = Window.partitionBy(*groups, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*groups).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy(*groups, "__range").agg(*(F.sum(c).alias(c) for c in sums))
    bases = bases.select(F.col("__range").alias("__r"), *(F.col(g).alias("__g") for g in groups), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}") for c in sums))
    rows = rows.withColumns({f"{c}_below": F.coalesce(F.sum(c).over(within), F.lit(0)) for c in sums})
    same = F.col("__range") == F.col("__r")
    joined = rows.join(bases, same & F.col(group).eqNullSafe(F.col("__g")) if group else same)
    return joined.withColumns({f"{c}_below": F.col(f"{c}_below") + F.col(f"__{c}") for c in sums}).drop("__range", "__r", "__g", *(f"__{c}" for c in sums))


def quantiles(rows: DataFrame, value: str, shares: list[float], group: str | None = None) -> DataFrame:
    """``q``, the exact quantiles of a column at ``shares``, linear between neighbours; a row a group, or one row.

    Values are counted, and found by their places in ranges: a group's distinct values needn't fit in a task, as they must for
    ``percentile``. Nulls are left out; a group without values has no row, and without groups no values give nulls.
    """
    groups = [group] if group else []
    counts = rows.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).cast("double").alias("__x")).agg(F.count("*").alias("__n"))
    counts = own_and_below(counts, ["__x"], ["__n"], group)
    total = counts.groupBy(*(F.col(g).alias("__g") for g in groups)).agg(F.sum("__n").alias("__total"))
    joined = counts.join(total, F.col(group).eqNullSafe(F.col("__g"))) if group else counts.crossJoin(F.broadcast(total))

    def at(place: Column) -> Column:
        return F.min(F.when((F.col("__n_below") <= place) & (place < F.col("__n_below") + F.col("__n")), F.col("__x")))

    columns = []
    for i, share in enumerate(shares):
        place = (F.col("__total") - 1) * F.lit(share)
        columns += [at(F.floor(place)).alias(f"__low{i}"), at(F.ceil(place)).alias(f"__high{i}"), F.max(place - F.floor(place)).alias(f"__part{i}")]
    own = joined.groupBy(*groups).agg(*columns)
    low, high, part = ([F.col(f"__{n}{i}") for i in range(len(shares))] for n in ("low", "high", "part"))
    q = F.array(*(F.when(a == b, a).otherwise((1 - p) * a + p * b) for a, b, p in zip(low, high, part, strict=True)))
    return own.select(*groups, q.alias("q"))


def roc_auc(rows: DataFrame, value: str, label: str) -> DataFrame:
    """Area under the ROC curve by rank sums, ties counting half."""
    v = by_value(rows, value, label)
    area = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    return v.agg((area / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def average_precision(rows: DataFrame, value: str, label: str) -> DataFrame:
    v = by_value(rows, value, label)
    total = v.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    v = v.crossJoin(F.broadcast(total))
    above_pos, above_neg = F.col("p") - F.col("pos_below"), F.col("n") - F.col("neg_below")
    return v.agg(F.sum(ratio(above_pos, above_pos + above_neg) * F.col("pos") / F.col("p")).alias("ap"))


def calibration_error(rows: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Expected and largest calibration error over right-closed bins; a probability of 0 is in none."""
    bin_ = F.ceil(F.round(F.col(p) * bins, 9))
    own = rows.where(F.col(p) > 0).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg(y) - F.avg(p)).alias("gap"))
    total = rows.agg(F.count("*").alias("total"))
    return own.crossJoin(F.broadcast(total)).agg(F.sum(F.col("gap") * F.col("n") / F.col("total")).alias("ece"), F.max("gap").alias("mce"))


def ks_statistic(rows: DataFrame, value: str, group: str) -> DataFrame:
    """Largest difference of two samples' distribution functions (groups 0 and 1), over distinct values."""
    v = by_value(rows, value, group)
    total = v.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    v = v.crossJoin(F.broadcast(total))
    gap = F.abs((F.col("pos_below") + F.col("pos")) / F.col("p") - (F.col("neg_below") + F.col("neg")) / F.col("n"))
    return v.agg(F.max(gap).alias("ks"))


def psi(rows: DataFrame, value: str, group: str, bins: int = 10, eps: float = 1e-10, low: float | None = None, high: float | None = None) -> DataFrame:
    """Population stability index of group 1 against group 0, over even bins of a given or of the joint range, and KL."""
    if low is None or high is None:
        span = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    else:
        span = rows.sparkSession.range(1).select(F.lit(low).alias("lo"), F.lit(high).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.floor(F.round((F.col(value) - F.col("lo")) / width, 9)) + 1, F.lit(bins))).otherwise(1)
    counts = rows.crossJoin(F.broadcast(span)).groupBy(bin_.alias("bin")).agg(F.count_if(F.col(group) == 0).alias("e"), F.count_if(F.col(group) == 1).alias("a"))
    total = counts.agg(F.sum("e").alias("te"), F.sum("a").alias("ta"))
    every = rows.sparkSession.range(1, bins + 1).toDF("bin").join(counts, "bin", "left").crossJoin(F.broadcast(total))
    e, a = (F.coalesce(F.col(c), F.lit(0)) / F.col(t) + eps for c, t in (("e", "te"), ("a", "ta")))
    return every.agg(F.sum((a - e) * F.log(a / e)).alias("psi"), F.sum(a * F.log(a / e)).alias("kl"))


def welch(rows: DataFrame, value: str, group: str) -> DataFrame:
    """Welch's t, its degrees of freedom, two-sided p and the lift of group 1 over the absolute mean of group 0."""
    m = {}
    for g in (0, 1):
        x = F.when(F.col(group) == g, F.col(value))
        m |= {f"n{g}": F.count(x), f"m{g}": F.avg(x), f"v{g}": F.var_samp(x)}
    own = rows.agg(*(c.alias(n) for n, c in m.items()))
    a, b = F.col("v0") / F.col("n0"), F.col("v1") / F.col("n1")
    t = (F.col("m1") - F.col("m0")) / F.sqrt(a + b)
    df = (a + b) * (a + b) / (a * a / (F.col("n0") - 1) + b * b / (F.col("n1") - 1))
    own = own.select(t.alias("t"), df.alias("df"), ratio(F.col("m1") - F.col("m0"), F.abs("m0")).alias("lift"))
    return own.withColumn("p_value", student_p("t", "df"))


def mann_whitney(rows: DataFrame, value: str, group: str) -> DataFrame:
    """U of group 1 with average ranks, z by the normal approximation with tie correction, and two-sided p."""
    v = by_value(rows, value, group)
    t = F.col("pos") + F.col("neg")
    own = v.agg(
        F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("n1"), F.sum("neg").alias("n0"), F.sum((t * t * t - t).cast("double")).alias("ties")
    )
    n = F.col("n1") + F.col("n0")
    sigma = F.sqrt(F.col("n1").cast("double") * F.col("n0") / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    own = own.withColumn("z", (F.col("u") - F.col("n1").cast("double") * F.col("n0") / 2) / sigma)
    return own.select("u", "z", normal_p("z").alias("p_value"))


def student_p(t: str, df: str) -> Column:
    @F.pandas_udf("double")
    def run(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([math.nan if math.isnan(a) else _incomplete_beta(b / (b + a * a), b / 2, 0.5) for a, b in zip(t, df, strict=True)])

    return run(t, df)


def normal_p(z: str) -> Column:
    @F.pandas_udf("double")
    def run(z: pd.Series) -> pd.Series:
        return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)))

    return run(z)


def _incomplete_beta(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 300):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + k * d or tiny), 1 + k / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h
