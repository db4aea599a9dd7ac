"""Weak labels: votes of labeling functions, their weighted majority, and rule scores."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LabelingFunction:
    """A named vote: 1, 0, or -1 to abstain; never null."""

    name: str
    weight: float
    vote: Column


def vote(positive: Column, negative: Column) -> Column:
    return F.when(F.coalesce(positive, F.lit(False)), 1).when(F.coalesce(negative, F.lit(False)), 0).otherwise(-1)


def standard_functions(*, engagement: str, sentiment: str, toxicity: str, severe: str, comments: str, communities: str, days: str, actions: str, hedges: str) -> list[LabelingFunction]:
    """The seven functions; their thresholds and weights are fixed values."""
    c = F.col
    return [
        LabelingFunction("lf_engagement", 2.0, vote(c(engagement) > 500, c(engagement) < 20)),
        LabelingFunction("lf_sentiment", 1.5, vote(c(sentiment) < -0.4, c(sentiment) > 0.2)),
        LabelingFunction("lf_toxicity", 1.5, vote((c(toxicity) > 0.6) | (c(severe) > 0.5), (c(toxicity) < 0.2) & (c(severe) < 0.1))),
        LabelingFunction("lf_action", 3.0, vote((c(actions) >= 2) & (c(hedges) == 0), (c(actions) == 0) & (c(hedges) >= 2))),
        LabelingFunction("lf_communities", 1.0, vote(c(communities) >= 3, c(communities) == 0)),
        LabelingFunction("lf_comments", 2.0, vote(c(comments) > 50, c(comments) < 5)),
        LabelingFunction("lf_persistence", 1.0, vote(c(days) >= 3, c(days) == 0)),
    ]


def weak_label(rows: DataFrame, functions: list[LabelingFunction]) -> DataFrame:
    """Votes, tallies, weighted sums, label (the heavier side, -1 on a tie) and confidence (the difference over all weights)."""
    out = rows.withColumns({f.name: f.vote for f in functions})
    add = lambda columns: reduce(lambda a, b: a + b, columns)
    tally = {f"n_{n}": add([(F.col(f.name) == v).cast("int") for f in functions]) for n, v in (("pos", 1), ("neg", 0), ("abstain", -1))}
    weights = {f"w_{n}": add([F.when(F.col(f.name) == v, F.lit(f.weight)).otherwise(0.0) for f in functions]) for n, v in (("pos", 1), ("neg", 0))}
    out = out.withColumns(tally | weights)
    label = F.when(F.col("w_pos") > F.col("w_neg"), 1).when(F.col("w_neg") > F.col("w_pos"), 0).otherwise(-1)
    return out.withColumns({"weak_label": label, "confidence": F.abs(F.col("w_pos") - F.col("w_neg")) / sum(f.weight for f in functions)})


def points(*conditions: tuple[Column, int]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(F.coalesce(c, F.lit(False)), n).otherwise(0) for c, n in conditions])
