"""Validation suites: figures in one pass, then a row per check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def validate(df: DataFrame, figures: dict[str, Column], checks: dict[str, tuple[str, str]]) -> DataFrame:
    """``check_name, passed, value`` of each check: its figure and a condition over all figures."""
    own = df.agg(*(c.alias(n) for n, c in figures.items()))
    rows = F.array(*(F.struct(F.lit(n).alias("check_name"), F.expr(c).alias("passed"), F.round(F.col(v).cast("double"), 9).alias("value")) for n, (v, c) in checks.items()))
    return own.select(F.explode(rows).alias("r")).select("r.*")


def overall(results: DataFrame, strict: bool = False, tolerance: float = 0.05) -> DataFrame:
    """Whether a suite passed: all checks if strict, else all but a share of them."""
    failed = F.avg((~F.col("passed")).cast("int"))
    return results.agg((failed <= (0.0 if strict else tolerance)).alias("passed"))
