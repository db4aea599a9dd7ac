"""Helpers for tables whose columns are not known beforehand."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def col_or(df: DataFrame, name: str, default: Any) -> Column:
    """The column, or the default where the table has none or the row a null."""
    if name not in df.columns:
        return F.lit(default)
    return F.col(name) if default is None else F.coalesce(F.col(name), F.lit(default))


def first_present(df: DataFrame, names: list[str]) -> Column:
    """The first of the columns that the table has."""
    for name in names:
        if name in df.columns:
            return F.col(name)
    raise ValueError(f"none of the columns {names} is there")


def wanted(df: DataFrame, names: list[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def prefixed(df: DataFrame, names: list[str], prefix: str) -> DataFrame:
    return df.withColumnsRenamed({n: prefix + n for n in names})


def drop_null_keys(df: DataFrame, *names: str) -> DataFrame:
    return df.na.drop(subset=list(names))
