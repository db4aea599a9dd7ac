"""Comparison of a query with its SQL in DuckDB."""

from __future__ import annotations

import math
import os

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(value):
    """A value in one spelling, whichever engine gave it."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return tuple(canonical(v) for v in value)
    if isinstance(value, bool) or type(value).__name__ in ("bool_", "bool"):
        return bool(value)
    if hasattr(value, "isoformat"):
        return str(value).replace("T", " ")
    if isinstance(value, str):
        return value
    number = float(value)
    return 0.0 if number == 0 else number


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=repr)


def same_rows(df, con, sql) -> None:
    relation = con.sql(sql)
    assert sorted(df.columns) == sorted(relation.columns)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want = rows_of(relation.columns, relation.fetchall())
    assert len(got) == len(want)
    different = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not different, different[:2]
