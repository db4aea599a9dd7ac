"""Small documents with every awkward case, as tables."""

from __future__ import annotations

import pytest
from plain import SCHEMA, TEXTS


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), "h", "k", "b", "l") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
