"""Indexes against plain search: equal results and fewer postings read, and recall of vectors in cells."""

from __future__ import annotations

import random

import numpy as np
from support import SF

from plumbline.operators import search
from plumbline.plans import windows


def test_keyword_index_skips_postings(spark):
    top, figures = windows.keyword_top(spark, SF)
    row = figures.collect()[0]
    assert top.count() > 0 and row["read"] < 0.5 * row["there"]


def test_keyword_index_equals_plain_counts(spark):
    chance = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = {i: list(dict.fromkeys(chance.choices(vocabulary, weights, k=chance.choice([0, 1, 3, 20, 60])))) for i in range(300)}
    queries = {i: list(dict.fromkeys(chance.choices(vocabulary, weights, k=chance.choice([1, 4, 30])))) for i in range(40)} | {98: [], 99: ["absent"]}
    d = spark.createDataFrame([(i, len(ws), ws) for i, ws in docs.items()], "doc_id long, tokens int, ws array<string>")
    q = spark.createDataFrame(list(queries.items()), "item_id long, ws array<string>")
    for k in (1, 5, 400):
        got = {}
        for r in search.WordIndex(d).top(q, k)[0].collect():
            got.setdefault(r["item_id"], {})[r["place"]] = (r["doc_id"], r["hits"])
        for i, ws in queries.items():
            hits = sorted(((-len(set(ws) & set(own)), n) for n, own in docs.items() if set(ws) & set(own)))[:k]
            assert got.get(i, {}) == {p: (n, -h) for p, (h, n) in enumerate(hits, 1)}


def test_recall_of_cells(spark):
    for exact, near in ((windows.vector_search, windows.vector_search_in_cells), (windows.nearest_nodes, windows.nearest_nodes_in_cells)):
        want, got = ({(r["query_id"], r["vec_id"]) for r in f(spark, SF).collect()} for f in (exact, near))
        assert len(want & got) >= 0.9 * len(want) and len(got) <= len(want)


def test_cells_of_equal_vectors_and_fewer_probes(spark, monkeypatch):
    monkeypatch.setattr(search, "PART_ROWS", 50)
    monkeypatch.setattr(search, "QUERY_BLOCK", 20)
    rng = np.random.default_rng(3)
    points = np.concatenate([np.tile(rng.normal(size=8), (400, 1)), rng.normal(size=(30, 8))[rng.integers(0, 30, 800)] * 3 + 0.1 * rng.normal(size=(800, 8))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "id long, v array<double>")
    index = search.CellIndex(df, "id", "v", cells=20)
    assert index.placed.count() == 1200 and index.parts.agg({"parts": "max"}).collect()[0][0] >= 8
    probes, recall = index.measured_probes(5, "euclid")
    assert recall >= 0.95 and probes < 20
    queries = spark.createDataFrame([(i, points[i].tolist()) for i in range(0, 1200, 12)], "k long, v array<double>")
    found = {}
    for r in index.search(queries, 5, probes, "euclid").collect():
        found.setdefault(r["query_id"], []).append(-r["score"])
    for i in range(400, 1200, 12):
        apart = np.sort(np.sqrt(((points - points[i]) ** 2).sum(1)))[1:6]
        assert len(found.get(i, [0] * 5)) == 5 and (i % 12 or np.allclose(sorted(found[i]), apart, atol=1e-5) or sorted(found[i])[0] >= apart[0] - 1e-6)
    assert max(max(v) for i, v in found.items() if i < 400) < 1e-6
