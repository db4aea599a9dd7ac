"""Scores of the toxicity model against a plain scorer, and empty and oddly named tables."""

from __future__ import annotations

import math
import statistics as st

import pytest
import zstandard as zs
from plain import TEXTS
from support import SF

from plumbline.llm import lexicon, queries, secrets, toxicity


def plain_windows(text: bytes) -> list[bytes]:
    """Words one by one: a window is closed once it has 24 bytes, and the next begins with its last word."""
    words = []
    for word in text.split():
        pieces = [word[i : i + 24] for i in range(0, len(word), 24)]
        words += [(p, len(p) == 24 and (i < len(pieces) - 1)) for i, p in enumerate(pieces)]
    out, held = [], []
    for word, cut in words:
        held.append(word)
        if cut:
            out.append(held)
            held = []
        elif sum(map(len, held)) + len(held) >= 24:
            out.append(held)
            held = [word]
    if len(held) > 1 or not out:
        out.append(held)
    return [b" " + b" ".join(w) + b" " for w in out]


def fresh_length(content: bytes, window: bytes) -> int:
    """The compressed length by a compressor made for this window alone."""
    params = zs.ZstdCompressionParameters.from_level(3, dict_size=len(content), source_size=24, min_match=5, write_checksum=False, write_content_size=False, write_dict_id=False)
    return len(zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=params).compress(window))


def plain_score(text: str | None, model: dict) -> float:
    body = (text or "").encode()
    if not body.split():
        return 0.0
    excess = []
    for w in plain_windows(body):
        both = [fresh_length(model["ordinary"] + t, w) for t in model["toxic"]]
        excess.append(fresh_length(model["ordinary"], w) - sum(both) / len(both))
    top, n = sorted(excess, reverse=True)[:3], len(excess)
    over = sum(x > 3 for x in excess)
    x = [top[0], st.fmean(top), math.sqrt(sum(e > 1 for e in excess) / n), math.sqrt(over / n), st.fmean(excess), math.log1p(over), math.log(n)]
    mean, deviation, weights = model["calibration"]
    logit = weights[-1] + sum((a - m) / d * w for a, m, d, w in zip(x, mean, deviation, weights, strict=False))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.fit(docs, labels)


def test_scores_are_those_of_a_plain_scorer(spark, model):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = {r["doc_id"]: r["score"] for r in queries.op8_toxicity(spark, SF).collect()}
    assert set(rows) == set(texts)
    some = sorted(texts, key=lambda i: len(texts[i] or ""))[:60]  # a plain compressor for each window is slow
    for i in some:
        assert math.isclose(rows[i], plain_score(texts[i], model), rel_tol=1e-9, abs_tol=1e-12), i


def test_odd_texts_score_as_plainly(spark, docs, model):
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for i, text in enumerate(TEXTS):
        if len(text or "") < 3000:
            assert math.isclose(got[i], plain_score(text, model), rel_tol=1e-9, abs_tol=1e-12)


def test_windows_are_the_plain_ones():
    for text in TEXTS:
        assert toxicity.windows((text or "").encode()) == plain_windows((text or "").encode())


def test_empty_tables(spark, empty, model):
    assert toxicity.score(empty, model).collect() == [] and toxicity.keep_below(empty, model, 0.5).collect() == []
    assert toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int")) is None
    assert secrets.scan(empty).collect() == [] and secrets.redact(empty).collect() == []
    path = queries.tokenizer_path(queries.BYTE_BPE)
    shipped = lexicon.ship_lexicon(spark, lexicon.frequent_words(empty), path)
    assert lexicon.encode(empty, path, shipped).collect() == []
