"""The pipeline's stages on rows that a narrower job would miss."""

from __future__ import annotations

from plain import SCHEMA, components, shingle_set

import corpus_pipeline


def table(spark, rows):
    """``documents`` of ``(doc_id, text)`` rows."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "h", "k", "b", "l") for i, t in rows], SCHEMA).repartition(3)


def linked_from(percent, texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both)

    return components(sorted(texts), linked)


def test_near_stage_links_from_80(spark):
    """Pairs whose tails differ in n shingles of 200: a Jaccard of 0.83 at 18, 0.80 at 22, below 0.80 from 23 on."""
    texts = {}
    for n in (10, 18, 19, 20, 21, 22, 23, 24, 30):
        words = [f"w{n}.{i}" for i in range(204)]
        texts |= {2 * n: " ".join(words), 2 * n + 1: " ".join(words[: 204 - n] + [f"x{n}.{i}" for i in range(n)])}
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, table(spark, texts.items()), "").collect()}
    assert got == {i for i, c in linked_from(80, texts).items() if i == c}
    assert set(texts) - got == {2 * n + 1 for n in (10, 18, 19, 20, 21, 22)}


def test_short_lines_go(spark):
    """Exact copies of a line of any length go; near copies are joined from 20 characters on; blank lines stay."""
    texts = {0: "Yes\n\n}\nshort line", 1: " Yes\n\n}\nshort line", 2: "short lime\n}\nYes", 3: "a line of more than 20 letters", 4: "a line of more than 20 lettres?\nYes"}
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, table(spark, texts.items()), "").collect()}
    assert got == {0: texts[0], 1: "", 2: "short lime", 3: texts[3], 4: "a line of more than 20 lettres?"}


def test_null_and_repeated_keys(spark):
    """Documents without a key stay, one of repeated rows stays, and rows of one key lose only their own lines."""
    a, b, c = ("\n".join(f"{x} has line {i} of its own" + "." * i for i in range(8)) for x in ("alpha", "the second", "some other text"))
    rows = [(None, a), (None, b), (7, c), (7, c), (None, None), (None, None), (8, "one two three\n" + c)]
    near = corpus_pipeline.drop_near_duplicates(spark, table(spark, rows), "").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in near), key=repr) == sorted([*rows[:3], *rows[4:6]], key=repr)

    rows = [(3, "first of all the lines\nsomething quite different"), (5, "words that are only here\nlast one of them all"), (5, "zebras run on the plain\nsomething quite different"), (None, None), (9, "zz"), (9, "zz")]
    lines = corpus_pipeline.drop_repeated_lines(spark, table(spark, rows), "").collect()
    want = [rows[0], rows[1], (5, "zebras run on the plain"), rows[3], (9, "zz"), (9, "")]
    assert sorted(((r["doc_id"], r["text"]) for r in lines), key=repr) == sorted(want, key=repr)
