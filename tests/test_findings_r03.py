"""Cases of the third round's findings: each failed before its change."""

from __future__ import annotations

import duckdb
import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F
from support import SF, same_rows

from plumbline import catalog
from plumbline.functions import text as X
from plumbline.llm import hot, jaccard, line_dedup, toxicity
from plumbline.operators import experiments, joins, search, vectors
from plumbline.plans import analytics, streams
from plumbline.storage import materialize
from plumbline.streaming import streams as Z


def folder(spark, path, **tables):
    """A folder of tables, each of rows and their schema, and DuckDB over it."""
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS FROM '{path}/{name}.parquet/*.parquet'")
    return str(path), con


def events(n, user=lambda i: i % 50, seconds=lambda i: i * 60):
    """Events in order of time from the first of January on."""
    kinds = ("click", "view", "error")
    rows = [(i, seconds(i), user(i), kinds[i % 3], float(i % 90), f'{{"k": {i * 7 % 100}}}') for i in range(n)]
    return rows, "event_id long, s long, user_id long, event_type string, value double, props string"


def events_folder(spark, path, *args, **named):
    rows, schema = events(*args, **named)
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.expr("timestamp_ntz '2024-01-01 00:00:11' + make_dt_interval(0, 0, 0, s)"))
    df.select("event_id", "ts", "user_id", "event_type", "value", "props").coalesce(1).write.parquet(f"{path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS FROM '{path}/events.parquet/*.parquet'")
    return str(path), con


def test_words_end_at_letters_beyond_ascii(spark):
    """a word beside an accented letter is a whole word, as in the SQL."""
    df = spark.createDataFrame([("ह ñdo y",), ("ह ado y",), ("achñ kyañ",), ("kyau",)], "t string")
    own = df.select(X.language_script(F.col("t")), X.whole_word_hits(F.col("t"), ["do", "kya"]))
    assert [tuple(r) for r in own.collect()] == [("mixed", 1), ("hi", 0), ("hinglish", 1), ("en", 0)]
    masked = spark.createDataFrame([("é5551234567é",)], "t string").select(X.anonymize(F.col("t")))
    assert masked.collect()[0][0] == "é[PHONE]é"


def test_customers_of_few_orders_are_compared(spark, tmp_path):
    """neither a least number of orders nor a highest number of customers."""
    orders = [(i, i) for i in range(40)]
    lines = [(i, p) for i in range(40) for p in (i % 10, i % 10 + 1)]
    sf, con = folder(spark, tmp_path, orders=(orders, "o_orderkey long, o_custkey long"), lineitem=(lines, "l_orderkey long, l_partkey long"))
    own = catalog.queries()["co_purchase_similarity"](spark, sf)
    assert own.count() == 10 * 6
    same_rows(own, con, catalog.oracle_sql()["co_purchase_similarity"])


def test_neighbourhood_has_all_users(spark, tmp_path):
    """a user of more than a hundred others within two steps."""
    sf, con = events_folder(spark, tmp_path, 1000, user=lambda i: 8 if i % 3 == 0 else 1000 + i)
    own = catalog.queries()["neighbourhood"](spark, sf)
    assert own.count() > 100
    same_rows(own, con, catalog.oracle_sql()["neighbourhood"])


def test_batches_of_a_stream_do_not_grow(spark, tmp_path, monkeypatch):
    """More files are more files a batch, and the results are those of the SQL."""
    monkeypatch.setattr(streams, "FILE_ROWS", 100)
    sf, con = events_folder(spark, tmp_path, 2000)
    stream, path = streams.event_stream(spark, sf)
    numbers = []
    Z.run_batches(stream, path, lambda batch, number: numbers.append(number))
    assert len(numbers) <= streams.BATCHES + 1
    for name in ("stream_sessions", "stream_sliding", "stream_panes"):
        same_rows(catalog.queries()[name](spark, sf), con, catalog.oracle_sql()[name])
    out = {r["allowed"]: r["n"] for r in catalog.queries()["stream_token_bucket"](spark, sf).collect()}
    assert sum(out.values()) == 2000


def test_exact_search_keeps_ties_and_null_vectors(spark, tmp_path, monkeypatch):
    """candidates of many small tasks and blocks hold the best of all pairs, copies and nulls among them."""
    for name, value in (("PASS_QUERIES", 7), ("QUERIES_AT_ONCE", 3), ("TASK_PAIRS", 500), ("TASK_ROWS", 60), ("EXACT_PAIRS", 50)):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(4)
    points = [rng.normal(size=6).round(2).tolist() if i % 3 else [0.5] * 6 for i in range(600)]
    points[7] = None
    rows = [(i, p, i % 4) for i, p in enumerate(points)]
    sf, con = folder(spark, tmp_path, embeddings=(rows, "vec_id long, embedding array<float>, label int"))
    for name in ("vector_search", "nearest_nodes"):
        own = catalog.queries()[name](spark, sf)
        assert "BroadcastNestedLoopJoin" not in own._jdf.queryExecution().executedPlan().toString()
        same_rows(own, con, catalog.oracle_sql()[name])


def test_models_read_votes_that_were_written_once(spark, monkeypatch):
    """texts are read once, whatever passes the models make."""
    made = []
    monkeypatch.setattr(analytics, "materialize", lambda df, name: made.append(name) or materialize(df, name))
    assert analytics.label_model(spark, SF).count() == 3 and made == ["weak-votes"]


def test_a_model_is_fitted_once_a_fold_and_parameter(spark, monkeypatch):
    """the fits that choose the parameter give the figures."""
    fits, fit = [], LogisticRegression.fit
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, df: fits.append(1) or fit(self, df))
    rows = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 23 > 9).cast("int").alias("label"))
    got = experiments.cross_validated(rows, "id", ["a"], "label").collect()
    assert len(fits) == 10 and sum(r["n"] for r in got) == 400


def test_later_rows_meet_in_two_buckets(spark):
    """pairs of a later row with an earlier one need two buckets of three."""
    rows = spark.range(300).select("id", (F.col("id") % 2).alias("k"), (F.col("id") * 37 % 211).alias("at"))
    want = {(a, b) for a in range(300) for b in range(300) if a % 2 == b % 2 and 0 < b * 37 % 211 - a * 37 % 211 <= 10}
    got = joins.interval_join(rows, rows, "k", "at", "at", 10, later=True)
    assert sorted((r["a_id"], r["b_id"]) for r in got.collect()) == sorted(want)


def test_an_index_for_known_queries_keeps_their_words_only(spark):
    """postings are of words that are asked for; results and numbers of words stay."""
    docs = spark.createDataFrame([(1, 3, ["a", "b", "c"]), (2, 2, ["b", "d"]), (3, 1, ["d"])], "doc_id long, tokens int, ws array<string>")
    asked = spark.createDataFrame([(7, ["a", "b"])], "item_id long, ws array<string>")
    index = search.WordIndex(docs, asked)
    assert {r["w"] for r in index.postings.collect()} == {"a", "b"}
    assert [tuple(r) for r in index.top(asked, 5)[0].orderBy("place").select("doc_id", "tokens", "hits").collect()] == [(1, 3, 2), (2, 2, 1)]


def test_sums_of_the_same_sets_are_one_bucket(spark):
    """op13: sets that are alike share many sums, which meet in one bucket; a sum of a set alone is none."""
    nodes = spark.createDataFrame([(bytes([i]) * 16, 9) for i in range(4)], "node binary, n_shingles long")
    shorts = [r["s"] for r in nodes.select(F.xxhash64("node").alias("s")).orderBy("node").collect()]
    held = {10: (0, 1), 11: (0, 1), 12: (1, 0), 13: (0, 1, 2), 14: (2, 3), 15: (3,)}
    shared = spark.createDataFrame([(v, shorts[i]) for v, own in held.items() for i in own], "value long, short long")
    got = jaccard._buckets(shared, nodes).collect()
    assert sorted((r["value"], r["node"][0], r["n"]) for r in got) == [(10, 0, 2), (10, 1, 2), (13, 0, 3), (13, 1, 3), (13, 2, 3), (14, 2, 2), (14, 3, 2)]


def test_wide_rows_of_other_keys_are_left_before_the_shuffle(spark):
    """op13: all rows of wanted keys pass, few of others do, and nothing is shuffled but the wanted keys."""
    rows = spark.range(20000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), "id")
    got = hot.likely(rows, rows.where("id % 100 = 0").select("k"), "k")
    ids = [r["id"] for r in got.select("id").collect()]
    assert set(range(0, 20000, 100)) <= set(ids) and len(ids) < 300
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_a_window_is_compressed_once(monkeypatch):
    """op8: repeated windows of a task are remembered, and many at once give the lengths that one at a time do."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["fine", "words", "of", "ordinary", "length", "and", "more"], 60)).encode() for _ in range(40)] * 3 + [b"", b" "]
    model = {"ordinary": texts[0] + texts[1], "toxic": [texts[2], texts[3], texts[4]], "calibration": (np.zeros(7), np.ones(7), np.linspace(-1, 1, 8))}
    asked, excess = [], toxicity.Distance.excess
    monkeypatch.setattr(toxicity.Distance, "excess", lambda self, parts: asked.extend(parts) or excess(self, parts))
    monkeypatch.setattr(toxicity, "SLICE_BYTES", 4000)
    got = toxicity.Rater(model)(texts)
    assert len(asked) == len(set(asked)) and got[:40].tolist() == got[40:80].tolist() == got[80:120].tolist()
    monkeypatch.setattr(toxicity, "MANY", 1 << 30)
    assert toxicity.Rater(model)(texts).tolist() == got.tolist()


def test_keys_of_the_index_come_with_the_lines(spark, monkeypatch):
    """op6: texts are gone through once for segments, whose keys are counted where lines are named; the counts are those of all rows."""
    monkeypatch.setattr(line_dedup, "SLICE_CHARS", 300)
    made, segments = [], line_dedup.segments
    monkeypatch.setattr(line_dedup, "segments", lambda *a, **k: made.append(1) or segments(*a, **k))
    line = "a line of more than twenty characters"
    texts = [f"{line}\n{line}\nshort\n{i} {'long ' * 45}{i * i}\n{line}{'!' * (i % 3)}" for i in range(30)] + [None, "", line]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = docs.withColumn("row", F.col("doc_id"))
    want = segments(docs).where("h & 1 = 0").groupBy("k").count()
    got = line_dedup.occurrences(rows, "row", least=1).select(F.explode("ks").alias("k")).groupBy("k").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    kept = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, shortest=1).collect()}
    assert len(made) == 1 and kept[0].startswith(f"{line}\nshort\n0 long") and kept[31] == "" and line not in kept[32] and line not in kept[7]


def test_rows_of_one_line_are_one_partner():
    """op6: of many rows of a key that are one line's, one stands for all; partners are those of all pairs."""
    rng = np.random.default_rng(5)
    rows = [(int(k), int(i) << 8 | 1 << 1 | int(p), int(i) % 8) for k, i, p in zip(rng.integers(0, 90, 600), rng.integers(0, 40, 600), rng.integers(0, 2, 600), strict=True)]
    rows = sorted(rows * 3 + [(7, 99 << 8 | 2, 1 << 50 | 0xFFFFF)] * 500 + [(1000, 1 << 8 | 2, 0)])
    k, h, s = (np.array(c, np.int64) for c in zip(*rows, strict=True))

    def near(a, b):
        differ = a[2] ^ b[2]
        return a[0] == b[0] and a[1] >> 8 != b[1] >> 8 and not a[1] & b[1] & 1 and (differ >> 32).bit_count() <= 2 and (differ & 0xFFFFFFFF).bit_count() <= 4

    distinct = sorted(set(rows))
    want = [a for a in distinct if any(near(a, b) for b in distinct)]
    got = line_dedup._with_partner(k, h, s)
    assert sorted(rows[i] for i in got.tolist()) == want
    for empty in (0, 1):
        assert len(line_dedup._with_partner(k[:empty], h[:empty], s[:empty])) == 0


def test_tar_shards_are_files_not_columns(spark, tmp_path):
    """shards are streamed from files of their own; none is held in a batch of others, and equal ones count each."""
    rows = [(i % 100, None if i % 7 == 0 else "é" * (i % 100)) for i in range(300)]
    sf, con = folder(spark, tmp_path, documents=(rows, "doc_id long, text string"))
    own = catalog.queries()["tar_sharded"](spark, sf)
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan and "file" in plan
    same_rows(own, con, catalog.oracle_sql()["tar_sharded"])


def test_toxicity_trains_outside_the_driver(spark, monkeypatch):
    """The driver trains on no text and compresses none; the model is the one that training in the driver gives."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("y")).join(docs, "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("t")).withColumn("fold", toxicity.fold("doc_id")).orderBy("doc_id").collect()
    toxic, ordinary = ([r["t"].encode() for r in rows if r["fold"] > 1 and r["y"] == y] for y in (1, 0))
    content, own = toxicity.dictionaries(toxic, ordinary)
    distance = toxicity.Distance(content, own)
    x = np.array([toxicity.statistics(distance.excess(toxicity.windows(r["t"].encode()))) for r in rows if r["fold"] == 1])
    calibration = toxicity.fit_logistic(x, np.array([float(r["y"]) for r in rows if r["fold"] == 1]))

    def refused(*_):
        raise AssertionError("in the driver")

    for name in ("_trained", "compressor"):
        monkeypatch.setattr(toxicity, name, refused)
    model = toxicity.fit(docs, labels)
    assert model["ordinary"] == content and model["toxic"] == own
    assert all(np.array_equal(a, b) for a, b in zip(model["calibration"], calibration, strict=True))
