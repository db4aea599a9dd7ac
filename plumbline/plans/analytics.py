"""Composite analytics: weak labels, validation, metrics, calibration, fairness, tests, drift and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import stats
from plumbline.operators.labels import points, standard_functions, weak_label
from plumbline.plans.base import SOCIAL, social
from plumbline.registry import query, table
from plumbline.storage import materialize

#: Words of action and of hedging.
ACTION = [
    "boycott", "petition", "fired", "fire", "resign", "resignation", "apologize", "apology", "cancel", "cancelled", "cancelling",
    "remove", "ban", "suspend", "deplatform", "call out", "hold accountable", "step down", "drop", "cut ties",
]
HEDGE = ["i think", "in my opinion", "imo", "personally", "maybe", "perhaps", "could be", "might be"]
_HITS, _HEDGES = (" + ".join(f"contains(low, '{p}')::INT" for p in ws) for ws in (ACTION, HEDGE))
_VOTE = "CASE WHEN {0} THEN 1 WHEN {1} THEN 0 ELSE -1 END"
_VOTES = {
    "lf_engagement": (2.0, "n_chars > 500", "n_chars < 20"),
    "lf_sentiment": (1.5, "sentiment < -0.4", "sentiment > 0.2"),
    "lf_toxicity": (1.5, "toxicity > 0.6 OR severe > 0.5", "toxicity < 0.2 AND severe < 0.1"),
    "lf_action": (3.0, "actions >= 2 AND hedges = 0", "actions = 0 AND hedges >= 2"),
    "lf_communities": (1.0, "doc_id % 5 >= 3", "doc_id % 5 = 0"),
    "lf_comments": (2.0, "n_lines > 50", "n_lines < 5"),
    "lf_persistence": (1.0, "doc_id % 7 >= 3", "doc_id % 7 = 0"),
}
_WEAK = f"""
d AS (SELECT d.doc_id, n_chars, CASE WHEN toxic = 1 THEN -1.0 WHEN quality = 1 AND toxic = 0 THEN 1.0 ELSE 0.0 END AS sentiment, CASE WHEN toxic = 1 AND quality = 1 THEN 0.5 WHEN toxic = 1 THEN 1.0 WHEN toxic = 0 THEN 0.15 ELSE 0.3 END AS toxicity,
  CASE WHEN d.doc_id % 13 = 0 THEN 0.6 WHEN d.doc_id % 13 = 1 THEN 0.1 ELSE 0.0 END AS severe, len(regexp_extract_all(coalesce(text, ''), '\\n')) + 1 AS n_lines,
  lower(coalesce(text, '') || CASE d.doc_id % 8 WHEN 0 THEN ' Boycott them, cut ties!' WHEN 1 THEN ' Imo it might be so' WHEN 2 THEN ' Maybe a petition' ELSE '' END) AS low FROM documents d LEFT JOIN labels USING (doc_id)),
h AS (SELECT *, {_HITS} AS actions, {_HEDGES} AS hedges FROM d),
v AS (SELECT doc_id, {", ".join(f"{_VOTE.format(p, n)} AS {k}" for k, (_, p, n) in _VOTES.items())} FROM h),
s AS (SELECT *, {" + ".join(f"CASE WHEN {k} = 1 THEN {w}::DOUBLE ELSE 0 END" for k, (w, _, _) in _VOTES.items())} AS w_pos, {" + ".join(f"CASE WHEN {k} = 0 THEN {w}::DOUBLE ELSE 0 END" for k, (w, _, _) in _VOTES.items())} AS w_neg FROM v),
weak AS (SELECT *, CASE WHEN w_pos > w_neg THEN 1 WHEN w_neg > w_pos THEN 0 ELSE -1 END AS weak_label, abs(w_pos - w_neg) / 12.0::DOUBLE AS confidence FROM s)
"""


def weak_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    more = F.when(F.col("doc_id") % 8 == 0, " Boycott them, cut ties!").when(F.col("doc_id") % 8 == 1, " Imo it might be so").when(F.col("doc_id") % 8 == 2, " Maybe a petition").otherwise("")
    low = F.concat(X.whole(F.col("text")), more)
    rows = docs.select(
        "doc_id",
        F.col("n_chars").alias("engagement"),
        F.when(F.col("toxic") == 1, -1.0).when((F.col("quality") == 1) & (F.col("toxic") == 0), 1.0).otherwise(0.0).alias("sentiment"),
        F.when((F.col("toxic") == 1) & (F.col("quality") == 1), 0.5).when(F.col("toxic") == 1, 1.0).when(F.col("toxic") == 0, 0.15).otherwise(0.3).alias("toxicity"),
        F.when(F.col("doc_id") % 13 == 0, 0.6).when(F.col("doc_id") % 13 == 1, 0.1).otherwise(0.0).alias("severe"),
        (F.regexp_count(X.whole(F.col("text")), F.lit("\n")) + 1).alias("comments"),
        (F.col("doc_id") % 5).alias("communities"),
        (F.col("doc_id") % 7).alias("days"),
        X.distinct_hits(low, ACTION).alias("actions"),
        X.distinct_hits(low, HEDGE).alias("hedges"),
    )
    names = {n: n for n in ("engagement", "sentiment", "toxicity", "severe", "comments", "communities", "days", "actions", "hedges")}
    return weak_label(rows, standard_functions(**names))


@query(
    "C02 C03 A20 A21 A10",
    f"""WITH {_WEAK} SELECT weak_label, count(*) AS n, round(avg(confidence), 9) AS confidence, round(sum(w_pos), 2) AS w_pos, round(sum(w_neg), 2) AS w_neg FROM weak GROUP BY weak_label""",
)
def weak_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: seven votes a document, their weighted majority, counted by label."""
    return weak_documents(spark, sf_dir).groupBy("weak_label").agg(
        F.count("*").alias("n"), F.round(F.avg("confidence"), 9).alias("confidence"), F.round(F.sum("w_pos"), 2).alias("w_pos"), F.round(F.sum("w_neg"), 2).alias("w_neg")
    )


@query(
    "C03 F13",
    f"""WITH {_WEAK} SELECT doc_id, {", ".join(_VOTES)}, weak_label, round(confidence, 9) AS confidence, w_pos > 0 AND w_neg > 0 AS conflict, confidence < 0.3 AS unsure FROM weak""",
)
def weak_votes_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = weak_documents(spark, sf_dir)
    return out.select("doc_id", *_VOTES, "weak_label", F.round("confidence", 9).alias("confidence"), ((F.col("w_pos") > 0) & (F.col("w_neg") > 0)).alias("conflict"), (F.col("confidence") < 0.3).alias("unsure"))


#: Words and thresholds of the cancellation heuristic, whose points add up.
CANCEL_WORDS = [
    "cancel", "cancelled", "canceled", "boycott", "petition", "fired", "apologized", "apology", "resigned", "stepped down",
    "backlash", "outrage", "controversy", "damning", "exposed", "hold accountable", "trending for wrong", " ratio ",
]
NEGATIVE_WORDS = ["hate", "disgusting", "terrible", "awful", "shame", "disgrace"]
CANCEL_PARTS = {
    "high_engagement": ("score > 1000", 1), "viral_engagement": ("score > 5000", 1), "reply_storm": ("comments > 500", 1), "viral_comments": ("comments > 2000", 1),
    "ratio_collapse": ("ratio < 0.5", 1), "severe_ratio_collapse": ("ratio < 0.3", 1), "negative_tone": ("negative >= 3", 1), "official_response": ("official", 1),
}
_CANCEL_ROWS = """SELECT doc_id, n_chars AS score, doc_id * 31 % 2500 AS comments, doc_id * 37 % 100 / 100.0::DOUBLE AS ratio, doc_id % 11 = 0 AS official,
  lower(coalesce(text, '') || CASE doc_id % 4 WHEN 0 THEN ' Boycott! He was fired' WHEN 1 THEN ' a terrible, awful shame' ELSE '' END) AS low FROM documents"""


@query(
    "C01 G04",
    f"""WITH d AS ({_CANCEL_ROWS}), p AS (SELECT *, least(2 * len(regexp_extract_all(low, '\\b({"|".join(CANCEL_WORDS)})\\b')), 4) AS words, {" + ".join(f"contains(low, '{w}')::INT" for w in NEGATIVE_WORDS)} AS negative FROM d)
SELECT doc_id, ({" + ".join(f"({c})::INT * {n}" for c, n in CANCEL_PARTS.values())} + words)::INT AS total, {" + ".join(f"({c})::INT * {n}" for c, n in CANCEL_PARTS.values())} + words >= 3 AS label, words::INT AS cancel_keywords, negative >= 3 AS negative_tone FROM p""",
)
def cancellation_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten components of points over engagement, replies, words, ratio, tone and who answers; labelled from three points on."""
    i = F.col("doc_id")
    more = F.when(i % 4 == 0, " Boycott! He was fired").when(i % 4 == 1, " a terrible, awful shame").otherwise("")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("n_chars").alias("score"), (i * 31 % 2500).alias("comments"), (i * 37 % 100 / 100).alias("ratio"), (i % 11 == 0).alias("official"),
        F.lower(F.concat(X.whole(F.col("text")), more)).alias("low"),
    )
    rows = rows.withColumns({"words": F.least(2 * X.whole_word_hits(F.col("low"), CANCEL_WORDS), F.lit(4)), "negative": X.distinct_hits(F.col("low"), NEGATIVE_WORDS)})
    total = points(*((F.expr(c), n) for c, n in CANCEL_PARTS.values())) + F.col("words")
    return rows.select("doc_id", total.cast("int").alias("total"), (total >= 3).alias("label"), F.col("words").cast("int").alias("cancel_keywords"), (F.col("negative") >= 3).alias("negative_tone"))


#: Words of consequences and of controversy.
ACTION_WORDS = ["boycott", "petition", "fired", "removed", "banned", "apologized", "resigned", "stepped down", "under investigation"]
CONTROVERSY_WORDS = ["cancel", "backlash", "outrage", "controversy", "under fire", "facing criticism", "under pressure"]
_PROXY_ROWS = """posts AS (SELECT doc_id, n_chars AS likes, doc_id * 31 % 2500 AS replies, (doc_id * 7 % 100 - 50) / 50.0::DOUBLE AS sentiment, doc_id % 10 = 0 AS verified,
  lower(coalesce(text, '') || CASE doc_id % 9 WHEN 0 THEN ' a petition to have them removed' WHEN 1 THEN ' and the backlash' ELSE '' END) AS low FROM documents)"""


@query(
    "C06 A15",
    f"""WITH {_PROXY_ROWS}, q AS (SELECT quantile_cont(likes, 0.9) AS q90, quantile_cont(replies / (likes + 1), 0.95) AS q95 FROM posts),
s AS (SELECT doc_id, ((likes > q90 AND q90 > 0)::INT + (sentiment < -0.3)::INT + 2 * ({" OR ".join(f"contains(low, '{w}')" for w in ACTION_WORDS)})::INT + ({" OR ".join(f"contains(low, '{w}')" for w in CONTROVERSY_WORDS)})::INT
  + (replies / (likes + 1) > q95 AND q95 > 0)::INT + (verified AND sentiment < -0.2)::INT)::INT AS points FROM posts, q)
SELECT doc_id, points, (points >= 3)::INT AS label FROM s""",
)
def proxy_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points over likes, sentiment, words of consequences and of controversy in whole texts, replies and reach; 1 from three points on."""
    c, i = F.col, F.col("doc_id")
    more = F.when(i % 9 == 0, " a petition to have them removed").when(i % 9 == 1, " and the backlash").otherwise("")
    p = table(spark, sf_dir, "documents").select(
        "doc_id", c("n_chars").alias("likes"), (i * 31 % 2500).alias("replies"), ((i * 7 % 100 - 50) / 50.0).alias("sentiment"), (i % 10 == 0).alias("verified"), F.lower(F.concat(X.whole(c("text")), more)).alias("low")
    )
    p = p.select("doc_id", "likes", (c("replies") / (c("likes") + 1)).alias("ratio"), "sentiment", "verified", *(X.contains_any(c("low"), ws).alias(n) for n, ws in (("action", ACTION_WORDS), ("controversy", CONTROVERSY_WORDS))))
    likes, ratios = stats.quantiles(p, "likes", [0.9]), stats.quantiles(p, "ratio", [0.95])
    cuts = likes.select(F.get("q", F.lit(0)).alias("q90")).crossJoin(ratios.select(F.get("q", F.lit(0)).alias("q95")))
    total = points(
        ((c("likes") > c("q90")) & (c("q90") > 0), 1), (c("sentiment") < -0.3, 1), (c("action"), 2), (c("controversy"), 1), ((c("ratio") > c("q95")) & (c("q95") > 0), 1), (c("verified") & (c("sentiment") < -0.2), 1)
    )
    out = p.crossJoin(F.broadcast(cuts)).select("doc_id", total.cast("int").alias("points"))
    return out.withColumn("label", (F.col("points") >= 3).cast("int"))


#: Placeholder lexicons with the weights of a distinct hit in score and category, and placeholder patterns with that of a match;
#: the weights are fixed values.
LEXICON = {"severe": (["scum", "worthless"], 0.25, 0.3), "strong": (["idiot", "moron"], 0.12, 0.15), "mild": (["stupid", "trash"], 0.05, 0.0)}
PATTERNS = {"hate": ("all of (?:them|those) are|go back to where", 0.3), "threat": ("(?:will|going to) (?:hurt|find) you|watch your back", 0.4), "harassment": ("send (?:me )?(?:nudes|pics)", 0.35)}
_TOXIC_TEXT = "coalesce(text, '') || CASE doc_id % 6 WHEN 0 THEN ' You moron, I will find you!!!!' WHEN 1 THEN ' ALL OF THEM ARE SCUM' WHEN 2 THEN ' send me pics' ELSE '' END"
_HIT = {n: "(" + " + ".join(f"contains(low, '{w}')::INT" for w in ws) + ")" for n, (ws, _, _) in LEXICON.items()}
_MATCH = {n: f"len(regexp_extract_all(low, '{p}'))" for n, (p, _) in PATTERNS.items()}


@query(
    "C09 X22",
    f"""WITH t AS (SELECT doc_id, {_TOXIC_TEXT} AS t FROM documents), l AS (SELECT *, lower(t) AS low, list_filter(string_split(trim(regexp_replace(lower(t), '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS ws FROM t),
h AS (SELECT doc_id, {", ".join(f"{c} AS {n}" for n, c in (_HIT | _MATCH).items())}, len(regexp_extract_all(t, '[A-Z]')) / greatest(length(t), 1)::DOUBLE AS caps, len(regexp_extract_all(t, '!')) AS marks, len(ws) AS n, len(list_distinct(ws)) AS u FROM l)
SELECT doc_id, round(least({" + ".join(f"{n} * {w}::DOUBLE" for n, (_, w, _) in LEXICON.items())} + {" + ".join(f"{n} * {w}::DOUBLE" for n, (_, w) in PATTERNS.items())} + CASE WHEN caps > 0.3 THEN 0.1 ELSE 0 END
  + CASE WHEN marks > 3 THEN 0.05::DOUBLE * least(marks, 10) ELSE 0 END + CASE WHEN n > 5 AND u / n::DOUBLE < 0.5 THEN 0.1 ELSE 0 END, 1.0), 6) AS toxicity,
  round(least(0.5::DOUBLE + 0.1::DOUBLE * (severe + strong + (hate > 0)::INT + (threat > 0)::INT), 0.95), 6) AS confidence, round(least({" + ".join(f"{n} * {c}::DOUBLE" for n, (_, _, c) in LEXICON.items())}, 1.0), 6) AS profanity,
  {", ".join(f"round(least({n} * {w}::DOUBLE, 1.0), 6) AS {n}" for n, (_, w) in PATTERNS.items())} FROM h""",
)
def rule_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity-weighted words, patterns by category, capitals, exclamations and repetition; with categories and confidence."""
    i = F.col("doc_id")
    more = F.when(i % 6 == 0, " You moron, I will find you!!!!").when(i % 6 == 1, " ALL OF THEM ARE SCUM").when(i % 6 == 2, " send me pics").otherwise("")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(X.whole(F.col("text")), more).alias("t"))
    t, own = F.col("t"), X.words(F.lower("t"))
    hits = {n: X.distinct_hits(t, ws) for n, (ws, _, _) in LEXICON.items()} | {n: F.regexp_count(F.lower(t), F.lit(p)) for n, (p, _) in PATTERNS.items()}
    rows = rows.select("doc_id", *(c.alias(n) for n, c in hits.items()), X.caps_ratio(t).alias("caps"), F.regexp_count(t, F.lit("!")).alias("marks"), F.size(own).alias("n"), F.size(F.array_distinct(own)).alias("u"))
    weights = {n: w for n, (_, w, _) in LEXICON.items()} | {n: w for n, (_, w) in PATTERNS.items()}
    score = sum((F.col(n) * F.lit(w) for n, w in weights.items()), F.lit(0.0))
    score = score + F.when(F.col("caps") > 0.3, 0.1).otherwise(0.0) + F.when(F.col("marks") > 3, F.lit(0.05) * F.least("marks", F.lit(10))).otherwise(0.0)
    score = score + F.when((F.col("n") > 5) & (F.col("u") / F.col("n") < 0.5), 0.1).otherwise(0.0)
    signals = F.col("severe") + F.col("strong") + (F.col("hate") > 0).cast("int") + (F.col("threat") > 0).cast("int")
    profanity = sum((F.col(n) * F.lit(c) for n, (_, _, c) in LEXICON.items()), F.lit(0.0))
    capped = {"toxicity": score, "profanity": profanity} | {n: F.col(n) * F.lit(w) for n, (_, w) in PATTERNS.items()}
    return rows.select("doc_id", *(F.round(F.least(c, F.lit(1.0)), 6).alias(n) for n, c in capped.items()), F.round(F.least(0.5 + F.lit(0.1) * signals, F.lit(0.95)), 6).alias("confidence"))


@query(
    "C12 A28 A29 A31 D06 U08",
    """WITH a AS (SELECT count(*) AS n, count(*) FILTER (text IS NULL) AS nulls, count(*) - count(DISTINCT doc_id) AS dup_ids, count(*) - count(DISTINCT text) AS dup_texts, avg((length(coalesce(text, '')) < 10)::INT) AS short,
  avg((n_chars <> length(coalesce(text, '')))::INT) AS wrong_length, count(DISTINCT lang) AS langs, avg(regexp_matches(coalesce(text, ''), '[^\\x00-\\x7F]')::INT) AS non_ascii FROM documents)
SELECT 'rows' AS check_name, n >= 100 AS passed, n::DOUBLE AS value FROM a UNION ALL SELECT 'nulls', nulls = 0, nulls FROM a UNION ALL SELECT 'unique_ids', dup_ids = 0, dup_ids FROM a UNION ALL SELECT 'duplicates', dup_texts <= 0.2 * n, dup_texts FROM a
UNION ALL SELECT 'short_texts', short <= 0.05, round(short, 9) FROM a UNION ALL SELECT 'length', wrong_length = 0, round(wrong_length, 9) FROM a UNION ALL SELECT 'languages', langs BETWEEN 1 AND 20, langs FROM a UNION ALL SELECT 'non_ascii', non_ascii <= 0.9, round(non_ascii, 9) FROM a""",
)
def validation_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.operators.validate import validate

    body = F.coalesce("text", F.lit(""))
    return validate(
        table(spark, sf_dir, "documents"),
        {
            "n": F.count("*"),
            "nulls": F.count_if(F.col("text").isNull()),
            "dup_ids": F.count("*") - F.countDistinct("doc_id"),
            "dup_texts": F.count("*") - F.countDistinct(F.sha2(F.col("text").cast("binary"), 256)),
            "short": F.avg((F.length(body) < 10).cast("int")),
            "wrong_length": F.avg((F.col("n_chars") != F.length(body)).cast("int")),
            "langs": F.countDistinct("lang"),
            "non_ascii": F.avg(body.rlike(r"[^\x00-\x7F]").cast("int")),
        },
        {
            "rows": ("n", "n >= 100"),
            "nulls": ("nulls", "nulls = 0"),
            "unique_ids": ("dup_ids", "dup_ids = 0"),
            "duplicates": ("dup_texts", "dup_texts <= 0.2 * n"),
            "short_texts": ("short", "short <= 0.05"),
            "length": ("wrong_length", "wrong_length = 0"),
            "languages": ("langs", "langs BETWEEN 1 AND 20"),
            "non_ascii": ("non_ascii", "non_ascii <= 0.9"),
        },
    )


_PRED = f"""{SOCIAL}, pred AS (SELECT post_id, community, round(least(greatest(0.5 + sentiment / 2 + (score - 50) / 1000, 0), 1), 5) AS p, (k * 13 % 100 < k)::INT AS y FROM social)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probability and a label for each post."""
    p = F.round(F.least(F.greatest(0.5 + F.col("sentiment") / 2 + (F.col("score") - 50) / 1000, F.lit(0.0)), F.lit(1.0)), 5)
    return social(spark, sf_dir).select("post_id", "community", p.alias("p"), (F.col("k") * 13 % 100 < F.col("k")).cast("int").alias("y"))


@query(
    "C20 C23 A26",
    f"""WITH {_PRED}, c AS (SELECT count(*) FILTER (p >= 0.5 AND y = 1)::DOUBLE AS tp, count(*) FILTER (p >= 0.5 AND y = 0)::DOUBLE AS fp, count(*) FILTER (p < 0.5 AND y = 1)::DOUBLE AS fn, count(*) FILTER (p < 0.5 AND y = 0)::DOUBLE AS tn,
  avg(-(y * ln(greatest(p, 1e-10)) + (1 - y) * ln(greatest(1 - p, 1e-10)))) AS ll, avg((p - y) * (p - y)) AS brier, avg(abs(p - y)) AS mae FROM pred), f AS (SELECT *, tp + fp + fn + tn AS n, 2 * tp / (2 * tp + fp + fn) AS f1, 2 * tn / (2 * tn + fp + fn) AS f0 FROM c)
SELECT round((tp + tn) / n, 9) AS accuracy, round(tp / (tp + fp), 9) AS "precision", round(tp / (tp + fn), 9) AS recall, round(f1, 9) AS f1, round((f1 + f0) / 2, 9) AS f1_macro, round((f1 * (tp + fn) + f0 * (tn + fp)) / n, 9) AS f1_weighted,
  round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 9) AS mcc, round(((tp + tn) / n - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)) / (1 - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)), 9) AS kappa,
  round(ll, 9) AS log_loss, round(brier, 9) AS brier, round(sqrt(brier), 9) AS rmse, round(mae, 9) AS mae FROM f""",
)
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, y = F.col("p"), F.col("y")
    rows = predictions(spark, sf_dir).withColumn("hit", (p >= 0.5).cast("int"))
    loss = -(y * F.log(F.greatest(p, F.lit(1e-10))) + (1 - y) * F.log(F.greatest(1 - p, F.lit(1e-10))))
    own = rows.agg(*stats.confusion("y", "hit"), F.avg(loss).alias("log_loss"), F.avg((p - y) * (p - y)).alias("brier"), F.avg(F.abs(p - y)).alias("mae"))
    metrics = stats.classification(*map(F.col, ("tp", "fp", "fn", "tn"))) | {"log_loss": F.col("log_loss"), "brier": F.col("brier"), "rmse": F.sqrt("brier"), "mae": F.col("mae")}
    return own.select(*(F.round(c, 9).alias(n) for n, c in metrics.items()))


@query(
    "C21",
    f"""WITH {_PRED}, t AS (SELECT unnest([0.3, 0.7, 0.9])::DOUBLE AS threshold UNION SELECT round(0.05 + i * 0.05, 2)::DOUBLE FROM range(1, 19) r(i))
SELECT threshold, round(count(*) FILTER (p >= threshold AND y = 1) / greatest(count(*) FILTER (p >= threshold), 1)::DOUBLE, 9) AS "precision", round(count(*) FILTER (p >= threshold AND y = 1) / (count(*) FILTER (y = 1))::DOUBLE, 9) AS recall,
  round(2 * count(*) FILTER (p >= threshold AND y = 1) / (count(*) FILTER (p >= threshold) + count(*) FILTER (y = 1))::DOUBLE, 9) AS f1 FROM pred, t GROUP BY threshold""",
)
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All thresholds from 0.1 to 0.95 in one pass over the rows, as an array of sums."""
    cuts = [round(0.1 + 0.05 * i, 2) for i in range(18)]
    rows = predictions(spark, sf_dir)
    sums = [c for t in cuts for c in (F.count_if(F.col("p") >= t), F.count_if((F.col("p") >= t) & (F.col("y") == 1)))]
    own = rows.agg(F.array(*sums).alias("s"), F.count_if(F.col("y") == 1).alias("pos"))
    out = F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.get("s", F.lit(2 * i)).alias("hit"), F.get("s", F.lit(2 * i + 1)).alias("tp")) for i, t in enumerate(cuts))))
    own = own.select(out.alias("o"), "pos")
    return own.select("o.threshold", F.round(F.col("o.tp") / F.greatest("o.hit", F.lit(1)), 9).alias("precision"), F.round(F.col("o.tp") / F.col("pos"), 9).alias("recall"), F.round(2 * F.col("o.tp") / (F.col("o.hit") + F.col("pos")), 9).alias("f1"))


@query(
    "C40",
    f"""WITH {_PRED}, m AS (SELECT p AS m1, round(least(greatest(0.9 - p / 2 + (post_id % 7) / 20.0::DOUBLE, 0), 1), 5) AS m2, (post_id % 10) / 10.0::DOUBLE AS m3, y FROM pred),
g AS (SELECT a.i AS a, b.i AS b, 10 - a.i - b.i AS c FROM range(11) a(i), range(11) b(i) WHERE a.i + b.i <= 10),
f AS (SELECT a, b, c, count(*) FILTER (hit AND y = 1) AS tp, count(*) FILTER (hit AND y = 0) AS fp, count(*) FILTER (NOT hit AND y = 1) AS fn FROM (SELECT g.*, y, round((a * m1 + b * m2 + c * m3) / 10, 9) >= 0.5 AS hit FROM m, g) GROUP BY ALL)
SELECT a / 10.0::DOUBLE AS w1, b / 10.0::DOUBLE AS w2, c / 10.0::DOUBLE AS w3, round(2 * tp / greatest(2 * tp + fp + fn, 1)::DOUBLE, 9) AS f1 FROM f ORDER BY f1 DESC, a, b LIMIT 1""",
)
def ensemble_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of three models, in tenths, with the best F1: all 66 combinations in one pass over the rows."""
    p, i = F.col("p"), F.col("post_id")
    other = F.round(F.least(F.greatest(0.9 - p / 2 + i % 7 / 20, F.lit(0.0)), F.lit(1.0)), 5)
    rows = predictions(spark, sf_dir).select(p.alias("m1"), other.alias("m2"), (i % 10 / 10).alias("m3"), "y")
    grid = [(a, b, 10 - a - b) for a in range(11) for b in range(11 - a)]
    hits = [F.round((a * F.col("m1") + b * F.col("m2") + c * F.col("m3")) / 10, 9) >= 0.5 for a, b, c in grid]
    sums = rows.agg(*(F.count_if(h & (F.col("y") == y)).alias(f"h{y}_{n}") for n, h in enumerate(hits) for y in (0, 1)), F.count_if(F.col("y") == 1).alias("pos"))
    f1 = [stats.ratio(F.lit(2) * F.col(f"h1_{n}"), F.col(f"h1_{n}") + F.col(f"h0_{n}") + F.col("pos")) for n in range(len(grid))]
    found = [F.struct(F.round(x, 9).alias("f1"), F.lit(-a).alias("a"), F.lit(-b).alias("b")) for x, (a, b, _) in zip(f1, grid, strict=True)]
    best = sums.select(F.array_max(F.array(*found)).alias("x"))
    a, b = -F.col("x.a"), -F.col("x.b")
    return best.select((a / 10).alias("w1"), (b / 10).alias("w2"), ((10 - a - b) / 10).alias("w3"), "x.f1")


@query(
    "C22 C24",
    f"""WITH {_PRED}, v AS (SELECT p, sum(y) AS pos, count(*) - sum(y) AS neg FROM pred GROUP BY p), r AS (SELECT *, sum(neg) OVER (ORDER BY p) - neg AS nb, sum(pos) OVER (ORDER BY p DESC) AS pa, sum(neg) OVER (ORDER BY p DESC) AS na FROM v)
SELECT round(sum(pos * (nb + neg / 2)) / (sum(pos) * sum(neg)), 9) AS auc, round(sum(pa / (pa + na) * pos) / sum(pos), 9) AS ap, (SELECT round(avg(y), 9) FROM (SELECT y FROM pred ORDER BY p DESC, post_id LIMIT 100)) AS precision_at_100 FROM r""",
)
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir)
    top = rows.orderBy(F.desc("p"), "post_id").limit(100).agg(F.round(F.avg("y"), 9).alias("precision_at_100"))
    out = stats.roc_auc(rows, "p", "y").crossJoin(stats.average_precision(rows, "p", "y")).crossJoin(top)
    return out.select(F.round("auc", 9).alias("auc"), F.round("ap", 9).alias("ap"), "precision_at_100")


@query(
    "C18",
    f"""WITH {_PRED}, b AS (SELECT ceil(round(p * 10, 9)) AS bin, count(*) AS n, abs(avg(y) - avg(p)) AS gap FROM pred WHERE p > 0 GROUP BY 1) SELECT round(sum(gap * n) / (SELECT count(*) FROM pred), 9) AS ece, round(max(gap), 9) AS mce FROM b""",
)
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.calibration_error(predictions(spark, sf_dir), "p", "y").select(F.round("ece", 9).alias("ece"), F.round("mce", 9).alias("mce"))


@query(
    "C25",
    f"""WITH {_PRED} SELECT least(floor(round(p * 20, 9)), 19)::INT AS bin, count(*) AS n, round(avg(p), 9) AS predicted, round(avg(y), 9) AS observed FROM pred GROUP BY 1""",
)
def calibration_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean probability and the share of label 1 in each of twenty even bins."""
    bin_ = F.least(F.floor(F.round(F.col("p") * 20, 9)), F.lit(19)).cast("int")
    return predictions(spark, sf_dir).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 9).alias("predicted"), F.round(F.avg("y"), 9).alias("observed"))


@query(
    "C13 C14 C15 C16",
    f"""WITH {_PRED}, b AS (SELECT community, least(floor(round(p * 10, 9)), 9) AS bin, count(*) AS n, abs(avg(y) - avg(p)) AS gap FROM pred GROUP BY ALL), e AS (SELECT community, CASE WHEN sum(n) >= 20 THEN sum(gap * n) / sum(n) END AS ece FROM b GROUP BY community),
g AS (SELECT community, avg((p >= 0.5)::INT) AS rate, count(*) FILTER (p >= 0.5 AND y = 1) / (count(*) FILTER (y = 1))::DOUBLE AS tpr, count(*) FILTER (p >= 0.5 AND y = 0) / (count(*) FILTER (y = 0))::DOUBLE AS fpr FROM pred GROUP BY community)
SELECT community, round(rate, 9) AS rate, round(tpr, 9) AS tpr, round(fpr, 9) AS fpr, round(ece, 9) AS ece, round(max(rate) OVER () - min(rate) OVER (), 9) AS disparity, round(min(rate) OVER () / max(rate) OVER (), 9) AS impact, min(rate) OVER () / max(rate) OVER () < 0.8 AS flagged FROM g JOIN e USING (community)""",
)
def fairness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates, odds and calibration by group in one pass; groups of fewer rows than twice the bins have no calibration error. The extremes over groups are one row."""
    p, y = F.col("p"), F.col("y")
    bins = predictions(spark, sf_dir).groupBy("community", F.least(F.floor(F.round(p * 10, 9)), F.lit(9)).alias("bin")).agg(
        F.count("*").alias("n"), F.sum(y).alias("sy"), F.sum(p).alias("sp"), F.count_if(p >= 0.5).alias("hit"), F.count_if((p >= 0.5) & (y == 1)).alias("tp")
    )
    g = bins.groupBy("community").agg(
        (F.sum("hit") / F.sum("n")).alias("rate"), stats.ratio(F.sum("tp"), F.sum("sy")).alias("tpr"), stats.ratio(F.sum("hit") - F.sum("tp"), F.sum("n") - F.sum("sy")).alias("fpr"),
        F.when(F.sum("n") >= 20, F.sum(F.abs(F.col("sy") - F.col("sp"))) / F.sum("n")).alias("ece"),
    )
    ends = g.agg(F.min("rate").alias("lo"), F.max("rate").alias("hi"))
    out = g.crossJoin(F.broadcast(ends))
    impact = F.col("lo") / F.col("hi")
    return out.select("community", *(F.round(c, 9).alias(c) for c in ("rate", "tpr", "fpr", "ece")), F.round(F.col("hi") - F.col("lo"), 9).alias("disparity"), F.round(impact, 9).alias("impact"), (impact < 0.8).alias("flagged"))


@query("C17")
def fairness_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations over checks, as one score per audit."""
    own = fairness(spark, sf_dir).agg(
        F.max((F.col("disparity") > 0.1).cast("int")).alias("parity"), (F.max("tpr") - F.min("tpr") > 0.1).cast("int").alias("odds"), F.max(F.col("flagged").cast("int")).alias("impact")
    )
    return own.withColumn("audit_score", 1 - (F.col("parity") + F.col("odds") + F.col("impact")) / 3)


@query("C19")
def recalibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Platt scaling, isotonic regression and a temperature found on a grid, compared by Brier score."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    from plumbline.functions.scores import logit, sigmoid

    rows = predictions(spark, sf_dir).select("p", F.col("y").cast("double").alias("label"), logit(F.col("p"), 1e-4).alias("logit"))
    rows = VectorAssembler(inputCols=["logit"], outputCol="features").transform(rows)
    platt = LogisticRegression(maxIter=30).fit(rows).transform(rows)
    isotonic = IsotonicRegression(featuresCol="p", predictionCol="iso").fit(rows).transform(rows)
    grid = [0.25 * i for i in range(1, 21)]
    loss = [F.avg(-F.log(F.when(F.col("label") == 1, sigmoid(F.col("logit") / t)).otherwise(1 - sigmoid(F.col("logit") / t)) + 1e-12)).alias(f"t{i}") for i, t in enumerate(grid)]
    best = rows.agg(*loss).select(F.explode(F.array(*(F.struct(F.col(f"t{i}").alias("loss"), F.lit(t).alias("temperature")) for i, t in enumerate(grid)))).alias("x"))
    best = best.agg(F.min("x").alias("x")).select(F.lit("temperature").alias("method"), F.col("x.temperature").alias("parameter"), F.col("x.loss").alias("value"))
    one = F.get(F.col("probability_array"), F.lit(1))
    from pyspark.ml.functions import vector_to_array

    platt = platt.withColumn("probability_array", vector_to_array("probability")).agg(F.avg((one - F.col("label")) * (one - F.col("label"))).alias("value"))
    iso = isotonic.agg(F.avg((F.col("iso") - F.col("label")) * (F.col("iso") - F.col("label"))).alias("value"))
    null = F.lit(None).cast("double").alias("parameter")
    return best.unionByName(platt.select(F.lit("platt").alias("method"), null, "value")).unionByName(iso.select(F.lit("isotonic").alias("method"), null, "value"))


_AB = """ab AS (SELECT l_returnflag AS metric, (l_orderkey % 2)::INT AS g, l_quantity AS x FROM lineitem WHERE l_returnflag = 'A')"""


def ab_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select((F.col("l_orderkey") % 2).cast("int").alias("g"), F.col("l_quantity").alias("x"))


@query(
    "C26 C28",
    f"""WITH {_AB}, m AS (SELECT count(*) FILTER (g = 0) AS n0, count(*) FILTER (g = 1) AS n1, avg(x) FILTER (g = 0) AS m0, avg(x) FILTER (g = 1) AS m1, var_samp(x) FILTER (g = 0) AS v0, var_samp(x) FILTER (g = 1) AS v1 FROM ab)
SELECT round((m1 - m0) / sqrt(v0 / n0 + v1 / n1), 6) AS t, round((v0 / n0 + v1 / n1) ** 2 / ((v0 / n0) ** 2 / (n0 - 1) + (v1 / n1) ** 2 / (n1 - 1)), 3) AS df, round((m1 - m0) / abs(m0), 9) AS lift,
  CASE WHEN n0 + n1 < 1000 THEN 'continue' WHEN (m1 - m0) / abs(m0) < -0.05 THEN 'rollback' WHEN abs((m1 - m0) / sqrt(v0 / n0 + v1 / n1)) > 1.96 THEN 'significant' ELSE 'continue' END AS decision FROM m""",
)
def ab_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ab_rows(spark, sf_dir)
    own = stats.welch(rows, "x", "g").crossJoin(rows.agg(F.count("*").alias("n")))
    decision = F.when(F.col("n") < 1000, "continue").when(F.col("lift") < -0.05, "rollback").when(F.abs("t") > 1.96, "significant").otherwise("continue")
    return own.select(F.round("t", 6).alias("t"), F.round("df", 3).alias("df"), F.round("lift", 9).alias("lift"), decision.alias("decision"))


@query("C26")
def ab_test_p_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the p-value, for which DuckDB has no Student distribution."""
    return stats.welch(ab_rows(spark, sf_dir), "x", "g")


@query(
    "C27",
    f"""WITH {_AB}, v AS (SELECT x, count(*) FILTER (g = 1) AS pos, count(*) FILTER (g = 0) AS neg FROM ab GROUP BY x), r AS (SELECT *, sum(neg) OVER (ORDER BY x) - neg AS nb FROM v), s AS (SELECT sum(pos * (nb + neg / 2)) AS u, sum(pos)::DOUBLE AS n1, sum(neg)::DOUBLE AS n0, sum((pos + neg)::DOUBLE ** 3 - (pos + neg)) AS ties FROM r)
SELECT u, round((u - n1 * n0 / 2) / sqrt(n1 * n0 / 12 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1)))), 6) AS z FROM s""",
)
def rank_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mann_whitney(ab_rows(spark, sf_dir), "x", "g").select("u", F.round("z", 6).alias("z"))


@query(
    "C29 N15",
    f"""WITH {SOCIAL}, s AS (SELECT score AS x, (ts >= TIMESTAMP '2024-01-16')::INT AS g FROM social), v AS (SELECT x, sum(g) AS pos, count(*) - sum(g) AS neg FROM s GROUP BY x),
k AS (SELECT max(abs(sp / tp::DOUBLE - sn / tn::DOUBLE)) AS ks FROM (SELECT sum(pos) OVER (ORDER BY x) AS sp, sum(neg) OVER (ORDER BY x) AS sn, sum(pos) OVER () AS tp, sum(neg) OVER () AS tn FROM v)),
b AS (SELECT least(floor(round((x - lo) / ((hi - lo) / 10), 9)) + 1, 10) AS bin, count(*) FILTER (g = 0) AS e, count(*) FILTER (g = 1) AS a FROM s, (SELECT min(x) AS lo, max(x) AS hi FROM s) GROUP BY 1),
p AS (SELECT t.bin, coalesce(e, 0) / (SELECT sum(e) FROM b) + 1e-10 AS e, coalesce(a, 0) / (SELECT sum(a) FROM b) + 1e-10 AS a FROM range(1, 11) t(bin) LEFT JOIN b ON b.bin = t.bin)
SELECT round(any_value(ks), 9) AS ks, round(sum((a - e) * ln(a / e)), 6) AS psi, CASE WHEN sum((a - e) * ln(a / e)) > 0.2 THEN 'drift' ELSE 'stable' END AS verdict FROM p, k""",
)
def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves of a month compared; the reference sample is the real one, not a normal one redrawn from its moments."""
    rows = social(spark, sf_dir).select(F.col("score").alias("x"), (F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")).cast("int").alias("g"))
    own = stats.ks_statistic(rows, "x", "g").crossJoin(stats.psi(rows, "x", "g"))
    return own.select(F.round("ks", 9).alias("ks"), F.round("psi", 6).alias("psi"), F.when(F.col("psi") > 0.2, "drift").otherwise("stable").alias("verdict"))


@query(
    "N16 C30 C31",
    f"""WITH {_PRED}, s AS (SELECT p AS x, (post_id % 2)::INT AS g FROM pred), b AS (SELECT least(floor(round(x / 0.05, 9)) + 1, 20) AS bin, count(*) FILTER (g = 0) AS e, count(*) FILTER (g = 1) AS a FROM s GROUP BY 1),
p AS (SELECT coalesce(e, 0) / (SELECT sum(e) FROM b) + 1e-4 AS e, coalesce(a, 0) / (SELECT sum(a) FROM b) + 1e-4 AS a FROM range(1, 21) t(bin) LEFT JOIN b ON b.bin = t.bin)
SELECT round(sum((a - e) * ln(a / e)), 6) AS psi, round(sum(a * ln(a / e)), 6) AS kl, CASE WHEN sum((a - e) * ln(a / e)) > 0.3 THEN 'severe' WHEN sum((a - e) * ln(a / e)) > 0.15 THEN 'moderate' WHEN sum((a - e) * ln(a / e)) > 0.05 THEN 'mild' ELSE 'none' END AS verdict FROM p""",
)
def prediction_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).select(F.col("p").alias("x"), (F.col("post_id") % 2).cast("int").alias("g"))
    v = F.col("psi")
    own = stats.psi(rows, "x", "g", bins=20, eps=1e-4, low=0.0, high=1.0)
    return own.select(F.round("psi", 6).alias("psi"), F.round("kl", 6).alias("kl"), F.when(v > 0.3, "severe").when(v > 0.15, "moderate").when(v > 0.05, "mild").otherwise("none").alias("verdict"))


@query(
    "C32",
    f"""WITH {SOCIAL}, f AS (SELECT 'score' AS feature, score AS x FROM social UNION ALL SELECT 'sentiment', sentiment FROM social UNION ALL SELECT 'toxicity', toxicity FROM social)
SELECT feature, round(avg(x), 9) AS mean, round(stddev_pop(x), 9) AS std, min(x) AS low, max(x) AS high, round(quantile_cont(x, 0.05), 9) AS p5, round(quantile_cont(x, 0.95), 9) AS p95,
  (SELECT string_agg(n, ',' ORDER BY bin) FROM (SELECT bin, count(y.x) FILTER (b = bin)::VARCHAR AS n FROM range(50) r(bin), (SELECT z.x, least(floor(round((z.x - lo) / ((hi - lo) / 50), 9)), 49) AS b FROM f z, (SELECT min(x) AS lo, max(x) AS hi FROM f w WHERE w.feature = f.feature) WHERE z.feature = f.feature) y GROUP BY bin)) AS histogram FROM f GROUP BY feature""",
)
def reference_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = social(spark, sf_dir).select("score", "sentiment", "toxicity").unpivot([], ["score", "sentiment", "toxicity"], "feature", "x")
    ends = stats.quantiles(own, "x", [0.05, 0.95], "feature").select("feature", *(F.round(F.get("q", F.lit(i)), 9).alias(n) for i, n in enumerate(("p5", "p95"))))
    whole = own.groupBy("feature").agg(F.round(F.avg("x"), 9).alias("mean"), F.round(F.stddev_pop("x"), 9).alias("std"), F.min("x").alias("low"), F.max("x").alias("high"))
    spans = whole.select("feature", "low", "high")
    width = (F.col("high") - F.col("low")) / 50
    bin_ = F.least(F.floor(F.round((F.col("x") - F.col("low")) / width, 9)), F.lit(49)).cast("int")
    counts = own.join(F.broadcast(spans), "feature").groupBy("feature", bin_.alias("bin")).agg(F.count("*").alias("n"))
    held = counts.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    bars = F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("string"))
    return whole.join(ends, "feature").join(held.select("feature", F.array_join(bars, ",").alias("histogram")), "feature")


@query(
    "C37",
    """WITH m AS (SELECT o_custkey AS model, 1 - avg((o_orderstatus = 'F')::INT) / 4 AS f1, quantile_cont(o_totalprice / 10000, 0.99) AS p99, stddev_pop(o_totalprice) / 1e6 AS drift FROM orders GROUP BY 1)
SELECT model, f1 >= 0.88 AND p99 <= 50 AND drift <= 0.15 AS promoted, concat_ws(',', CASE WHEN f1 < 0.88 THEN 'f1' END, CASE WHEN p99 > 50 THEN 'latency' END, CASE WHEN drift > 0.15 THEN 'drift' END) AS reasons FROM m""",
)
def promotion_gate(spark: SparkSession, sf_dir: str, least_f1: float = 0.88, most_latency_ms: float = 50.0, most_drift: float = 0.15) -> DataFrame:
    """Models that pass the gate, and the reasons of those that don't; a model's metrics stand in from its orders."""
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("model")).agg(
        (1 - F.avg((F.col("o_orderstatus") == "F").cast("int")) / 4).alias("f1"), F.percentile(F.col("o_totalprice") / 10000, 0.99).alias("p99"), (F.stddev_pop("o_totalprice") / 1e6).alias("drift")
    )
    fails = [("f1", F.col("f1") < least_f1), ("latency", F.col("p99") > most_latency_ms), ("drift", F.col("drift") > most_drift)]
    reasons = F.concat_ws(",", *(F.when(c, n) for n, c in fails))
    return m.select("model", (reasons == "").alias("promoted"), reasons.alias("reasons"))


@query("C05 C41 P18")
def label_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic regression on the votes corrects unsure weak labels; a forest and a linear SVM are fitted beside it."""
    from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    # The models pass over the votes again and again: they are made from the texts once.
    rows = weak_documents(spark, sf_dir).where("weak_label >= 0").select("doc_id", F.col("weak_label").cast("double").alias("label"), "confidence", *_VOTES)
    rows = materialize(rows, "weak-votes")
    rows = VectorAssembler(inputCols=list(_VOTES), outputCol="raw").transform(rows)
    rows = StandardScaler(inputCol="raw", outputCol="features").fit(rows).transform(rows).select("doc_id", "label", "confidence", "features")
    sure = rows.where("confidence > 0.3")
    out = LogisticRegression(maxIter=30).fit(sure).transform(rows)
    final = F.when(F.col("confidence") > 0.7, F.col("label")).otherwise(F.col("prediction"))
    results = [out.select(F.lit("corrected").alias("model"), (final == F.col("label")).alias("same"))]
    for name, model in (("forest", RandomForestClassifier(numTrees=10, seed=1)), ("svc", LinearSVC(maxIter=10))):
        results.append(model.fit(sure).transform(rows).select(F.lit(name).alias("model"), (F.col("prediction") == F.col("label")).alias("same")))
    return results[0].unionByName(results[1]).unionByName(results[2]).groupBy("model").agg(F.count("*").alias("n"), F.avg(F.col("same").cast("int")).alias("agreement"))


@query(
    "C10 F17",
    """WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS low, coalesce(text, '') AS t FROM documents),
h AS (SELECT doc_id, len(regexp_extract_all(low, 'stupid|idiot|scum')) AS bad, len(regexp_extract_all(t, '!')) AS marks, len(regexp_extract_all(t, '[A-Z]')) / greatest(length(t), 1)::DOUBLE AS caps FROM t),
p AS (SELECT doc_id, least(bad * 0.2::DOUBLE, 1.0) AS plain, least(bad * 0.15::DOUBLE + marks * 0.05::DOUBLE, 1.0) AS marked, least(bad * 0.1::DOUBLE + caps, 1.0) AS shouted FROM h)
SELECT doc_id, round(plain, 6) AS plain, round(marked, 6) AS marked, round(shouted, 6) AS shouted, greatest(plain, marked, shouted) < 0.7 AS passes FROM p""",
)
def toxicity_proxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three cheap proxies of toxicity, and whether a text passes moderation by all of them."""
    t = X.whole(F.col("text"))
    bad, marks = F.regexp_count(F.lower(t), F.lit("stupid|idiot|scum")), F.regexp_count(t, F.lit("!"))
    own = {"plain": bad * F.lit(0.2), "marked": bad * F.lit(0.15) + marks * F.lit(0.05), "shouted": bad * F.lit(0.1) + X.caps_ratio(F.col("text"))}
    capped = {n: F.least(c, F.lit(1.0)) for n, c in own.items()}
    return table(spark, sf_dir, "documents").select("doc_id", *(F.round(c, 6).alias(n) for n, c in capped.items()), (F.greatest(*capped.values()) < 0.7).alias("passes"))
