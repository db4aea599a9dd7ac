"""Experiments, validation as a whole, and drift over several features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import stats
from plumbline.operators.experiments import bootstrap_interval, cross_validated, privacy_utility, stopping_rule
from plumbline.operators.validate import overall, validate
from plumbline.plans.base import SOCIAL, social
from plumbline.registry import query, table


@query("M11")
def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bootstrap interval of a difference of means over 10,000 replicates of all rows."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 2).alias("g"))
    return bootstrap_interval(rows, "c_custkey", "x", "g")


_DAYS = "date_diff('day', min(o_orderdate), max(o_orderdate))"


@query(
    "C26 C28",
    """WITH r AS (SELECT o_orderpriority AS test, o_custkey % 2 AS g, CASE WHEN o_orderpriority = '5-LOW' AND o_custkey % 2 = 1 THEN o_totalprice * 0.9::DOUBLE WHEN o_orderpriority = '2-HIGH' AND o_custkey % 2 = 1 THEN o_totalprice * 1.5::DOUBLE ELSE o_totalprice END AS x, o_orderdate FROM orders),
m AS (SELECT test, count(*) FILTER (g = 0) AS n0, count(*) FILTER (g = 1) AS n1, avg(x) FILTER (g = 0) AS m0, avg(x) FILTER (g = 1) AS m1, var_samp(x) FILTER (g = 0) AS v0, var_samp(x) FILTER (g = 1) AS v1, date_diff('day', min(o_orderdate), max(o_orderdate)) AS days FROM r GROUP BY test),
s AS (SELECT *, (m1 - m0) / abs(m0) AS lift, abs(m1 - m0) / sqrt(v0 / n0 + v1 / n1) > 1.96 AS sure FROM m)
SELECT test, round(lift, 9) AS lift, days, CASE WHEN n0 < 100 OR n1 < 100 THEN NULL WHEN lift < -0.05 THEN 'rollback' WHEN sure AND lift > 0 THEN 'promote' WHEN sure AND lift < 0 THEN 'rollback' WHEN days >= 14 THEN CASE WHEN lift < 0 THEN 'rollback' ELSE 'promote' END END AS decision FROM s""",
)
def stopped_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests by order priority, whether each ends and how; all groups in one pass."""
    o, second = table(spark, sf_dir, "orders"), F.col("o_custkey") % 2 == 1
    x = F.when((F.col("o_orderpriority") == "5-LOW") & second, F.col("o_totalprice") * 0.9).when((F.col("o_orderpriority") == "2-HIGH") & second, F.col("o_totalprice") * 1.5).otherwise(F.col("o_totalprice"))
    rows = o.select(F.col("o_orderpriority").alias("test"), second.alias("g"), x.alias("x"), "o_orderdate")
    side = {g: F.when(F.col("g") == bool(g), F.col("x")) for g in (0, 1)}
    own = rows.groupBy("test").agg(
        *(f(side[g]).alias(f"{n}{g}") for g in (0, 1) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))), F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).cast("long").alias("days")
    )
    own = own.withColumn("lift", stats.ratio(F.col("m1") - F.col("m0"), F.abs("m0")))
    sure = F.abs(F.col("m1") - F.col("m0")) / F.sqrt(F.col("v0") / F.col("n0") + F.col("v1") / F.col("n1")) > 1.96
    return own.select("test", F.round("lift", 9).alias("lift"), "days", stopping_rule(F.col("n0"), F.col("n1"), F.col("lift"), sure, F.col("days"), least=100).alias("decision"))


#: Budgets of privacy that are compared; fixed values.
EPSILONS = [0.1, 0.5, 1.0, 2.0, 5.0, float("inf")]
_NOISE = "CASE WHEN scale = 0 THEN 0 ELSE -scale * sign({0} - 0.5) * ln(1 - 2 * abs({0} - 0.5)) END"


def _u(sum_: str) -> str:
    return f"((('0x' || left(md5(name || ':' || bin || ':{sum_}'), 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)"


@query(
    "C39",
    f"""WITH {SOCIAL}, r AS (SELECT user_id, round(least(greatest(0.5 + sentiment / 2 + (score - 50) / 1000, 0), 1), 5) AS p, (k * 13 % 100 < k)::INT AS y FROM social),
w AS (SELECT user_id, least(1.0, 4.0 / count(*)) AS w FROM r GROUP BY user_id), b AS (SELECT least(floor(round(p * 20, 9)), 19)::INT AS bin, sum(w * y) AS ws, sum(w) AS wn, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM r JOIN w USING (user_id) GROUP BY 1),
e AS (SELECT * FROM (VALUES ('0.1', 80.0::DOUBLE), ('0.5', 16.0), ('1.0', 8.0), ('2.0', 4.0), ('5.0', 1.6), ('inf', 0.0)) t(name, scale)),
n AS (SELECT name, bin, pos, neg, least(greatest(round((ws + {_NOISE.format(_u("s"))}) / greatest(wn + {_NOISE.format(_u("n"))}, 1.0), 9), 0), 1) AS rate FROM b, e),
f AS (SELECT name, sum(pos) FILTER (rate > 0.5) AS tp, sum(neg) FILTER (rate > 0.5) AS fp, sum(pos) FILTER (rate <= 0.5) AS fn, sum(neg) FILTER (rate <= 0.5) AS tn FROM n GROUP BY name),
a AS (SELECT x.name, sum(x.pos * y.neg * CASE WHEN x.rate > y.rate THEN 1.0 WHEN x.rate = y.rate THEN 0.5 ELSE 0 END) / sum(x.pos * y.neg) AS auc FROM n x JOIN n y ON x.name = y.name GROUP BY x.name)
SELECT name AS epsilon, round((coalesce(tp, 0) + coalesce(tn, 0)) / (coalesce(tp, 0) + coalesce(fp, 0) + coalesce(fn, 0) + coalesce(tn, 0)), 6) AS accuracy,
  round(coalesce(2 * tp / (2 * tp + coalesce(fp, 0) + coalesce(fn, 0)), 0), 6) AS f1, round(auc, 6) AS auc FROM f JOIN a USING (name)""",
)
def privacy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, F1 and area by epsilon, down to no privacy at all."""
    p = F.round(F.least(F.greatest(0.5 + F.col("sentiment") / 2 + (F.col("score") - 50) / 1000, F.lit(0.0)), F.lit(1.0)), 5)
    rows = social(spark, sf_dir).select("user_id", p.alias("p"), (F.col("k") * 13 % 100 < F.col("k")).cast("int").alias("y"))
    return privacy_utility(rows, "user_id", "p", "y", EPSILONS)


@query("C41 M13")
def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A standardised classifier's figures by fold; folds are those of ``partition_clients``, by hash of the key."""
    rows = social(spark, sf_dir).select("post_id", "sentiment", "score", "comments", "followers", (F.col("k") * 13 % 100 < F.col("k")).cast("int").alias("label"))
    return cross_validated(rows, "post_id", ["sentiment", "score", "comments", "followers"], "label")


_FEATURES = ("score", "sentiment", "toxicity")


def _psi_sql(feature: str) -> str:
    return f"""SELECT '{feature}' AS feature, any_value(n0) AS n0, any_value(n1) AS n1, sum((a - e) * ln(a / e)) AS psi FROM (
  SELECT t.bin, coalesce(e, 0) / s.n0 + 1e-10 AS e, coalesce(a, 0) / s.n1 + 1e-10 AS a, s.n0, s.n1 FROM range(1, 11) t(bin)
  LEFT JOIN (SELECT least(floor(round(({feature} - lo) / ((hi - lo) / 10), 9)) + 1, 10) AS bin, count(*) FILTER (g = 0) AS e, count(*) FILTER (g = 1) AS a FROM s, (SELECT min({feature}) AS lo, max({feature}) AS hi FROM s) GROUP BY 1) b ON b.bin = t.bin,
  (SELECT count(*) FILTER (g = 0) AS n0, count(*) FILTER (g = 1) AS n1 FROM s) s)"""


def _ks_sql(feature: str) -> str:
    return f"""SELECT '{feature}' AS feature, max(abs(sp / tp::DOUBLE - sn / tn::DOUBLE)) AS ks FROM (SELECT sum(pos) OVER (ORDER BY x) AS sp, sum(neg) OVER (ORDER BY x) AS sn, sum(pos) OVER () AS tp, sum(neg) OVER () AS tn FROM (SELECT {feature} AS x, sum(g) AS pos, count(*) - sum(g) AS neg FROM s GROUP BY 1))"""


@query(
    "C29 C30 N15",
    f"""WITH {SOCIAL}, s AS (SELECT CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN score * 1.4 ELSE score END AS score, sentiment, toxicity, (ts >= TIMESTAMP '2024-01-16')::INT AS g FROM social),
p AS ({" UNION ALL ".join(map(_psi_sql, _FEATURES))}), k AS ({" UNION ALL ".join(map(_ks_sql, _FEATURES))}),
d AS (SELECT feature, psi, ks, ks * sqrt(n0 * n1 / (n0 + n1)::DOUBLE) > 1.628 OR psi > 0.2 AS drifted, n0 >= 100 AND n1 >= 100 AS counted FROM p JOIN k USING (feature)),
r AS (SELECT count(*) FILTER (drifted AND counted) / (count(*) FILTER (counted) + 2)::DOUBLE AS ratio FROM d)
SELECT feature, round(psi, 6) AS psi, round(ks, 9) AS ks, drifted, round(ratio, 9) AS ratio, CASE WHEN ratio > 0.3 THEN 'critical' WHEN ratio > 0.15 THEN 'high' WHEN ratio > 0.05 THEN 'medium' ELSE 'low' END AS risk FROM d, r""",
)
def drift_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of each feature between two halves of a month, by KS test and PSI, and the risk by the share of those that drift.

    Features with fewer than 100 values on a side don't count; two more tests (of predictions and of reconstruction) are in the
    denominator. KS is compared with its bound at a level of 0.01.
    """
    second = F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    rows = social(spark, sf_dir).select(F.when(second, F.col("score") * 1.4).otherwise(F.col("score")).alias("score"), "sentiment", "toxicity", second.cast("int").alias("g"))
    sizes = rows.agg(F.count_if(F.col("g") == 0).alias("n0"), F.count_if(F.col("g") == 1).alias("n1"))
    each = [stats.ks_statistic(rows, f, "g").crossJoin(stats.psi(rows, f, "g")).select(F.lit(f).alias("feature"), "psi", "ks") for f in _FEATURES]
    own = reduce(DataFrame.unionByName, each).crossJoin(F.broadcast(sizes))
    beyond = F.col("ks") * F.sqrt(F.col("n0") * F.col("n1") / (F.col("n0") + F.col("n1"))) > 1.628
    own = own.select("feature", "psi", "ks", (beyond | (F.col("psi") > 0.2)).alias("drifted"), ((F.col("n0") >= 100) & (F.col("n1") >= 100)).alias("counted"))
    ratio = own.agg((F.count_if(F.col("drifted") & F.col("counted")) / (F.count_if(F.col("counted")) + 2)).alias("ratio"))
    r = F.col("ratio")
    risk = F.when(r > 0.3, "critical").when(r > 0.15, "high").when(r > 0.05, "medium").otherwise("low")
    return own.crossJoin(F.broadcast(ratio)).select("feature", F.round("psi", 6).alias("psi"), F.round("ks", 9).alias("ks"), "drifted", F.round(r, 9).alias("ratio"), risk.alias("risk"))


_TEN_ROWS = f"""{SOCIAL}, v AS (SELECT CASE WHEN post_id % 500 = 7 THEN post_id - 1 ELSE post_id END AS id, (k > 40)::INT AS label, score, comments, toxicity AS upvote_ratio, epoch(ts) AS created, repeat('word ', 1 + (post_id % 40)::INT) AS body, left(md5(user_id::VARCHAR), 16) AS author_hash FROM social),
a AS (SELECT count(*) AS n, count(*) FILTER (id IS NULL OR body IS NULL OR label IS NULL) AS nulls, count(*) FILTER (label NOT IN (0, 1) OR score < 0 OR comments < 0 OR upvote_ratio < 0 OR upvote_ratio > 1) AS bad, avg(label) AS positive,
  count(*) FILTER (length(body) < 5) AS short, count(*) FILTER (length(body) > 10000) AS long, count(*) - count(DISTINCT id) AS dups, avg(regexp_matches(author_hash, '^[a-zA-Z0-9_-]{{3,20}}$')::INT) AS raw,
  count(*) FILTER (created < 1.2e9 OR created > epoch(TIMESTAMP '2024-03-01')) AS dates, count(*) FILTER (score / (comments + 1) > 1000) AS outliers FROM v)"""


@query(
    "C12 A28 A29 D06",
    f"""WITH {_TEN_ROWS}, c AS (SELECT unnest([{{'check_name': 'schema', 'passed': true, 'value': 0.0::DOUBLE}}, {{'check_name': 'nulls', 'passed': nulls = 0, 'value': nulls::DOUBLE}}, {{'check_name': 'types', 'passed': true, 'value': 0.0::DOUBLE}}, {{'check_name': 'ranges', 'passed': bad = 0, 'value': bad::DOUBLE}},
  {{'check_name': 'label_balance', 'passed': least(positive, 1 - positive) >= 0.01, 'value': round(least(positive, 1 - positive), 9)}}, {{'check_name': 'text_quality', 'passed': short <= 0.01 * n AND long = 0, 'value': (short + long)::DOUBLE}}, {{'check_name': 'duplicates', 'passed': dups = 0, 'value': dups::DOUBLE}},
  {{'check_name': 'raw_names', 'passed': raw <= 0.5, 'value': round(raw, 9)}}, {{'check_name': 'dates', 'passed': dates = 0, 'value': dates::DOUBLE}}, {{'check_name': 'engagement', 'passed': true, 'value': outliers::DOUBLE}}]) AS c FROM a)
SELECT c.check_name, c.passed, c.value, avg((NOT c.passed)::INT) OVER () <= 0.05 AS suite_passed FROM c""",
)
def ten_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten checks of a data set and whether it passes as a whole: if no more than a twentieth of them fail."""
    i, text = F.col("post_id"), "word "
    rows = social(spark, sf_dir).select(
        F.when(i % 500 == 7, i - 1).otherwise(i).alias("id"), (F.col("k") > 40).cast("int").alias("label"), "score", "comments", F.col("toxicity").alias("upvote_ratio"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("created"), F.expr(f"repeat('{text}', cast(1 + post_id % 40 AS int))").alias("body"), F.substring(F.md5(F.col("user_id").cast("string").cast("binary")), 1, 16).alias("author_hash"),
    )
    expected = {"id": "bigint", "label": "int", "score": "double", "comments": "int", "upvote_ratio": "double", "created": "double", "body": "string", "author_hash": "string"}
    have = dict(rows.dtypes)
    missing, other = [c for c in expected if c not in have], [c for c, t in expected.items() if c in have and have[c] != t]
    c = F.col
    figures = {
        "n": F.count("*"), "missing": F.first(F.lit(len(missing))), "other": F.first(F.lit(len(other))),
        "nulls": F.count_if(c("id").isNull() | c("body").isNull() | c("label").isNull()),
        "bad": F.count_if(~c("label").isin(0, 1) | (c("score") < 0) | (c("comments") < 0) | (c("upvote_ratio") < 0) | (c("upvote_ratio") > 1)),
        "minority": F.least(F.avg("label"), 1 - F.avg("label")), "short": F.count_if(F.length("body") < 5), "long": F.count_if(F.length("body") > 10_000), "uneven": F.count_if((F.length("body") < 5) | (F.length("body") > 10_000)),
        "dups": F.count("*") - F.countDistinct("id"), "raw": F.avg(c("author_hash").rlike("^[a-zA-Z0-9_-]{3,20}$").cast("int")),
        "dates": F.count_if((c("created") < 1.2e9) | (c("created") > 1709251200)), "outliers": F.count_if(c("score") / (c("comments") + 1) > 1000),
    }
    checks = {
        "schema": ("missing", "missing = 0"), "nulls": ("nulls", "nulls = 0"), "types": ("other", "other = 0"), "ranges": ("bad", "bad = 0"), "label_balance": ("minority", "minority >= 0.01"),
        "text_quality": ("uneven", "short <= 0.01 * n AND long = 0"), "duplicates": ("dups", "dups = 0"), "raw_names": ("raw", "raw <= 0.5"), "dates": ("dates", "dates = 0"), "engagement": ("outliers", "true"),
    }
    results = validate(rows, figures, checks)
    return results.crossJoin(F.broadcast(overall(results).withColumnRenamed("passed", "suite_passed")))
