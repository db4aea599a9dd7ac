"""Text functions over ``documents``, ``conversations``, ``pages`` and ``benchmark``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.registry import query, table

#: The phrases of the text queries.
ACTION = ["the", "of", "and", "tion", "mente", "schaft"]
HEDGE = ["perhaps", "maybe", "allegedly"]
FLAGS = ["loser", "idiot", "trash", "cancel", "boycott", "stupid", "scum"]


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with marks of social posts put in front, so that all patterns have something to match."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", "n_chars")
    mark = F.concat(
        F.lit("@User_"), (F.col("doc_id") % 7).cast("string"), F.lit(" u/name-"), (F.col("doc_id") % 5).cast("string"),
        F.lit(" #Tag see https://t.co/x?y=1 www.a.b mail a.b@c.org call 555-123-4567 card 4111 1111 1111 1111 NOW!!! "),
    )
    return docs.withColumn("post", F.concat(mark, F.coalesce("text", F.lit(""))))


POSTS = """
posts AS (SELECT doc_id, source, lang, text, n_chars, '@User_' || (doc_id % 7) || ' u/name-' || (doc_id % 5)
  || ' #Tag see https://t.co/x?y=1 www.a.b mail a.b@c.org call 555-123-4567 card 4111 1111 1111 1111 NOW!!! '
  || coalesce(text, '') AS post FROM documents)
"""


@query(
    "X01 X03",
    f"""WITH {POSTS} SELECT doc_id,
  trim(regexp_replace(lower(regexp_replace(post, 'https?://\\S+|www\\.\\S+', '', 'g')), '\\s+', ' ', 'g')) AS cleaned,
  trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(post, 'https?://\\S+|www\\.\\S+', '', 'g'), '@\\w+', '', 'g'), '#\\w+', '', 'g')), '\\s+', ' ', 'g')) AS bare,
  trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS squeezed FROM posts""",
)
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts(spark, sf_dir).select(
        "doc_id",
        X.clean(F.col("post")).alias("cleaned"),
        X.clean(F.col("post"), mentions=True, hashtags=True).alias("bare"),
        X.squeeze_space(F.col("text")).alias("squeezed"),
    )


@query(
    "X02",
    f"""WITH {POSTS} SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(post,
  '{X.EMAIL}', '[EMAIL]', 'g'), '{X.PHONE}', '[PHONE]', 'g'), '{X.CARD}', '[CARD]', 'g') AS masked FROM posts""",
)
def text_anonymize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts(spark, sf_dir).select("doc_id", X.anonymize(F.col("post")).alias("masked"))


@query(
    "X04 X05 X06 X32",
    """SELECT doc_id, left(sha256(source || ':' || lower(trim(coalesce(text, '')))), 16) AS sample_id, left(sha256(source || 'pepper'), 16) AS salted,
  CASE WHEN source = 'src0' THEN source ELSE left(sha256(source), 16) END AS author,
  left(sha256('{"author":"' || source || '","doc":' || doc_id || '}'), 16) AS cache_key FROM documents""",
)
def text_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.lower(F.trim(F.coalesce("text", F.lit(""))))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        X.short_hash(F.concat("source", F.lit(":"), body)).alias("sample_id"),
        X.salted_hash(F.col("source"), "pepper").alias("salted"),
        X.author_hash(F.col("source"), ("src0",)).alias("author"),
        X.short_hash(F.to_json(F.struct(F.col("source").alias("author"), F.col("doc_id").alias("doc")))).alias("cache_key"),
    )


@query(
    "X07 X16 X22 X30",
    f"""WITH {POSTS}, w AS (SELECT doc_id, post, text, lang, list_filter(string_split(trim(regexp_replace(lower(post), '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS ws FROM posts)
SELECT doc_id, length(post)::BIGINT AS n_chars, len(ws)::BIGINT AS n_words, len(regexp_extract_all(post, '#\\w+'))::BIGINT AS n_tags,
  round(len(regexp_extract_all(post, '[A-Z]')) / length(post)::DOUBLE, 6) AS caps, len(regexp_extract_all(post, '!'))::BIGINT AS marks,
  round(len(list_distinct(ws)) / len(ws)::DOUBLE, 6) AS unique_ratio, regexp_matches(coalesce(text, ''), '[^\\x00-\\x7F]') AS non_ascii FROM w""",
)
def text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    post = F.col("post")
    return posts(spark, sf_dir).select(
        "doc_id",
        F.length(post).cast("long").alias("n_chars"),
        X.word_count(post).alias("n_words"),
        F.regexp_count(post, F.lit(r"#\w+")).cast("long").alias("n_tags"),
        F.round(X.caps_ratio(post), 6).alias("caps"),
        F.regexp_count(post, F.lit("!")).cast("long").alias("marks"),
        F.round(X.unique_word_ratio(post), 6).alias("unique_ratio"),
        X.whole(F.col("text")).rlike(r"[^\x00-\x7F]").alias("non_ascii"),
    )


_LOW = "lower(coalesce(text, ''))"


@query(
    "X08 X09 X10 X11 X25 F06",
    f"""SELECT doc_id, {", ".join(f"contains({_LOW}, '{p}') AS has_{p}" for p in FLAGS)},
  ({" + ".join(f"contains({_LOW}, '{p}')::INT" for p in ACTION)})::INT AS actions,
  least(2 * len(regexp_extract_all({_LOW}, '\\b({"|".join(FLAGS)})\\b')), 4)::INT AS points,
  CASE {" ".join(f"WHEN contains({_LOW}, '{p}') THEN '{p}'" for p in FLAGS)} ELSE 'none' END AS primary_flag,
  regexp_matches({_LOW}, '{"|".join(FLAGS)}') AS any_flag FROM documents""",
)
def text_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        *(F.lower(X.whole(text)).contains(p).alias(f"has_{p}") for p in FLAGS),
        X.distinct_hits(text, ACTION).cast("int").alias("actions"),
        F.least(2 * X.whole_word_hits(text, FLAGS), F.lit(4)).cast("int").alias("points"),
        X.first_hit(text, FLAGS).alias("primary_flag"),
        X.contains_any(text, FLAGS).alias("any_flag"),
    )


@query(
    "X12 X13 X14",
    f"""WITH {POSTS} SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(post), '@(\\w+)', 1))), ',') AS at_names,
  array_to_string(list_sort(list_distinct(regexp_extract_all(lower(post), '/?u/([A-Za-z0-9_-]+)', 1))), ',') AS u_names,
  array_to_string(list_sort(list_distinct(regexp_extract_all(lower(post), '@([a-zA-Z0-9_.]+)', 1))), ',') AS dotted FROM posts""",
)
def text_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    post = F.col("post")
    names = {"at_names": r"@(\w+)", "u_names": "/?u/([A-Za-z0-9_-]+)", "dotted": "@([a-zA-Z0-9_.]+)"}
    return posts(spark, sf_dir).select("doc_id", *(F.array_join(F.array_sort(X.mentions(post, p)), ",").alias(n) for n, p in names.items()))


@query(
    "X15",
    """WITH w AS (SELECT DISTINCT p_partkey, unnest(regexp_extract_all(p_name || ' ' || replace(p_type, ' ', '_') || ' camelCase' || p_size, '[A-Za-z_][A-Za-z0-9_]*')) AS w FROM part),
k AS (SELECT p_partkey, lower(w) AS k FROM w UNION SELECT p_partkey, lower(unnest(string_split(w, '_'))) FROM w
  UNION SELECT p_partkey, lower(unnest(regexp_extract_all(w, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'))) FROM w)
SELECT p_partkey, string_agg(k, ',' ORDER BY k) AS keywords FROM k WHERE k <> '' GROUP BY p_partkey""",
)
def text_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_name", F.lit(" "), F.replace("p_type", F.lit(" "), F.lit("_")), F.lit(" camelCase"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.identifier_keywords(name), ",").alias("keywords"))


@query(
    "X17 X18 X20 X23 X24",
    f"""WITH {POSTS} SELECT doc_id,
  regexp_replace({"replace(" * len(X.CONTRACTIONS)}lower(post || ' it can''t we''re I''m they''d won''t'){"".join(f", '{k.replace(chr(39), chr(39) * 2)}', '{v}')" for k, v in X.CONTRACTIONS.items())}, 'https?://\\S+|www\\.\\S+', '[URL]', 'g') AS expanded,
  array_to_string(string_split(lower(post), ' '), '|') AS tokens, regexp_replace(post, '([.,!?;:])', ' \\1', 'g') AS spaced,
  substring(coalesce(text, ''), 1, 500) AS short, replace(coalesce(text, ''), chr(10), ' ') AS one_line FROM posts""",
)
def text_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    post = F.col("post")
    return posts(spark, sf_dir).select(
        "doc_id",
        X.expand_contractions(F.concat(post, F.lit(" it can't we're I'm they'd won't"))).alias("expanded"),
        F.array_join(F.split(F.lower(post), " "), "|").alias("tokens"),
        X.space_before_marks(post).alias("spaced"),
        F.substring(X.whole(F.col("text")), 1, 500).alias("short"),
        F.translate(X.whole(F.col("text")), "\n", " ").alias("one_line"),
    )


@query("X19")
def text_squeeze_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal characters become three; DuckDB's regular expressions have no back references."""
    return posts(spark, sf_dir).select("doc_id", X.squeeze_repeats(F.concat("post", F.lit(" sooooo goooood!!!!!!"))).alias("squeezed"))


@query(
    "X21 F11",
    f"""SELECT lang, CASE WHEN regexp_matches(t, '[\\x{{0900}}-\\x{{097F}}]') AND regexp_matches(lower(t), '\\b({"|".join(X.ENGLISH)})\\b') THEN 'mixed' WHEN regexp_matches(t, '[\\x{{0900}}-\\x{{097F}}]') THEN 'hi'
  WHEN regexp_matches(lower(t), '\\b({"|".join(X.ROMAN_HINDI)})\\b') THEN 'hinglish' ELSE 'en' END AS script, count(*) AS n
FROM (SELECT lang, coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN ' kya yaar' WHEN doc_id % 14 = 7 THEN ' would ' || chr(2361) WHEN doc_id % 7 = 0 THEN ' ' || chr(2361) ELSE '' END AS t FROM documents WHERE lang IN ('en', 'de') OR lang IS NULL)
GROUP BY 1, 2""",
)
def text_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("lang").isin("en", "de") | F.col("lang").isNull())
    more = F.when(F.col("doc_id") % 5 == 0, " kya yaar").when(F.col("doc_id") % 14 == 7, " would " + chr(2361)).when(F.col("doc_id") % 7 == 0, " " + chr(2361)).otherwise("")
    return docs.groupBy("lang", X.language_script(F.concat(X.whole(F.col("text")), more)).alias("script")).agg(F.count("*").alias("n"))


@query(
    "X26 X27",
    """WITH p AS (SELECT a.conv_id, a.turn, a.text AS x, b.text AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
w AS (SELECT *, list_distinct(list_filter(string_split(trim(regexp_replace(lower(x), '\\s+', ' ', 'g')), ' '), lambda s: s <> '')) AS u,
  list_distinct(list_filter(string_split(trim(regexp_replace(lower(y), '\\s+', ' ', 'g')), ' '), lambda s: s <> '')) AS v FROM p)
SELECT conv_id, turn, round(CASE WHEN len(u) > 0 AND len(v) > 0 THEN len(list_intersect(u, v)) / (len(u) + len(v) - len(list_intersect(u, v)))::DOUBLE ELSE 0.0 END, 6) AS jaccard,
  round(1 - len(list_intersect(u, v)) / greatest(len(u), 1)::DOUBLE, 6) AS changed FROM w""",
)
def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    later = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("y"))
    own = turns.select("conv_id", "turn", F.col("text").alias("x")).join(later, ["conv_id", "turn"])
    u, v = (F.array_distinct(X.words(F.lower(c))) for c in ("x", "y"))
    both = F.size(F.array_intersect(u, v))
    return own.select(
        "conv_id",
        "turn",
        F.round(X.word_jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"),
        F.round(1 - both / F.greatest(F.size(u), F.lit(1)), 6).alias("changed"),
    )


#: Replacements of the variant transforms.
STRONGER = {"good": "amazing", "bad": "terrible", "said": "screamed"}


@query(
    "X28 U07",
    f"""WITH {POSTS}, v AS (
  SELECT doc_id, 'punctuation' AS strategy, regexp_replace(post, '[.!]+', '!!!', 'g') AS variant FROM posts
  UNION ALL SELECT doc_id, 'exaggerate', replace(replace(replace(lower(post), 'good', 'amazing'), 'bad', 'terrible'), 'said', 'screamed') FROM posts
  UNION ALL SELECT doc_id, 'active', regexp_replace(post, '(\\w+) was (\\w+)ed by (\\w+)', '\\3 \\2ed \\1', 'g') FROM posts)
SELECT doc_id, min(strategy) AS strategy, variant FROM v GROUP BY doc_id, variant""",
)
def text_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic rewrites of a text for robustness tests, distinct by text."""
    low = F.lower("post")
    for a, b in STRONGER.items():
        low = F.replace(low, F.lit(a), F.lit(b))
    variants = F.array(
        F.struct(F.lit("punctuation").alias("strategy"), F.regexp_replace("post", "[.!]+", "!!!").alias("variant")),
        F.struct(F.lit("exaggerate").alias("strategy"), low.alias("variant")),
        F.struct(F.lit("active").alias("strategy"), F.regexp_replace("post", r"(\w+) was (\w+)ed by (\w+)", "$3 $2ed $1").alias("variant")),
    )
    rows = posts(spark, sf_dir).select("doc_id", F.explode(variants).alias("v")).select("doc_id", "v.*")
    return rows.groupBy("doc_id", "variant").agg(F.min("strategy").alias("strategy"))


@query(
    "X29",
    """WITH w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), ' '), lambda s: s <> '') AS ws FROM documents),
k AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM w)
SELECT doc_id, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (left(md5(doc_id || ':' || (i - 1)), 1) NOT IN ('0', '1')), '') AS augmented FROM k GROUP BY doc_id""",
)
def text_word_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop an eighth of the words, chosen by a hash of document and place, so that a rerun drops the same ones."""
    own = X.words(F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", own.alias("ws")).where(F.size("ws") > 0)
    keep = F.filter("ws", lambda w, i: ~F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":"), i.cast("string")).cast("binary")), 1, 1).isin("0", "1"))
    return docs.select("doc_id", F.array_join(keep, " ").alias("augmented"))


@query(
    "X31",
    """WITH r AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Sure: ```json {"label": ' || (event_id % 2) || ', "confidence": ' || (value / 100) || '} ``` done'
  WHEN 1 THEN '{"label": 1, "confidence": 0.5}' ELSE 'label: 1 because' END AS raw FROM events),
b AS (SELECT event_id, raw, CASE WHEN regexp_matches(raw, '\\{[^{}]*\\}') THEN regexp_extract(raw, '\\{[^{}]*\\}') END AS body FROM r)
SELECT event_id, coalesce(try_cast(json_extract_string(body, '$.label') AS INT), try_cast(nullif(regexp_extract(raw, 'label\\D{0,3}(\\d)', 1), '') AS INT), -1) AS label,
  round(least(greatest(coalesce(try_cast(json_extract_string(body, '$.confidence') AS DOUBLE), 0.0), 0.0), 1.0), 6) AS confidence FROM b""",
)
def text_judge_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label and confidence from a judge's reply: fenced JSON, JSON, else a pattern; clamped to [0, 1]."""
    k = F.col("event_id")
    fenced = F.concat(F.lit('Sure: ```json {"label": '), (k % 2).cast("string"), F.lit(', "confidence": '), (F.col("value") / 100).cast("string"), F.lit("} ``` done"))
    raw = F.when(k % 3 == 0, fenced).when(k % 3 == 1, F.lit('{"label": 1, "confidence": 0.5}')).otherwise("label: 1 because")
    body = F.nullif(F.regexp_extract("raw", r"\{[^{}]*\}", 0), F.lit(""))
    rows = table(spark, sf_dir, "events").select("event_id", raw.alias("raw")).withColumn("body", body)
    label = F.coalesce(
        F.get_json_object("body", "$.label").try_cast("int"), F.nullif(F.regexp_extract("raw", r"label\D{0,3}(\d)", 1), F.lit("")).try_cast("int"), F.lit(-1)
    )
    sure = F.coalesce(F.get_json_object("body", "$.confidence").try_cast("double"), F.lit(0.0))
    return rows.select("event_id", label.alias("label"), F.round(F.least(F.greatest(sure, F.lit(0.0)), F.lit(1.0)), 6).alias("confidence"))
