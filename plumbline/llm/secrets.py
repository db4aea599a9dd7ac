"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong parts are reported wherever they are: assignments of secrets, access keys and long hexadecimal runs. Weak parts
(a bare 40-character key, a user name, an endpoint) are everywhere in harmless text, so they are reported only when the
parts that complete them to a credential stand near: within ``WINDOW`` characters and in the same scope, a block without
a blank line. That is an interval semi-join of a document's parts with each other: parts are intervals, and two are joined
if the gap between them is at most the window. Of the parts before one in its scope the one that ends last is the nearest,
of those after it the one that starts first; so the join runs as two ordered passes over each document's parts, which carry
the largest end and the next start, and no pairs are made.

Rules: a bare key needs an identifier (access key or user); a user needs a secret (assignment or bare key); an endpoint
needs both. A weak part inside a reported strong one is part of it.

Defined cases: a null text is an empty one; repeated rows are reported as often as they occur, and null or repeated keys
change nothing, as each row's parts are numbered by row; parts that overlap are at no distance; other columns are not read
(``redact`` keeps them, whatever their names); an empty table gives no rows; texts are scanned whole, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.storage import fresh

WINDOW = 400
CHUNK = 256


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), either_case("api") + "_?" + either_case("key")])
_USERS = "|".join([*map(either_case, ("username", "user", "login", "account")), either_case("client") + "_?" + either_case("id")])
_SEPARATOR = r"""["']?\x20*[:=]\x20*["']?"""
#: Kinds in the order in which spans of one start are listed. Kind: (pattern, least length of the match).
STRONG = {
    "assign": (f"({_NAMES}){_SEPARATOR}([A-Za-z0-9+/_.=-]+)", 0),
    "access": ("AKIA[A-Z0-9]+", 20),
    "hex": ("[0-9a-f]{24,}", 24),
}
WEAK = {
    "key40": (r"[A-Za-z0-9/+]{40,}", 40),
    "user": (f"({_USERS}){_SEPARATOR}([A-Za-z0-9@._-]{{3,}})", 0),
    "endpoint": (r"""[a-z][a-z0-9+]*://[^\s"'<>]+""", 0),
}
#: What completes weak parts; a user is an identifier and a bare key a secret.
IDENTIFIERS, SECRETS = ("access", "user"), ("assign", "key40")
BREAK = r"\n[\x20\t\r]*\n"
LEAST_ASSIGNED = 6
SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def running_sums(values: Column) -> Column:
    """The sums of all values before each and of all, in blocks, so that the work stays near linear."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")), lambda c: F.slice(values, c * CHUNK + 1, CHUNK))
    zero = F.array(F.lit(0).cast("long"))
    sums = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))))
    bases = F.aggregate(sums, zero, lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.element_at(x, -1))))
    return F.flatten(F.transform(sums, lambda s, i: F.transform(F.slice(s, 1, F.size(s) - 1), lambda v: v + F.get(bases, i))))


def spans_of(text: Column, kind: str, pattern: str, rank: int) -> Column:
    """Leftmost non-overlapping matches with their places in code points; no element for a text without a match.

    The text is what lies between the matches and the matches in turn, so running sums of their lengths are the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(gaps, found, lambda g, m: F.length(g).cast("long") + F.coalesce(F.length(m), F.lit(0)))
    own = F.zip_with(
        F.slice(running_sums(steps), 1, F.size(found)),
        F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("g"), found.alias("m")),
        lambda at, x: F.struct(
            (at + F.length(x["g"])).alias("start"),
            F.lit(rank).alias("rank"),
            F.lit(kind).alias("kind"),
            (at + F.length(x["g"]) + F.length(x["m"])).alias("end"),
            x["m"].alias("m"),
        ),
    )
    return F.when(F.size(found) > 0, own).otherwise(F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,m:string>>"))


def _at_least(spans: Column, length: int) -> Column:
    return F.filter(spans, lambda s: F.length(s["m"]) >= length)


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _parts(text: Column, kinds: dict[str, tuple[str, int]], first: int) -> Column:
    out = []
    for rank, (kind, (pattern, least)) in enumerate(kinds.items(), first):
        own = spans_of(text, kind, pattern, rank)
        if kind == "assign":
            own = F.filter(own, lambda s: F.length(F.regexp_extract(s["m"], STRONG["assign"][0], 2)) >= LEAST_ASSIGNED)
        elif kind == "key40":
            own = F.filter(own, lambda s: F.length(s["m"]) == 40)
        elif least:
            own = _at_least(own, least)
        out.append(F.transform(own, lambda s: F.struct(s["start"], s["rank"], s["kind"], s["end"])))
    return F.concat(*out)


def _any(parts: Column, *kinds: str) -> Column:
    return F.exists(parts, lambda s: s["kind"].isin(*kinds))


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key``, ``text_hash long``, and the arrays ``base`` and ``spans`` of
    ``start, rank, kind, end`` in order of start and kind; ``spans`` has the linked weak parts too.

    Texts are read once and not shuffled: what is dealt by document is its parts.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("k"), F.xxhash64(body).alias("h"), body.alias("body"))
    base, weak = F.sort_array(_parts(F.col("body"), STRONG, 0)), _parts(F.col("body"), WEAK, len(STRONG))
    rows = rows.select("row", "k", "h", "body", base.alias("base"), weak.alias("weak"))
    every = F.concat("base", "weak")
    identified, secret = _any(every, *IDENTIFIERS), _any(every, *SECRETS)
    linkable = (F.size("weak") > 0) & ((_any(F.col("weak"), "key40") & identified) | (_any(F.col("weak"), "user") & secret) | (identified & secret))
    breaks = F.transform(spans_of(F.col("body"), "break", BREAK, -1), lambda s: F.struct(s["start"], s["rank"], s["kind"], s["end"]))
    parts = F.when(linkable, F.concat(every, breaks)).otherwise(F.array().cast(SPAN))
    rows = rows.select("row", "k", "h", "base", F.posexplode_outer(parts).alias("i", "s"))
    first = F.coalesce("i", F.lit(0)) == 0
    rows = rows.select("row", "k", "h", F.when(first, F.col("base")).alias("base"), "s", "s.start", "s.rank", "s.kind", "s.end")

    in_order = Window.partitionBy("row").orderBy("start", "rank", "end")
    rows = rows.withColumn("scope", F.count_if(F.col("kind") == "break").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.partitionBy("row", "scope").orderBy("start", "rank", "end").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row", "scope").orderBy("start", "rank", "end").rowsBetween(1, Window.unboundedFollowing)
    seen = {"covered": F.max(F.when(F.col("rank").between(0, len(STRONG) - 1), F.col("end"))).over(before)}
    for name, kinds in (("identifier", IDENTIFIERS), ("secret", SECRETS)):
        mine = F.col("kind").isin(*kinds)
        seen |= {f"{name}_end": F.max(F.when(mine, F.col("end"))).over(before), f"{name}_start": F.min(F.when(mine, F.col("start"))).over(after)}
    rows = rows.withColumns(seen)

    def near(name: str) -> Column:
        left, right = F.col("start") - F.col(f"{name}_end") <= WINDOW, F.col(f"{name}_start") - F.col("end") <= WINDOW
        return F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False))

    wanted = F.when(F.col("kind") == "key40", near("identifier")).when(F.col("kind") == "user", near("secret"))
    wanted = wanted.when(F.col("kind") == "endpoint", near("identifier") & near("secret")).otherwise(False)
    linked = F.when(wanted & (F.coalesce("covered", F.lit(-1)) < F.col("end")), F.col("s"))
    out = rows.groupBy("row").agg(F.first("k").alias("k"), F.first("h").alias("h"), F.first("base", True).alias("base"), F.collect_set(linked).alias("linked"))
    return out.select(F.col("k").alias(key), F.col("h").alias("text_hash"), "base", F.sort_array(F.concat("base", "linked")).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digests of ``scan``'s rows."""
    counts = [_count("base", kind).alias(f"n_{kind}") for kind in STRONG]
    return found.select(key, *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, *, key: str = "doc_id", text: str = "text", mask: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every reported span replaced by ``mask``; spans that touch or overlap become one."""
    k, h, own = (fresh(docs.columns, n) for n in ("__k", "__h", "__spans"))
    found = scan(docs, key=key, text=text).where(F.size("spans") > 0).groupBy(F.col(key).alias(k), F.col("text_hash").alias(h))
    found = found.agg(F.first("spans").alias(own))
    body = F.col(text)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        piece = F.when(s["start"] > a["at"], F.array(body.substr((a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mask)))
        piece = piece.when(F.size(a["out"]) == 0, F.array(F.lit(""), F.lit(mask))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], piece).alias("out"))

    masked = F.aggregate(own, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(body, (a["at"] + 1).cast("int"), F.length(body))))
    joined = docs.join(found, F.col(key).eqNullSafe(F.col(k)) & (F.xxhash64(F.coalesce(body, F.lit(""))) == F.col(h)), "left")
    return joined.select(*(F.when(F.col(own).isNotNull(), masked).otherwise(body).alias(c) if c == text else F.col(c) for c in docs.columns))
