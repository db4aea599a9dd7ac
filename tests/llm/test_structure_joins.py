"""Periodic runs, conversation repair and the n-gram join against brute force, on whole tables, fixtures and odd cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from plain import TEXTS, components
from pyspark.sql import functions as F
from support import SF

from plumbline.llm import hot, jaccard, queries, repair, runs


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words_of(text: str | None) -> list[str]:
    return [w for w in re.split("[ \t-\r]+", text or "") if w]


# 11: periodic runs


def plain_runs(words: list, shortest: int = 12) -> list[tuple[int, int, int]]:
    """Start, length and smallest period of every run, lag by lag and word by word."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(shortest, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(i + 1, j)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapse(words: list, found: list) -> str:
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_words(chance: random.Random) -> list[str]:
    words = [chance.choice("abc" if chance.random() < 0.3 else "abcdefghij") for _ in range(chance.choice([0, 1, 11, 12, 13, 40, 200, 300]))]
    for _ in range(chance.randint(0, 3)):
        if len(words) > 4:
            p, a = chance.randint(1, len(words) // 3), chance.randrange(len(words))
            for i in range(a + p, min(len(words), a + chance.randint(0, p * 5))):
                words[i] = words[i - p]
    return words


@pytest.mark.parametrize(("long_bytes", "range_work"), [(1 << 20, 1 << 20), (0, 1000)])
def test_runs_both_ways(spark, long_bytes, range_work):
    chance = random.Random(1)
    own = {i: random_words(chance) for i in range(150)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in own.items()], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in runs.find_runs(df, long_bytes=long_bytes, range_work=range_work).collect()}
    assert len(got) == len(own) and sum(map(len, (r["runs"] for r in got.values()))) > 20
    for i, words in own.items():
        want = plain_runs(words)
        assert [tuple(r) for r in got[i]["runs"]] == want, words
        assert got[i]["n_words"] == len(words) and got[i]["collapsed"] == plain_collapse(words, want)


def planted(i: int, words: list[str]) -> list[str]:
    h, n = zlib.crc32(str(i).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (j - a) % p] for j in range(a, n)]


def test_op11(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op11_periodic_runs(spark, SF).collect()
    assert len(rows) == len(texts)
    for row in rows:
        words = planted(row["doc_id"], words_of(texts[row["doc_id"]]))
        found = runs._whole([" ".join(words).encode()])[0]
        if len(words) < 1500:
            assert found == plain_runs(words)
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
        milli = 1000 * best[1] // best[2] if found else None
        assert (row["n_runs"], row["start"], row["length"], row["period"], row["exponent_milli"]) == (len(found), *best, milli)
        assert row["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in found)) and row["collapsed_sha256"] == sha(plain_collapse(words, found))


def test_runs_odd_cases(spark, docs, empty):
    got = {r["doc_id"]: r for r in runs.find_runs(docs, long_bytes=2000).collect()}
    for i, text in enumerate(TEXTS):
        words = words_of(text)
        want = plain_runs(words) if len(words) < 1000 else None
        assert got[i]["n_words"] == len(words) and (want is None or [tuple(r) for r in got[i]["runs"]] == want)
    assert [tuple(r) for r in got[17]["runs"]] == [(0, 700, 1)] and got[17]["collapsed"] == "aaaa"
    assert runs.find_runs(empty).collect() == []
    odd = spark.createDataFrame([(None, "a " * 20, 1), (None, "a " * 20, 2), (7, None, 3)], "runs long, row string, __row long")
    found = runs.find_runs(odd, key="runs", text="row", long_bytes=10).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"]) for r in found) == [(0, 20), (0, 20), (7, 0)]


# 12: conversation repair


def plain_repair(turns: list[tuple]) -> dict:
    """Faults, the least cost and audit by comparing all edits forward, and the repaired turns."""
    seen, out, codes = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
    for _, role, text in turns:
        marks = [c for c in text if c not in " \t\n\x0b\x0c\r"]
        fault = "blank" if not marks else "duplicate" if (role, text) in seen else "" if marks[-1] in ".!?" else "truncated"
        seen.add((role, text))
        codes.append((role, text, fault))
        if fault:
            out[fault] += 1
    after = {"": ("u", "user"), "s": ("u", "user"), "u": ("a", "assistant"), "a": ("u", "user")}

    def inserted(best):
        best = dict(best)
        for _ in range(4):
            for state, (cost, audit, lines) in list(best.items()):
                to, role = after[state]
                new = (cost + 3, audit + "I", [*lines, f"{role}:"])
                if to not in best or new[:2] < best[to][:2]:
                    best[to] = new
        return best

    best = {"": (0, "", [])}
    for role, text, fault in codes:
        following = {}
        for state, (cost, audit, lines) in inserted(best).items():
            more, to = 3 * (fault == "truncated"), after[state]
            options = [(state, cost + 4, "D", [])]
            if fault not in ("blank", "duplicate"):
                options.append((to[0], cost + 3 + more, "R", [f"{to[1]}:{text}"]))
                if (role[:1], state) in {("s", ""), ("u", ""), ("u", "s"), ("u", "a"), ("a", "u")}:
                    options.append((role[:1], cost + more, "K", [f"{role}:{text}"]))
            for state_after, c, edit, line in options:
                new = (c, audit + edit, lines + line)
                if state_after not in following or new[:2] < following[state_after][:2]:
                    following[state_after] = new
        best = following
    cost, audit, lines = min((b for s, b in inserted(best).items() if s in ("", "a")), key=lambda b: b[:2])
    numbers = {t for t, _, _ in turns if t is not None}
    initials = [r[:1] for _, r, _ in turns]
    return out | {
        "gaps": max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, "cost": cost, "audit": audit, "repaired_sha256": sha("\n".join(lines)),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
    }


def test_least_repair_in_blocks():
    chance = random.Random(3)
    names, texts = ["system", "user", "assistant", "bot"], ["", "Yes.", "No", "So."]
    for _ in range(300):
        turns = [(i, chance.choice(names), chance.choice(texts) + str(chance.randint(0, 9)) * chance.choice([0, 1]) + chance.choice(["", "."])) for i in range(chance.choice([1, 2, 5, 9, 70]))]
        want, seen, codes = plain_repair(turns), set(), bytearray()
        for _, role, text in turns:
            codes.append(repair.GONE if not text or (role, text) in seen else repair.code(role[:1], text[-1] not in ".!?"))
            seen.add((role, text))
        for block in (1, 3, 64):
            assert repair.least_repair(bytes(codes), block) == (want["cost"], want["audit"])


def plain_damage(conv, turn, role, text) -> list[tuple]:
    role, text = (" " if x is None else x for x in (role, text))
    kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
    return [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)


def check_repaired(rows, found) -> None:
    """``found`` holds what the plain repair gives for the damaged ``rows`` (``conv_id, turn, role, text``)."""
    conversations = {}
    for conv, turn, role, text in rows:
        conversations.setdefault(conv, []).extend(plain_damage(conv, turn, role, text))
    assert {r["conv_id"] for r in found} == set(conversations) and len(found) == len(conversations)
    for row in found:
        turns = sorted(conversations[row["conv_id"]], key=lambda t: (t[0] is not None, t[0] or 0))
        want = plain_repair(turns) if turns else {"cost": 0, "audit": "", "repaired_sha256": sha(""), "gaps": 0}
        assert {k: row[k] for k in want} == want, turns


def test_op12(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check_repaired(rows, queries.op12_conversation_repair(spark, SF).collect())


def test_repair_odd_cases(spark, tmp_path):
    chance = random.Random(8)
    texts = [None, "", " \n", "Yes.", "Yes. ", "no end", "What?", "Ü🎉!", "a\nb."]
    rows = [(chance.choice([None, *range(60)]), None if i % 50 == 0 else 3 * i, chance.choice([None, "", "user", "assistant", "system", "User", "bot"]), chance.choice(texts)) for i in range(500)]
    rows += [(1000, i, "user" if i % 3 else "assistant", f"Turn {i}" + "." * (i % 5 > 0)) for i in range(400)]
    rows += [(1001, 5, "user", "Same.")] * 3 + [(1002, 0, "user", "x" * 300_000 + ".")]
    schema = "conv_id long, turn long, role string, text string, audit long, seen long, c long"
    spark.createDataFrame([(*r, 0, 0, 0) for r in rows], schema).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    check_repaired(rows, queries.op12_conversation_repair(spark, str(tmp_path)).collect())
    named = spark.createDataFrame([("a", "x", "user", "Hi."), ("a", "y", "assistant", "Yo.")], "conv_id string, turn string, role string, text string")
    assert [(r["conv_id"], r["gaps"], r["cost"], r["audit"]) for r in repair.repair(named).collect()] in ([("a", 0, 0, "KK")], [("a", 0, 6, "IKKI")])
    assert repair.repair(spark.createDataFrame([], schema)).collect() == []


# 13: n-gram join


def gram_set(text: str | None, k: int = 4) -> frozenset:
    words = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def alike(a: frozenset, b: frozenset, percent: int = 85) -> bool:
    return bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)


def plain_join(texts: dict, percent: int = 85) -> dict:
    sets = {i: gram_set(t) for i, t in texts.items()}
    return components(sorted(texts), lambda a, b: alike(sets[a], sets[b], percent))


def test_op13(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op13_ngram_jaccard(spark, SF).collect()}
    assert len(got) == len(texts)
    for i, component in plain_join(texts).items():
        assert (got[i]["n_shingles"], got[i]["component_id"]) == (len(gram_set(texts[i])), component)


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_sets_that_link_share_a_sum(percent):
    chance, pairs = np.random.default_rng(percent), 0
    for _ in range(150):
        sets = []
        for n in (1, 5, 6, 7, 12, 40, 63, 200, 900):
            a = chance.integers(0, 2**64 - 1, size=n, dtype=np.uint64)
            gone, new = int(chance.integers(0, n // 4 + 1)), int(chance.integers(0, n // 4 + 2))
            sets += [np.unique(a), np.unique(np.append(a[gone:], chance.integers(0, 2**64 - 1, size=new, dtype=np.uint64)))]
        bounds = np.cumsum([0, *map(len, sets)])
        own, _, value = jaccard.part_sums(np.concatenate(sets), bounds, percent)
        sums = [set(value[own == i].tolist()) for i in range(len(sets))]
        for i in range(0, len(sets), 2):
            if alike(frozenset(sets[i].tolist()), frozenset(sets[i + 1].tolist()), percent):
                pairs += 1
                assert sums[i] & sums[i + 1]
    assert pairs > 50


def test_tiles_link_as_all_pairs():
    chance = random.Random(2)
    for _ in range(60):
        base = chance.sample(range(400), 40)
        sets = [frozenset(chance.sample(base, chance.randint(34, 40)) + chance.sample(range(400, 440), chance.randint(0, 5))) for _ in range(20)]
        codes, bounds = np.concatenate([np.array(sorted(s)) for s in sets]), np.cumsum([0, *map(len, sets)])
        for pivots, others in ((20, 0), (7, 7), (1, 1)):
            met = {(i, j) for i in range(pivots) for j in range(others, 20) if alike(sets[i], sets[j])}
            links = jaccard.link_tile(codes, bounds, pivots, others)
            assert set(links) <= met
            either = [components(list(range(20)), lambda a, b, e=e: (a, b) in e or (b, a) in e) for e in (met, set(links))]
            assert either[0] == either[1]


def test_join_of_chains_and_a_frequent_group(spark, monkeypatch):
    """A third of all sets are near copies of one text, some only by way of others; and slices hold many of them."""
    monkeypatch.setattr(hot, "LEAST", 5)
    chance, texts = random.Random(4), {}
    words = [f"w{i}" for i in range(120)]
    for i in range(60):
        own = list(words)
        for at in chance.sample(range(120), chance.randint(0, 4)):
            own[at] = f"x{i}.{at}"
        texts[i] = " ".join(own)
    for i in range(60, 180):
        texts[i] = " ".join(words[:55] + [f"y{i}.{j}" for j in range(chance.randint(0, 60))] if i % 3 else [f"z{i % 40}.{j}" for j in range(i % 40)])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(df).collect()}
    assert got == plain_join(texts) and 1 < len(set(got.values())) < 150


def test_join_odd_cases(spark, docs, empty):
    got = {r["doc_id"]: r for r in jaccard.jaccard_components(docs).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == plain_join(dict(enumerate(TEXTS)))
    assert jaccard.jaccard_components(empty).collect() == []
    odd = [(None, "a b c d e", 1), (None, "A b c d e", 2), (4, "a  b c d e", 3), (None, None, 4), (None, "one alone", 5), (9, "", 6)]
    found = jaccard.jaccard_components(spark.createDataFrame(odd, "node string, band string, short long").select(F.col("node").alias("copies"), F.col("band").alias("value"), "short"), key="copies", text="value")
    assert sorted((r["doc_id"] or "", r["n_shingles"], r["component_id"] or "") for r in found.collect()) == [("", 0, ""), ("", 1, ""), ("", 2, "4"), ("", 2, "4"), ("4", 2, "4"), ("9", 0, "9")]


def test_join_by_key_keeps_all_rows(spark, monkeypatch):
    monkeypatch.setattr(hot, "LEAST", 3)
    rows = spark.createDataFrame([("a",)] * 9 + [("b",)] * 2 + [(None,), ("c",)], "k string")
    table = spark.createDataFrame([("a", 1, 9), ("b", 2, 2)], "k string, v int, copies long")
    got = sorted((r["k"] or "", r["v"] or 0) for r in hot.join_by_key(rows, table, "k").collect())
    assert got == sorted([("a", 1)] * 9 + [("b", 2)] * 2 + [("", 0), ("c", 0)])


# hot keys of earlier operators


@pytest.mark.parametrize("owners", [1, 256, 65_536])
def test_directory_does_not_grow_with_owners(spark, owners):
    """2000 hashes of one owner's range need a directory of the same order, however narrow the range is."""
    from plumbline.llm import exact_dedup

    chance = random.Random(owners)
    first = (owners // 3) * 2**64 // owners
    hashes = sorted(first + chance.randrange(2**64 // owners) for _ in range(2000))
    df = spark.createDataFrame([(h - (h >> 63 << 64),) for h in hashes], "h long")
    table = exact_dedup.ExtendibleHash()
    for row in df.select("h", exact_dedup._slot_hash("h").alias("slot")).collect():
        table.add(row["slot"] & (1 << 64) - 1, (row["h"],))
    assert len(table.directory) <= 32 and sum(len(b["entries"]) for b in table.buckets) == 2000


def test_a_third_of_all_rows_share_a_text_and_a_line(spark, monkeypatch):
    from plumbline.llm import exact_dedup, line_dedup, near_dedup

    monkeypatch.setattr(hot, "LEAST", 3)
    common, line = " ".join(f"w{i}" for i in range(30)), "a line that very many documents have in common"
    texts = {i: common if i % 3 == 0 else f"{line}\nown {i} text of document {i}" if i % 3 == 1 else " ".join(f"v{i}.{j}" for j in range(12)) for i in range(90)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    near = {r["doc_id"]: r for r in near_dedup.near_duplicates(df).collect()}
    assert {i for i, r in near.items() if r["kept"]} == {i for i in texts if i == 0 or i % 3} and all(near[i]["component_id"] == 0 for i in texts if i % 3 == 0)
    copies = {r["doc_id"]: r for r in exact_dedup.lookup(df, exact_dedup.build_index(df)).collect()}
    assert all((copies[i]["keep_id"], copies[i]["group_size"]) == (0, 30) for i in texts if i % 3 == 0)
    lines = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert lines == {i: t if i % 3 == 2 or i < 2 else "" if i % 3 == 0 else f"own {i} text of document {i}" for i, t in texts.items()}
