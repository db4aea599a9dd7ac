"""The registered queries without SQL over whole tables, row by row against brute force or the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from plain import dedup_lines, near_components, shingle_set
from support import SF
from test_llm import BYTE, WORD, base_spans, check_packing, ids_of, library  # noqa: F401

from plumbline.llm import media, queries, secrets


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows_of(spark, name):
    rows = queries.queries()[name](spark, SF).collect()
    return {r["doc_id"]: r for r in rows}, len(rows)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def linked_spans(text):
    """All spans by comparing every part with every other."""
    ranks = {kind: i for i, kind in enumerate([*secrets.STRONG, *secrets.WEAK])}
    strong = [(s, ranks[k], k, e) for k, s, e in base_spans(text)]
    weak = []
    for kind, (pattern, _) in secrets.WEAK.items():
        found = [m for m in re.finditer(pattern, text, re.ASCII) if kind != "key40" or len(m[0]) == 40]
        weak += [(m.start(), ranks[kind], kind, m.end()) for m in found]
    breaks = [m.start() for m in re.finditer(secrets.BREAK, text)]
    every = strong + weak

    def near(part, kinds):
        for other in every:
            apart = max(part[0], other[0]) - min(part[3], other[3])
            same = sum(b <= part[0] for b in breaks) == sum(b <= other[0] for b in breaks)
            if other != part and other[2] in kinds and same and apart <= secrets.WINDOW:
                return True
        return False

    def wanted(part):
        identified, secret = near(part, secrets.IDENTIFIERS), near(part, secrets.SECRETS)
        complete = {"key40": identified, "user": secret, "endpoint": identified and secret}[part[2]]
        return complete and not any(s[0] <= part[0] and part[3] <= s[3] for s in strong)

    return [(s, k, e) for s, _, k, e in sorted(strong + [p for p in weak if wanted(p)])]


def random_text(chance):
    key = lambda n: "".join(chance.choices("kV7/+", k=n))
    parts = {
        "assign": lambda: "token=" + key(chance.choice([3, 6, 40, 46, 500])) + chance.choice(["", ".", ".user=inside"]),
        "access": lambda: "AKIA" + "B7" * chance.choice([5, 8, 20]),
        "hex": lambda: "ab1" * chance.choice([6, 8, 14]),
        "key40": lambda: key(chance.choice([39, 40, 40, 40, 41])),
        "user": lambda: chance.choice(["user=", "login: ", 'clientId="']) + chance.choice(["al", "alice", "a" * 300]),
        "endpoint": lambda: "https://" + chance.choice(["h.x/", "u:token=abcdefgh@h/", "h/" + "p" * 380]),
        "break": lambda: chance.choice(["\n\n", "\n \t\n", "\n"]),
        "other": lambda: chance.choice([" ", " é🎉 ", " z" * 100, " z" * 198, " z" * 200]),
    }
    return "".join(parts[chance.choice(list(parts))]() + chance.choice(["", " ", " ", "\n"]) for _ in range(chance.randint(2, 14)))


def test_secrets_link_as_all_pairs(spark):
    chance = random.Random(11)
    own = {i: random_text(chance) for i in range(400)}
    df = spark.createDataFrame(list(own.items()), "doc_id long, text string").repartition(5)
    kinds = set()
    for row in secrets.scan(df).collect():
        want = linked_spans(own[row["doc_id"]])
        assert [(s["start"], s["kind"], s["end"]) for s in row["spans"]] == want, own[row["doc_id"]]
        kinds |= {k for _, k, _ in want}
    assert kinds == {*secrets.STRONG, *secrets.WEAK}


def test_op1(spark, texts):
    got, n = rows_of(spark, "op1_secret_scan")
    assert n == len(texts)
    for i, text in texts.items():
        base, row = base_spans(text), got[i]
        assert [row[f"n_{k}"] for k in secrets.STRONG] == [sum(b[0] == k for b in base) for k in secrets.STRONG]
        assert row["base_sha256"] == sha(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode())
        assert row["spans"] == ",".join(f"{k}:{s}:{e}" for s, k, e in linked_spans(text or ""))


def test_op3_and_op4(spark, texts, library):  # noqa: F811
    encoded, n = rows_of(spark, "op3_bpe_lexicon")
    stored, m = rows_of(spark, "op4_binary_ids")
    assert n == m == len(texts)
    start = 0
    for i in sorted(texts):
        ids = ids_of(library, BYTE, texts[i])
        decoded = library[BYTE].decode(ids, skip_special_tokens=False)
        assert encoded[i]["n_tokens"] == len(ids) and encoded[i]["ids_sha256"] == sha(np.array(ids, "<u4").tobytes())
        assert encoded[i]["decoded_sha256"] == sha(decoded.encode())
        whole = np.array([*ids, 2], "<u4")
        assert (stored[i]["start"], stored[i]["n_tokens"], stored[i]["ids_crc32"]) == (start, len(whole), zlib.crc32(whole.tobytes()))
        start += len(whole)


def test_op5(spark, texts, library):  # noqa: F811
    rows = queries.op5_best_two_fit(spark, SF).collect()
    pieces, total = {(r["doc_id"], r["piece"]): r for r in rows}, 0
    for i, text in texts.items():
        ids = np.array([*ids_of(library, WORD, text), 0], "<u4")
        for piece, at in enumerate(range(0, len(ids), 2048)):
            own, row = ids[at : at + 2048], pieces.pop((i, piece))
            assert (row["start"], row["length"], row["ids_crc32"]) == (at, len(own), zlib.crc32(own.tobytes()))
        total += len(ids)
    assert not pieces
    assert check_packing(rows, 2048) <= 1.02 * -(-total // 2048) + 1


def test_op6(spark, texts):
    got, n = rows_of(spark, "op6_line_dedup")
    assert n == len(texts)
    for i, kept in dedup_lines(texts).items():
        before, after = (texts[i] or "").count("\n") + 1, (kept or "").count("\n") + 1
        assert (got[i]["n_lines"], got[i]["kept_chars"], got[i]["kept_sha256"]) == (before, len(kept or ""), sha((kept or "").encode()))
        assert got[i]["n_dropped"] == before - after or (not kept and got[i]["n_dropped"] == before)


def test_op7(spark, texts):
    got, n = rows_of(spark, "op7_near_dedup")
    assert n == len(texts)
    for i, component in near_components(texts).items():
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(shingle_set(texts[i])), component, i == component)


def test_op8(spark, texts):
    got, n = rows_of(spark, "op8_toxicity")
    assert n == len(texts)
    by_text = {}
    for i, text in texts.items():
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= got[i]["score"] <= 1 and got[i]["predicted"] == (got[i]["score"] >= 0.5)
        assert by_text.setdefault(text or "", got[i]["score"]) == got[i]["score"]


def test_op9(spark, texts):
    got, n = rows_of(spark, "op9_media_flac")
    assert n == len(texts)
    by_text = {}
    for i, text in texts.items():
        data, row = (text or "").encode(), got[i]
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert (row["n_bytes"], row["payload_bytes"], row["payload_sha256"]) == (len(data), len(payload), sha(payload))
        assert row["tail_crc32"] == zlib.crc32(payload[-32:]) and row["feature"] == media.features(payload, row["media_bytes"])
        assert by_text.setdefault(text or "", row["media_sha256"]) == row["media_sha256"]
