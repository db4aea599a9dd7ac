"""Byte-pair encoding with a minimal acyclic transducer for frequent words, and exact merges for all others.

The lexicon holds frequent words and their ids. Its words form a minimal acyclic automaton: equal suffixes share states, and
each edge knows how many words come before those it leads to, so that walking a word adds up to its number, and the
number selects its ids. All of it is a few flat arrays in one file that workers memory-map. Words are walked many at a
time: one step takes the next byte of every word still on its way.

A word the lexicon lacks is merged by the vocabulary's ranks: in each round every word merges the pair of lowest rank it
has. Since a merge only makes pairs of higher ranks than its own, that is the order of the merges one by one.

Defined cases: null counts as empty and has no ids; special strings inside a text have their own id, as in the tokenizers
library; a text of any length is one row. Of words of equal frequency those of the last level may all enter or none, which changes no
ids. Repeated rows give a row each; other columns are not read, so they may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.storage import materialize, new_path, write_file
from plumbline.llm.words import Vocabulary, byte_letters, ragged_take, text_slices

#: Distinct words of the corpus that the lexicon takes, by frequency; each with and without a leading space.
LEXICON_WORDS = 50_000
#: Bytes from which a word is merged by a heap, on its own: so long a word would need too many rounds.
LONG_WORD = 256
NONE = np.int32(2**31 - 1)


class Merges:
    """The merges of a byte-level vocabulary, and of words by them."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        letters = byte_letters()
        self.bytes = np.array([vocab[x] for x in letters], np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        keys = left << 20 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        plain = {c: b for b, c in enumerate(letters)}
        tokens = {i: bytes(plain[c] for c in t) for t, i in vocab.items()}
        tokens |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        # The bytes of every id, for decoding.
        size = max(tokens) + 1
        self.token_lengths = np.array([len(tokens.get(i, b"")) for i in range(size)], np.int64)
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths
        self.token_bytes = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(size)), np.uint8)
        self._rank: dict[int, int] | None = None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as bytes: all ids, and the number of each word's."""
        lengths = np.diff(bounds)
        long = np.flatnonzero(lengths > LONG_WORD)
        short = np.flatnonzero(lengths <= LONG_WORD)
        flat, ends = ragged_take(data, bounds[short], lengths[short])
        ids, counts = self._rounds(self.bytes[flat], ends)
        if not len(long):
            return ids, counts
        rows: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(lengths)
        for i, row in zip(short.tolist(), np.split(ids, np.cumsum(counts)[:-1]) if len(short) else [], strict=True):
            rows[i] = row
        for i in long.tolist():
            rows[i] = self._heap(data[bounds[i] : bounds[i + 1]])
        return np.concatenate(rows), np.array(list(map(len, rows)), np.int32)

    def _rounds(self, symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = len(ends) - 1
        out, counts = [], np.zeros(words, np.int32)
        places = []
        own = np.flatnonzero(np.diff(ends) > 0)
        word = np.repeat(np.arange(words), np.diff(ends))
        while len(symbols):
            # word: ascending; a word's last symbol has no pair
            last = np.ones(len(symbols), bool)
            last[:-1] = word[1:] != word[:-1]
            ranks = np.full(len(symbols), NONE)
            at = np.flatnonzero(~last)
            ranks[at] = self.rank(symbols[at], symbols[at + 1])
            starts = np.flatnonzero(np.concatenate([[True], last[:-1]]))
            least = np.minimum.reduceat(ranks, starts)
            sizes = np.diff(np.concatenate([starts, [len(symbols)]]))
            open_ = np.repeat(least != NONE, sizes)
            if not open_.all():  # finished words leave
                done = ~open_
                out.append(symbols[done])
                places.append(word[done])
                symbols, word, ranks, last = symbols[open_], word[open_], ranks[open_], last[open_]
                sizes, least = sizes[least != NONE], least[least != NONE]
                if not len(symbols):
                    break
            hit = ranks == np.repeat(least, sizes)
            # Of pairs that overlap (one symbol repeated), every other one from the left.
            begins = hit.copy()
            begins[1:] &= ~hit[:-1]
            index = np.arange(len(hit))
            hit &= (index - np.maximum.accumulate(np.where(begins, index, 0))) % 2 == 0
            at = np.flatnonzero(hit)
            symbols = symbols.copy()
            symbols[at] = self.made[ranks[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not out:
            return np.zeros(0, np.uint32), counts
        ids, places = np.concatenate(out), np.concatenate(places)
        counts[own] = np.bincount(places, minlength=words)[own]
        return ids[np.argsort(places, kind="stable")].astype(np.uint32), counts

    def _heap(self, data: np.ndarray) -> np.ndarray:
        """One long word: a heap of its pairs by rank and place, over a doubly linked list of symbols."""
        if self._rank is None:
            self._rank = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        rank, made = self._rank, self.made
        symbols = self.bytes[data].tolist()
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank.get(symbols[i] << 20 | symbols[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if symbols[i] == a else -1
            if j < 0 or symbols[j] != b:
                continue
            symbols[i], symbols[j] = int(made[r]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (s := rank.get(symbols[x] << 20 | symbols[y])) is not None:
                    heapq.heappush(heap, (s, x, symbols[x], symbols[y]))
        return np.array([s for s in symbols if s >= 0], np.uint32)


def build_automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of sorted distinct words, as arrays of its edges; state 0 is its root.

    Edges are sorted by ``key`` (state * 256 + byte). ``skip`` counts the words that precede, in order, those below the
    edge and share its state, so that a word's number is the sum of its edges' skips.
    """
    register: dict[tuple, int] = {}
    final: list[bool] = []
    edges: list[tuple[tuple[int, int], ...]] = []
    below: list[int] = []
    path: list[list] = [[False, []]]  # unfinished states: final, [(byte, state)]

    def freeze(state: list) -> int:
        key = (state[0], tuple(state[1]))
        if (own := register.get(key)) is None:
            own = register[key] = len(final)
            final.append(state[0])
            edges.append(key[1])
            below.append(state[0] + sum(below[t] for _, t in key[1]))
        return own

    previous = b""
    for word in words:
        common = 0
        for x, y in zip(previous, word):
            if x != y:
                break
            common += 1
        for i in range(len(previous), common, -1):
            path[i - 1][1].append((previous[i - 1], freeze(path.pop())))
        path += [[False, []] for _ in range(len(word) - common)]
        path[-1][0] = True
        previous = word
    for i in range(len(previous), 0, -1):
        path[i - 1][1].append((previous[i - 1], freeze(path.pop())))
    root = freeze(path[0])
    number = np.arange(len(final))
    number[[0, root]] = number[[root, 0]]  # the root gets 0
    rows = []
    for state, own in enumerate(edges):
        skip = int(final[state])
        for byte, target in own:
            rows.append((int(number[state]) << 8 | byte, int(number[target]), skip))
            skip += below[target]
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    ends = np.zeros(len(final), bool)
    ends[number] = final
    return {"key": table[:, 0].copy(), "target": table[:, 1].astype(np.int32), "skip": table[:, 2].astype(np.int32), "final": ends}


def walk(automaton: dict[str, np.ndarray], data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The number of each word in the automaton, -1 for a word it lacks."""
    starts, lengths = bounds[:-1], np.diff(bounds)
    out, state, number = np.full(len(lengths), -1, np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    key, target, skip, final = (automaton[k] for k in ("key", "target", "skip", "final"))
    open_ = np.flatnonzero(lengths > 0) if len(key) else np.zeros(0, np.int64)
    step = 0
    while len(open_):
        wanted = state[open_] << 8 | data[starts[open_] + step]
        at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        there = key[at] == wanted
        open_, at = open_[there], at[there]
        number[open_] += skip[at]
        state[open_] = target[at]
        step += 1
        done = lengths[open_] == step
        ended = open_[done]
        ended = ended[final[state[ended]]]
        out[ended] = number[ended]
        open_ = open_[~done]
    return out


def compile_lexicon(words: list[str], merges: Merges) -> bytes:
    """The lexicon's file: automaton, and ids by word number. Arrays are aligned, so that they can be mapped in place."""
    own = sorted({w.encode() for w in words if w})
    bounds = np.concatenate([[0], np.cumsum(list(map(len, own)))]).astype(np.int64)
    ids, counts = merges.merge(np.frombuffer(b"".join(own), np.uint8), bounds)
    arrays = build_automaton(own) | {"ids": ids, "ids_end": np.cumsum(counts, dtype=np.int64), "ids_count": counts}
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode()
    text = len(text).to_bytes(8, "little") + text
    text += b"\0" * (-len(text) % 64)
    return text + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 64) for a in arrays.values())


def open_lexicon(path: str) -> dict[str, np.ndarray]:
    """Map a lexicon's file; its pages are shared by all workers of a machine."""
    data = np.memmap(path, np.uint8, mode="r")
    size = int.from_bytes(data[:8].tobytes(), "little")
    head = json.loads(data[8 : 8 + size].tobytes())
    begin = -(-(8 + size) // 64) * 64
    return {k: np.frombuffer(data, t, n, begin + at) for k, (t, n, at) in head.items()}


class LexiconWords:
    """Ids of single words: by the lexicon where it has them, else by merging."""

    def __init__(self, lexicon: dict[str, np.ndarray], merges: Merges) -> None:
        self.lexicon, self.merges = lexicon, merges

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        column = pa.array(words, pa.large_string())
        bounds = np.frombuffer(column.buffers()[1], np.int64)[: len(words) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        number = walk(self.lexicon, data, bounds)
        known = number >= 0
        counts = np.zeros(len(words), np.int32)
        counts[known] = self.lexicon["ids_count"][number[known]]
        other = np.flatnonzero(~known)
        flat, ends = ragged_take(data, bounds[other], np.diff(bounds)[other])
        merged, counts[other] = self.merges.merge(flat, ends)
        begin = np.zeros(len(words), np.int64)
        table = np.concatenate([self.lexicon["ids"], merged])
        begin[known] = self.lexicon["ids_end"][number[known]] - counts[known]
        begin[other] = len(self.lexicon["ids"]) + np.cumsum(counts[other]) - counts[other]
        return ragged_take(table, begin, counts)[0].astype(np.uint32), counts


def frequent_words(docs: DataFrame, most: int = LEXICON_WORDS, *, text: str = "text") -> list[str]:
    """The most frequent words of all documents, cut at white space and common marks; at most ``most``, in no order.

    Words are counted by Spark; the driver sees how many words there are at each level of frequency (eight levels to a
    doubling, a few hundred rows), chooses the lowest level that fits, and fetches the words from there up.
    """
    words = docs.select(F.explode(F.split(F.col(text), r"[\s,.;:!?]+")).alias("w")).where("w <> ''")
    level = F.floor(F.log2("count") * 8).cast("int")
    counts = materialize(words.groupBy("w").count().where("count > 1").select("w", level.alias("level")), "word-counts")
    total, cut = 0, None
    for row in sorted(counts.groupBy("level").count().collect(), key=lambda r: -r["level"]):
        total += row["count"]
        if total > most:
            break
        cut = row["level"]
    return [] if cut is None else [r[0] for r in counts.where(F.col("level") >= cut).select("w").collect()]


def ship_lexicon(spark: SparkSession, words: list[str], tokenizer: str) -> str:
    """Compile a lexicon of ``words``, each with and without a leading space, into the shared folder; Spark copies the file
    from there to every executor, a new one too."""
    data = compile_lexicon([*words, *(" " + w for w in words)], Merges(tokenizer))
    path = f"{new_path(spark, 'lexicon')}.bin"
    write_file(path, data)
    spark.sparkContext.addFile(path)
    return path.rpartition("/")[2]


def encode(docs: DataFrame, tokenizer: str, lexicon: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_tokens long`` and ``ids binary`` (little-endian unsigned 32-bit) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(tokenizer, LexiconWords(open_lexicon(SparkFiles.get(lexicon)), Merges(tokenizer)))
        for batch in batches:
            at = 0
            for texts in text_slices(batch.column(1).to_pylist()):
                ids, bounds = words.encode(texts)
                own = pa.Array.from_buffers(
                    pa.large_binary(), len(texts), [None, pa.py_buffer((bounds * 4).astype(np.int64)), pa.py_buffer(ids.astype("<u4"))]
                ).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(np.diff(bounds)), own], names=[key, "n_tokens", "ids"]
                )
                at += len(texts)

    rows = docs.select(F.col(key), F.col(text))
    return rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, ids binary")


def decode_rows(merges: Merges, ids: list[bytes]) -> Iterator[bytes]:
    """The UTF-8 text of each row of ids; bytes that are no UTF-8 become replacement characters."""
    for row in ids:
        own = np.frombuffer(row, "<u4").astype(np.int64)
        data = ragged_take(merges.token_bytes, merges.token_starts[own], merges.token_lengths[own])[0].tobytes()
        yield data.decode("utf-8", "replace").encode()


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """Replace ``ids`` by the decoded ``text``."""
    kept = [c for c in encoded.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Merges(tokenizer)
        for batch in batches:
            texts = [t.decode() for t in decode_rows(merges, batch.column("ids").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, "text"])

    schema = ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes if c != "ids")
    return encoded.mapInArrow(run, f"{schema}, text string")


def digest(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """Replace ``ids`` by the sha256 of the ids and of the text decoded from them."""
    kept = [c for c in encoded.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Merges(tokenizer)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            more = [[hashlib.sha256(x).hexdigest() for x in rows] for rows in (ids, decode_rows(merges, ids))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, more)], names=[*kept, "ids_sha256", "decoded_sha256"])

    schema = ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes if c != "ids")
    return encoded.mapInArrow(run, f"{schema}, ids_sha256 string, decoded_sha256 string")
