"""Word shingles: ASCII-lowercased words split on ASCII white space, ``k`` in a row, as sets of numbers.

``shingle_sets`` gives 64-bit numbers made of BLAKE2b digests of words: the same in every task, so they can be shuffled, and
no text can be written to make two words collide. ``exact_sets`` numbers the words and shingles of the texts at hand as they
occur, so that two numbers are equal only for equal shingles: what confirms a link.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b
from itertools import count

import numpy as np

#: Words remembered at most, and bytes of a text that are split at once.
MOST_WORDS, PIECE_BYTES = 1 << 20, 4 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit BLAKE2b digests of words, remembered while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        value = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return value


def words_of(body: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order; a long text comes in pieces, so that few of its words are objects at once."""
    at = 0
    while len(body) - at > PIECE_BYTES:
        cut = _SPACE.search(body, at + PIECE_BYTES)
        if cut is None:
            break
        yield body[at : cut.start()].lower().split()
        at = cut.start()
    yield body[at:].lower().split()


def _numbered(bodies: list[bytes], number: dict, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """The number of every word of all texts, and each text's bounds among them."""
    parts, counts = [np.zeros(0, dtype)], []
    for body in bodies:
        n = 0
        for words in words_of(body):
            parts.append(np.fromiter(map(number.__getitem__, words), dtype, len(words)))
            n += len(words)
        counts.append(n)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int64)


def _windows(bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word and number of words of each shingle; fewer than ``k`` words are one shingle of all of them."""
    counts = np.diff(bounds)
    shingles = np.maximum(counts - k + 1, (counts > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(shingles)])
    doc = np.repeat(np.arange(len(counts)), shingles)
    return doc, np.arange(int(begin[-1])) - np.repeat(begin[:-1] - bounds[:-1], shingles), np.minimum(counts, k)[doc]


def _distinct(value: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=docs))]).astype(np.int64)


def shingle_sets(bodies: list[bytes], hashes: WordHashes, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending within each text, and their bounds by text; empty without words."""
    words, bounds = _numbered(bodies, hashes, np.uint64)
    doc, at, width = _windows(bounds, k)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    value = np.full(len(at), np.uint64(0x243F6A8885A308D3))
    for i in range(k):
        value = np.where(i < width, mix64(value * np.uint64(0xD1342543DE82EF95) + padded[at + i]), value)
    return _distinct(value, doc, len(bodies))


def exact_sets(bodies: list[bytes], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """As ``shingle_sets``, with numbers that are equal only for equal shingles of these texts."""
    number = defaultdict(count(1).__next__)
    words, bounds = _numbered(bodies, number, np.int64)
    doc, at, width = _windows(bounds, k)
    padded = np.concatenate([words, np.zeros(k, np.int64)])
    value = padded[at]
    for i in range(1, k):
        _, value = np.unique(value * (len(number) + 1) + np.where(i < width, padded[at + i], 0), return_inverse=True)
    return _distinct(value, doc, len(bodies))


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and int64 offsets of an Arrow string or binary column; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None or data.size == 0 else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int):
    """Ranges of documents of at most ``most`` bytes together; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j
