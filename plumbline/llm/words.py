"""Pre-tokenisation and whole-corpus encoding by distinct words.

A byte-pair tokenizer encodes the pre-tokens ("words") of a text one by one, so a slice of documents is encoded by
splitting it into words, encoding each distinct word once and gathering the ids of all words with numpy. The result is
the one the tokenizers library gives for the whole text.
"""

from __future__ import annotations

import itertools
import json
import re
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np

#: Bytes of text handled at once; bounds a task's memory whatever the batch.
SLICE_BYTES = 8 << 20
#: Words whose ids a task remembers; when full, it starts afresh.
CACHE_WORDS = 600_000


#: White space as the tokenizers' regular expressions know it; fixed values of the Unicode property White_Space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ASCII, LATIN, UNICODE = range(3)


@lru_cache(maxsize=1)
def _every() -> str:
    return "".join(map(chr, (c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)))


@lru_cache(maxsize=None)
def _class(kind: str, most: int) -> str:
    """Ranges of the letters (L) or numbers (N) up to a code point, as the tokenizers library's Unicode tables have them."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    text = _every()[: most + 1]
    runs = Split(Regex(rf"\p{{{kind}}}+"), "removed", invert=True).pre_tokenize_str(text)
    return "".join(f"\\U{ord(text[a]):08x}-\\U{ord(text[b - 1]):08x}" for _, (a, b) in runs)


def _patterns(pattern) -> list[re.Pattern]:
    """One pattern each for texts of ASCII, of Latin-1 and of any characters: short classes are much faster."""
    tops = (0x7F, 0xFF, sys.maxunicode)
    return [re.compile(pattern(_class("L", top), _class("N", top), SPACE if top > 0xFF else r"\t-\r \x85\xa0")) for top in tops]


@lru_cache(maxsize=1)
def byte_level_patterns() -> list[re.Pattern]:
    return _patterns(lambda x, n, s: rf"'(?:s|t|re|ve|m|ll|d)| ?[{x}]+| ?[{n}]+| ?[^{s}{x}{n}]+|[{s}]+(?![^{s}])|[{s}]+")


@lru_cache(maxsize=1)
def word_end_patterns() -> list[re.Pattern]:
    return _patterns(lambda x, n, s: rf"'(?:s|t|re|ve|m|ll|d)|[{x}]+|[{n}]|[^{s}{x}{n}]+")


def alphabet(text: str) -> int:
    if text.isascii():
        return ASCII
    try:
        text.encode("latin-1")
        return LATIN
    except UnicodeEncodeError:
        return UNICODE


@lru_cache(maxsize=1)
def _lower_table() -> tuple[re.Pattern, dict[int, str]]:
    """Letters that the library lower-cases in another way than Python does."""
    from tokenizers.normalizers import Lowercase

    lower = Lowercase().normalize_str
    own = {ord(c): lower(c) for c in _every()[128:] if not c.isspace() and (x := lower(c)) != c.lower() and x}
    own[ord("\u03a3")] = "\u03c3"  # no final form
    return re.compile("[" + "".join(f"\\U{c:08x}" for c in own) + "]"), own


def word_end_normal(text: str) -> str:
    """NFC and lower case, character by character; white space only separates words and is left to the pattern."""
    if text.isascii():
        return text.lower()
    text = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
    odd, table = _lower_table()
    return (text.translate(table) if odd.search(text) else text).lower()


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], free = chr(free), free + 1
    return [out[b] for b in range(256)]


class Vocabulary:
    """What this module needs of a tokenizer file: special strings, splitting rules, and an encoder of single words."""

    def __init__(self, path: str, word_ids: Callable[[list[str]], tuple[np.ndarray, np.ndarray]] | None = None) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = len(spec["model"]["vocab"]) + len(self.special)
        self.special_pattern = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)))
        self.marks = [s[:2] for s in self.special]
        word_ends = spec["model"].get("end_of_word_suffix") is not None
        self.patterns = word_end_patterns() if word_ends else byte_level_patterns()
        self.normal = word_end_normal if word_ends else None
        self.word_ids = word_ids or LibraryWords(path)
        self._reset()

    def _reset(self) -> None:
        self.cache: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        self.starts, self.lengths = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.ids, self.used = np.zeros(4096, np.uint32), 0

    def words(self, text: str) -> list[str]:
        """The words of a text; a special string is a word of its own, marked by a leading NUL NUL."""
        if self.special and self.marks[0] in text and (found := list(self.special_pattern.finditer(text))):
            out, at = [], 0
            for m in found:
                out += self._plain(text[at : m.start()])
                out.append("\0\0" + m[0])
                at = m.end()
            return out + self._plain(text[at:])
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        text = self.normal(text) if self.normal else text
        return self.patterns[alphabet(text)].findall(text)

    def _learn(self, new: list[str], first: int) -> None:
        """Put the ids of words into the table, at positions from ``first`` on."""
        flat, lengths = self.word_ids(new)
        marked = [(i, self.special[w[2:]]) for i, w in enumerate(new) if w[0] == "\0" and w[:2] == "\0\0" and w[2:] in self.special]
        if marked:
            rows = np.split(flat, np.cumsum(lengths)[:-1])
            for i, token in marked:
                rows[i], lengths[i] = np.array([token], np.uint32), 1
            flat = np.concatenate(rows)
        if first + len(new) > len(self.starts):
            room = max(2 * len(self.starts), first + len(new))
            self.starts, self.lengths = np.resize(self.starts, room), np.resize(self.lengths, room)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, max(2 * len(self.ids), self.used + len(flat)))
        self.starts[first : first + len(new)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[first : first + len(new)] = lengths
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32), and the bounds of each text's ids (one more than texts)."""
        if len(self.cache) > CACHE_WORDS:
            self._reset()
        first = len(self.cache)
        split = [self.words(t) for t in texts]
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))])
        # A word the cache lacks gets the next position as it is looked up.
        at = np.fromiter(map(self.cache.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(bounds[-1]))
        del split
        if len(self.cache) > first:
            self._learn(list(itertools.islice(self.cache, first, None)), first)
        ids, ends = ragged_take(self.ids, self.starts[at], self.lengths[at])
        return ids, ends[bounds]


def ragged_take(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces ``data[starts[i]:starts[i] + lengths[i]]`` one after another, and their bounds in the result."""
    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    at = np.repeat((starts - ends[:-1]).astype(np.int32 if len(data) + ends[-1] < 2**31 else np.int64), lengths)
    at += np.arange(ends[-1], dtype=at.dtype)
    return data[at], ends


class LibraryWords:
    """Ids of single words by the tokenizers library's model."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.table = dict(enumerate(byte_letters()))

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tokenize, table, space = self.model.tokenize, self.table, self.table[32]
        ids = [
            [t.id for t in tokenize(w.replace(" ", space) if w.isascii() and w.isprintable() else w.encode("utf-8").decode("latin-1").translate(table))]
            for w in words
        ]
        lengths = np.fromiter(map(len, ids), np.int32, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths


def text_slices(texts: Iterable[str | None], most: int = SLICE_BYTES):
    """Runs of texts of about ``most`` characters together; null becomes the empty text, a longer text stands alone."""
    part: list[str] = []
    size = 0
    for t in texts:
        t = t or ""
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part
