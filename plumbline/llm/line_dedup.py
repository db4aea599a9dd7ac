"""Line deduplication: exact copies by digest, near copies by a segment-partition edit join.

Lines are trimmed. Exact copies are found among lines of at least ``shortest`` characters (1 is every line that is not
blank): a line is named by 16 bytes of BLAKE2b. Two lines are near copies if one becomes the other by insertions, deletions
or substitutions of so many characters as ``STEPS`` allows for the shorter one: 1 from 20 characters on, 2 from 200 (a tuple of more lengths
allows more edits). A class is all lines connected by exact or near copies; of its occurrences in all documents
the first (by document, a null key before others, then line) stays.

The edit join splits each line into one segment more than its edits, even ones, at places that depend on its length alone.
Of two near copies, the shorter has a segment that the longer contains unchanged, at a place that differs by no more than
the edits before and after it allow. So each line is indexed under its segments (length, number, hash), and probes, for each
length it may be joined with, the substrings that can match. Rows of one segment meet in one task, sorted. Candidates must also agree in two parity signatures (an edit
flips at most two bits of the characters' and four of the bigrams'), which ends nearly all chance matches inside the
join; of lines that have a partner left, those of one segment are a bucket (``cells``), whose links are verified by a banded
bit-parallel edit distance, many pairs at a time. A segment that more than ``HOT`` lines
share (a common beginning, say) is parted further: of the ``2 * edits + 1`` parts of the characters' signature, near copies
have one in common, so such lines are joined on segment and part.

Defined cases: null texts are empty; blank lines and those below ``shortest`` stay; repeated rows are copies of each other, so the second
loses its lines; an empty table gives no rows. Keys may be null or repeat: rows have numbers of their own, and those of one
key come in the order of their texts' hashes. Columns of any name are kept; with ``counts``, ``n_lines`` and ``n_dropped``
replace columns of that name. A text is split whole, however long; texts are worked on ``SLICE_CHARS`` at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.cells import bucketed, find, linked
from plumbline.llm.components import connected_components
from plumbline.llm.hot import join_by_key
from plumbline.llm.shingles import mix64
from plumbline.llm.storage import fresh, materialize, with_rows
from plumbline.llm.words import text_slices

#: Lengths from which a line may have one edit more.
STEPS = (20, 200)
#: Pairs below which it pays to verify one at a time.
FEW = 256
#: Lines that share a segment before it is parted further.
HOT = 200
#: Characters handled at once. Bits of the filter that finds the lines to verify: sixteen a line, between these powers of
#: two (128 KB and 16 MB); beyond, it lets more lines pass and the join that follows stays exact.
SLICE_CHARS, FILTER_BITS = 1 << 20, (20, 27)
#: Characters whose hashes and signatures are made at once, so few that their arrays stay in a core's cache.
BLOCK_CHARS = 1 << 15
_BLANK = " \t\x0b\x0c\r"
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class Powers:
    """Powers of a hash base and of its inverse modulo 2**64, grown on demand and reused between slices."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _INVERSE)]), dtype=np.uint64)
        return self.up[:n], self.down[:n]


def split_lines(texts: list[str], least: int) -> Iterator[tuple[int, int, str]]:
    """Text, number and trimmed line of every line of at least ``least`` characters, 1 at least."""
    for at, text in enumerate(texts):
        for number, line in enumerate(text.split("\n")):
            if len(own := line.strip(_BLANK)) >= max(least, 1):
                yield at, number, own


def digest(line: str) -> bytes:
    return blake2b(line.encode(), digest_size=16).digest()


class Lines:
    """Distinct lines as code points, with a hash of any substring. These hashes only propose candidates."""

    def __init__(self, lines: list[str], powers: Powers) -> None:
        self.codes = np.frombuffer("\n".join([*lines, ""]).encode("utf-32-le"), np.uint32)
        self.length = np.fromiter(map(len, lines), np.int64, len(lines))
        self.begin = np.cumsum(self.length + 1) - self.length - 1
        self.stop = self.begin + self.length
        up, self.down = powers.upto(len(self.codes) + 1)
        self.sums = np.zeros(len(self.codes) + 1, np.uint64)
        for i in range(0, len(self.codes), BLOCK_CHARS):
            part = (self.codes[i : i + BLOCK_CHARS] + np.uint64(1)) * up[i : i + BLOCK_CHARS][: len(self.codes) - i]
            part[:1] += self.sums[i : i + 1]
            np.cumsum(part, out=self.sums[i + 1 : i + 1 + len(part)])

    def hashed(self, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix64((self.sums[stop] - self.sums[begin]) * self.down[begin] + (stop - begin).astype(np.uint64))

    def parities(self) -> np.ndarray:
        """For each line, a bit for each of 32 classes of characters (the upper half) and of bigrams: whether their number is odd."""
        out, first = np.zeros(len(self.begin), np.uint64), 0
        while first < len(out):
            last = max(first + 1, int(np.searchsorted(self.stop, self.begin[first] + BLOCK_CHARS, side="right")))
            start = self.begin[first]
            begin, stop = self.begin[first:last] - start, self.stop[first:last] - start
            small = (self.codes[start : start + stop[-1] + 1] * np.uint32(2654435761)) >> np.uint32(20)
            single = np.uint64(1) << (np.uint32(32) + (small >> np.uint32(7))).astype(np.uint64)
            pairs = ((small[:-1] * np.uint32(40503) + small[1:] * np.uint32(30011)) * np.uint32(2654435761)) >> np.uint32(27)
            double = np.append(np.uint64(1) << pairs.astype(np.uint64), np.uint64(0))
            for bits, less in ((single, 0), (double, 1)):
                cut = np.stack([begin, stop - less], 1).ravel()
                out[first:last] |= np.bitwise_xor.reduceat(bits, cut)[::2]
            first = last
        return out.view(np.int64)


def edits_of(length: np.ndarray, steps: tuple[int, ...] = STEPS) -> np.ndarray:
    """The edits that a line of this length may have."""
    return np.searchsorted(np.array(steps), length, side="right")


def segment_bounds(length: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the ``i``-th of ``edits + 1`` even segments of a line of this length begins and ends."""
    n = edits + 1
    small, longer = length // n, length % n  # the last ones are longer
    before = n - longer
    begin = i * small + np.maximum(0, i - before)
    return begin, begin + small + (i >= before)


def probes(edits: int, shorter_by: int, i: int) -> range:
    """Shifts, against the segment's place in the shorter line, at which the longer line may contain segment ``i``.

    With ``i`` segments before it and ``edits - i`` after it that all hold an edit, at most ``i`` edits precede it and at
    most ``edits - i`` follow it.
    """
    return range(max(-i, shorter_by - (edits - i)), min(i, shorter_by + (edits - i)) + 1)


def _key(length: np.ndarray, i: int, value: np.ndarray) -> np.ndarray:
    return mix64(value ^ mix64(length.astype(np.uint64) * np.uint64(64) + np.uint64(i))).view(np.int64)


def occurrences(
    rows: DataFrame, row: str, *, key: str = "doc_id", text: str = "text", least: int = STEPS[0], steps: tuple[int, ...] = STEPS
) -> DataFrame:
    """``row long, doc_id, text_hash long, line int, h binary, ks array<long>`` of every line that takes part; ``row`` numbers the
    rows. ``ks`` are the segments that the line is indexed under, of the first of equal lines of a slice; none of others."""
    id_type = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            at = 0
            for texts in text_slices(batch.column(3).to_pylist(), SLICE_CHARS):
                per = np.fromiter((t.count("\n") + 1 for t in texts), np.int64, len(texts))
                lines = [x.strip(_BLANK) for x in "\n".join(texts).split("\n")]
                kept = np.flatnonzero(np.fromiter(map(len, lines), np.int64, len(lines)) >= max(least, 1))
                doc = np.repeat(np.arange(len(texts)), per)[kept] + at
                number = kept - np.repeat(np.cumsum(per) - per, per)[kept]
                lines = [lines[i] for i in kept.tolist()]
                own = [batch.column(i).take(pa.array(doc)) for i in range(3)]
                h = pa.array([digest(x) for x in lines], pa.binary())
                yield pa.RecordBatch.from_arrays([*own, pa.array(number, pa.int32()), h, _index_keys(lines, powers, steps)], names=["row", "doc_id", "text_hash", "line", "h", "ks"])
                at += len(texts)

    columns = rows.select(F.col(row), F.col(key), F.xxhash64(text).alias("text_hash"), F.col(text))
    return columns.mapInArrow(run, f"row long, doc_id {id_type}, text_hash long, line int, h binary, ks array<long>")


def _index_keys(lines: list[str], powers: Powers, steps: tuple[int, ...]) -> pa.Array:
    """For each line the segments that it is indexed under; none for a line that came before or is too short."""
    first: dict[str, int] = {}
    for i, x in enumerate(lines):
        if len(x) >= steps[0]:
            first.setdefault(x, i)
    own, at = Lines(list(first), powers), np.fromiter(first.values(), np.int64, len(first))
    found = [(at[i], k) for i, k, _ in _segments(own, steps, index_only=True)]
    line, k = (np.concatenate([f[c] for f in found] or [np.zeros(0, np.int64)]) for c in (0, 1))
    ends = np.cumsum(np.bincount(line, minlength=len(lines)))
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(k[np.argsort(line, kind="stable")], pa.int64()))


def segments(docs: DataFrame, *, text: str = "text", steps: tuple[int, ...] = STEPS) -> DataFrame:
    """``k, h, s long``: the segments that lines are indexed under and the substrings they probe.

    ``k`` is the segment, ``s`` the line's signatures, ``h`` the first 55 bits of its digest, followed by the edits of the
    shorter line and a bit that is set for probes: three numbers a row, since these rows are most of what is shuffled. Lines
    that a slice holds more than once are given once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for texts in text_slices(batch.column(0).to_pylist(), SLICE_CHARS):
                lines = list(dict.fromkeys(x for _, _, x in split_lines(texts, steps[0])))
                own = Lines(lines, powers)
                h, s = ids_of([digest(x) for x in lines]) << 8, own.parities()
                for i, k, kind in _segments(own, steps):
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(h[i] | kind), pa.array(s[i])], names=["k", "h", "s"])

    return docs.select(F.col(text)).mapInArrow(run, "k long, h long, s long")


def ids_of(digests: list[bytes]) -> np.ndarray:
    """The first 55 bits of digests, as a number."""
    return (np.frombuffer(b"".join(digests), ">u8")[::2].astype(np.uint64) >> np.uint64(9)).view(np.int64)


def _segments(lines: Lines, steps: tuple[int, ...], *, index_only: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Lines, their keys, and the edits of the shorter line followed by a bit that is set for probes."""
    for less in range(1 if index_only else len(steps) + 1):
        edits = edits_of(lines.length - less, steps)  # of the shorter line
        for e in range(max(less, 1), len(steps) + 1):
            own = np.flatnonzero(edits == e)
            length, begin, stop = lines.length[own] - less, lines.begin[own], lines.stop[own]
            for i in range(e + 1) if len(own) else ():
                x, y = segment_bounds(length, i, e)
                for shift in probes(e, less, i):
                    probe = bool(less or shift)
                    if probe and index_only:
                        continue
                    ok = (x + shift >= 0) & (begin + y + shift <= stop)
                    at = begin[ok] + shift
                    yield own[ok], _key(length[ok], i, lines.hashed(at + x[ok], at + y[ok])), e << 1 | probe


def _parted(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows of hot keys once for each part of their characters' signature, with a key of segment and part."""
    keys = F.expr(
        "transform(sequence(0, 2 * e), j -> xxhash64(k, j, shiftright(s, 32 + j * width) & (shiftleft(1L, width) - 1)))"
    )
    marked = rows.join(hot.select("k", F.lit(True).alias("hot")), "k", "left")
    e = F.shiftright("h", 1).bitwiseAND(F.lit(127)).cast("int")
    marked = marked.withColumn("e", e).withColumn("width", F.floor(F.lit(32) / (2 * F.col("e") + 1)).cast("int"))
    return marked.select(F.explode(F.when(F.col("hot"), keys).otherwise(F.array("k"))).alias("k"), "h", "s")


def _with_partner(k: np.ndarray, h: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The places of rows that have another of their key that they may be near copies of: one of the two is of the index, and
    their signatures allow so few edits. Of rows of one key that are the same line's, one stands for all.

    Rows are sorted by key. Those alone with their key, nearly all, are left first, and so are keys without a row of the index.
    Others are compared with the next but ``d``, until all of their key have a partner or have met.
    """
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    at = np.flatnonzero(same[1:] | same[:-1])
    at = at[np.lexsort((h[at], k[at]))]
    once = np.ones(len(at), bool)
    once[1:] = (k[at[1:]] != k[at[:-1]]) | (h[at[1:]] != h[at[:-1]])
    at = at[once]
    run = np.cumsum(np.append(True, k[at[1:]] != k[at[:-1]])[: len(at)]) - 1
    indexed = np.bincount(run, h[at] & 1 == 0)[run] > 0 if len(at) else np.zeros(0, bool)
    at, run = at[indexed], run[indexed]
    h, s = h[at], s[at]
    out, own, d = np.zeros(len(at), bool), np.arange(len(at)), 0
    while len(own):
        d += 1
        own = own[own + d < len(at)]
        own = own[run[own] == run[own + d]]
        x, y = own, own + d
        e = np.where(h[x] & 1, h[y], h[x]) >> 1 & 127
        differ = (s[x] ^ s[y]).view(np.uint64)
        close = (np.bitwise_count(differ >> np.uint64(32)) <= 2 * e) & (np.bitwise_count(differ & np.uint64(0xFFFFFFFF)) <= 4 * e)
        ok = close & (h[x] & h[y] & 1 == 0) & (h[x] >> 8 != h[y] >> 8)
        out[x[ok]] = out[y[ok]] = True
        if d & (d - 1) == 0 and len(own):  # now and then, as it goes through all rows
            lonely = np.zeros(run[-1] + 1, bool)
            lonely[run[~out]] = True
            own = own[lonely[run[own]]]
    return at[out]


def candidates(docs: DataFrame, *, text: str = "text", steps: tuple[int, ...] = STEPS, hot: int = HOT, index: DataFrame | None = None) -> DataFrame:
    """``k, id``: ids of lines that may be near copies of others that meet them on key ``k``, whose rows are in one task.

    ``index`` has the key ``k`` of each row of the index, if they are known, so that they needn't be made to be counted.
    """
    rows = segments(docs, text=text, steps=steps)
    index = rows.where(F.col("h").bitwiseAND(F.lit(1)) == 0).select("k") if index is None else index
    often = materialize(index.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > hot), "line-hot")
    if not often.isEmpty():
        rows = _parted(rows, often)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3

        def met(k: np.ndarray, h: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
            own = _with_partner(k, h, s)
            return pa.RecordBatch.from_arrays([pa.array(k[own]), pa.array(h[own] >> 8)], names=["k", "id"])

        for batch in batches:
            k, h, s = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate(held))
            cut = int(np.searchsorted(k, k[-1])) if len(k) else 0  # the last key may go on in the next batch
            held = [k[cut:], h[cut:], s[cut:]]
            yield met(k[:cut], h[:cut], s[:cut])
        yield met(*held)

    return rows.repartition(n, "k").sortWithinPartitions("k").mapInArrow(run, "k long, id long").distinct()


def within_edits(a: list[str], b: list[str], edits: int | np.ndarray) -> np.ndarray:
    """Whether each pair's edit distance is at most ``edits``: one band of bits per pair, all pairs a character at a time.

    Bit ``i`` of a band stands for the diagonal ``i - edits``; ``reach[e]`` has the diagonals on which the pair's prefixes
    can be aligned with ``e`` edits. A column moves all of them by shifts and one comparison of the band's characters.
    """
    n = len(a)
    la, lb = (np.fromiter(map(len, x), np.int64, n) for x in (a, b))
    edits = np.broadcast_to(edits, n)
    out = np.abs(la - lb) <= edits
    for most in np.unique(edits).tolist():
        own = np.flatnonzero(out & (edits == most))
        if len(own) < FEW:
            out[own] = [_banded_pair(a[i], b[i], most) for i in own.tolist()]
            continue
        for start in range(0, len(own), 4096):
            part = own[start : start + 4096]
            part = part[np.argsort(la[part], kind="stable")]
            out[part] = _banded([a[i] for i in part.tolist()], [b[i] for i in part.tolist()], la[part], lb[part], most)
    return out


def _banded_pair(a: str, b: str, edits: int) -> bool:
    """As ``_banded``, for one pair, whose common beginning and end are left out."""
    n, begin = min(len(a), len(b)), 0
    while begin < n and a[begin] == b[begin]:
        begin += 1
    stop = 0
    while stop < n - begin and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    a, b = a[begin : len(a) - stop], b[begin : len(b) - stop]
    whole = (1 << (2 * edits + 1)) - 1
    reach = [sum(1 << (edits + d) for d in range(e + 1)) for e in range(edits + 1)]
    for j, x in enumerate(a):
        same = room = 0
        for place in range(max(j - edits, 0), min(j + edits + 1, len(b))):
            bit = 1 << (place - j + edits)
            room |= bit
            same |= bit if b[place] == x else 0
        new = [reach[0] & same]
        for e in range(1, edits + 1):
            new.append((reach[e] & same) | (reach[e - 1] & room) | (reach[e - 1] >> 1) | (new[e - 1] << 1 & whole) | new[e - 1])
        reach = new
        if not reach[edits]:
            return False
    return bool(reach[edits] >> (len(b) - len(a) + edits) & 1)


def _banded(a: list[str], b: list[str], la: np.ndarray, lb: np.ndarray, edits: int) -> np.ndarray:
    width = 2 * edits + 1
    ends_a, ends_b = np.cumsum(la), np.cumsum(lb)
    codes_a = np.append(np.frombuffer("".join(a).encode("utf-32-le"), np.uint32), np.uint32(0))
    codes_b = np.append(np.frombuffer("".join(b).encode("utf-32-le"), np.uint32), np.uint32(0))
    starts_a, starts_b = ends_a - la, ends_b - lb
    # reach[e]: bit d + edits is set if a[:j] can be turned into b[:j + d] by at most e edits; before the first column
    # insertions alone lead to the diagonals d = 1 .. e.
    reach = [np.full(len(la), sum(1 << (edits + d) for d in range(e + 1)), np.int64) for e in range(edits + 1)]
    shifts = np.arange(width)
    for j in range(int(la.max(initial=0))):
        place = j + shifts - edits  # of b, for each diagonal
        inside = (place[None, :] >= 0) & (place[None, :] < lb[:, None])
        other = codes_b[np.where(inside, starts_b[:, None] + place[None, :], len(codes_b) - 1)]
        same = ((other == codes_a[np.minimum(starts_a + j, len(codes_a) - 1)][:, None]) & inside) << shifts
        same, room = same.sum(1), (inside << shifts).sum(1)
        new = [reach[0] & same]
        for e in range(1, edits + 1):
            # a match; a substitution; a deletion from a (one diagonal down); an insertion (one up, within the column)
            now = (reach[e] & same) | (reach[e - 1] & room) | (reach[e - 1] >> 1) | ((new[e - 1] << 1) & ((1 << width) - 1))
            new.append(now | new[e - 1])
        active = j < la
        reach = [np.where(active, x, y) for x, y in zip(new, reach, strict=True)]
    return (reach[edits] >> (lb - la + edits)) & 1 == 1


def _line_texts(docs: DataFrame, wanted: DataFrame, text: str, least: int) -> DataFrame:
    """``id, h, body`` of the lines whose ids are in ``wanted`` (column ``id``).

    A filter of some bits a line, gathered as the words that have any, lets the scan pass these lines and few others,
    so that the texts of all lines needn't be shuffled; the join that follows is exact.
    """
    low, high = FILTER_BITS
    bits = min(max(low, int(16 * max(wanted.count(), 1)).bit_length()), high)
    words = wanted.select(F.shiftright("id", 55 - bits).alias("at")).select(F.shiftright("at", 6).alias("w"), F.expr("shiftleft(1L, cast(at & 63 AS int))").alias("bit"))
    rows = words.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[rows["w"].to_numpy()] = rows["bits"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value.view(np.uint64)
        for batch in batches:
            for texts in text_slices(batch.column(0).to_pylist(), SLICE_CHARS):
                lines = list(dict.fromkeys(x for _, _, x in split_lines(texts, least)))
                h = [digest(x) for x in lines]
                ids = ids_of(h)
                at = ids >> (55 - bits)
                hit = np.flatnonzero(words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).tolist()
                own = [pa.array(ids[hit]), pa.array([h[i] for i in hit], pa.binary()), pa.array([lines[i] for i in hit], pa.string())]
                yield pa.RecordBatch.from_arrays(own, names=["id", "h", "body"])

    found = docs.select(F.col(text)).mapInArrow(run, "id long, h binary, body string")
    return found.join(wanted, "id", "left_semi").groupBy("id", "h").agg(F.first("body").alias("body"))


def link_lines(bodies: list[bytes], pivots: int, others: int, steps: tuple[int, ...] = STEPS) -> list[tuple[int, int]]:
    """Links between lines ``0 .. pivots - 1`` and those from ``others`` on: pairs that are near copies, as far as they
    connect what was not. Signatures rule most pairs out; the rest is verified by edit distance."""
    texts = [x.decode() for x in bodies]
    own = Lines(texts, Powers())
    signs, up, out = own.parities().view(np.uint64), list(range(len(texts))), []
    for i in range(pivots):
        j = np.arange(others, len(texts))
        e = edits_of(np.minimum(own.length[i], own.length[j]), steps)
        differ = signs[i] ^ signs[j]
        close = (np.bitwise_count(differ >> np.uint64(32)) <= 2 * e) & (np.bitwise_count(differ & np.uint64(0xFFFFFFFF)) <= 4 * e)
        j = np.array([x for x in j[close].tolist() if find(up, x) != find(up, i)], np.int64)
        if len(j):
            near = within_edits([texts[i]] * len(j), [texts[x] for x in j.tolist()], edits_of(np.minimum(own.length[i], own.length[j]), steps))
            for x in j[near].tolist():
                a, b = find(up, i), find(up, x)
                if a != b:
                    up[max(a, b)] = min(a, b)
                    out.append((i, x))
    return out


def near_links(docs: DataFrame, *, text: str = "text", steps: tuple[int, ...] = STEPS, hot: int = HOT, index: DataFrame | None = None) -> DataFrame:
    """Verified links ``a, b`` of digests of different near copies, which connect as all of their pairs do.

    Ids are parts of digests: lines of one id, if there are several, all take part.
    """
    met = materialize(candidates(docs, text=text, steps=steps, hot=hot, index=index), "line-candidates")
    bodies = materialize(_line_texts(docs, met.select("id").distinct(), text, steps[0]), "line-bodies")
    own = bodies.select("id", F.col("h").alias("node"), F.length("body").cast("long").alias("weight"))
    buckets = bucketed(met.join(own, "id").select("node", "weight", F.lit(0).alias("band"), F.col("k").alias("value")), "line-buckets")
    return linked(buckets, bodies.select(F.col("h").alias("node"), F.col("body").cast("binary").alias("body")), lambda b, p, o: link_lines(b, p, o, steps))


def line_classes(
    rows: DataFrame, row: str, *, key: str = "doc_id", text: str = "text", steps: tuple[int, ...] = STEPS, shortest: int = STEPS[0]
) -> DataFrame:
    """Lines that go: ``row`` and ``line`` of every occurrence in a class but the class's first."""
    lines = materialize(occurrences(rows, row, key=key, text=text, least=shortest, steps=steps), "lines")
    classes = connected_components(near_links(rows, text=text, steps=steps, index=lines.select(F.explode("ks").alias("k"))))
    classes = classes.select(F.col("node").alias("h"), F.col("component").alias("near"))
    place = F.struct("doc_id", "text_hash", "row", "line")
    own = lines.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("n")).join(classes, "h", "left").where("n > 1 OR near IS NOT NULL")
    own = materialize(own.select("h", "n", "first", F.coalesce("near", "h").alias("class")), "line-own")
    firsts = own.groupBy("class").agg(F.min("first").alias("least"), F.sum("n").alias("all"), F.count("*").alias("lines")).where(F.col("all") > 1).drop("all")
    table = join_by_key(own.select("h", "n", "class"), firsts, "class", "lines").where("least IS NOT NULL")
    table = materialize(table.select("h", "n", F.col("least.row").alias("first_row"), F.col("least.line").alias("first_line")), "line-firsts")
    later = join_by_key(lines.select("h", "row", "line"), table, "h", "n").where("row <> first_row OR line <> first_line")
    return later.select("row", "line")


def drop_lines(rows: DataFrame, row: str, gone: DataFrame, *, text: str = "text", counts: bool = False) -> DataFrame:
    """``rows`` without the lines ``gone`` (``row, line``) and the column ``row``; with ``counts`` also ``n_lines``, ``n_dropped``."""
    own, lost = fresh(rows.columns, "__own"), fresh(rows.columns, "__gone")
    lists = gone.groupBy(F.col("row").alias(own)).agg(F.collect_list("line").alias(lost))
    joined = rows.join(lists, F.col(row) == F.col(own), "left").drop(own, row)
    more = ["n_lines", "n_dropped"] * counts
    kept = [f for f in rows.schema.fields if f.name != row and f.name.lower() not in more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, totals, dropped = [], [], []
            for body, away in zip(batch.column(text).to_pylist(), batch.column(lost).to_pylist(), strict=True):
                lines, away = (body or "").split("\n"), set(away or ())
                bodies.append("\n".join(x for i, x in enumerate(lines) if i not in away) if away else body)
                totals.append(len(lines))
                dropped.append(len(away))
            columns = [pa.array(bodies, pa.string()) if f.name == text else batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(totals, pa.int64()), pa.array(dropped, pa.int64())] * counts, names=[f.name for f in kept] + more)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", n_lines long, n_dropped long" * counts
    return joined.mapInArrow(run, schema)


def dedup_lines(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", steps: tuple[int, ...] = STEPS, shortest: int = STEPS[0], counts: bool = False
) -> DataFrame:
    """``docs`` with each class of lines at its first occurrence only; ``shortest``: the length from which exact copies go."""
    rows, row = with_rows(docs, "line-rows")
    gone = line_classes(rows, row, key=key, text=text, steps=steps, shortest=shortest)
    return drop_lines(rows, row, gone, text=text, counts=counts)
