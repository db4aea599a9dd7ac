"""Exact join of documents on the Jaccard similarity of their word n-grams, in size-banded tiles with hashed bitmaps.

1. Equal sets of n-grams are one node, named by a digest of the words. Sizes are cut into bands, each half as wide
   again as the one before. Two sets that link have sizes in one band or in neighbouring ones: a set near the
   upper end of its band stands in the next band as well.
2. A band cuts the numbers of n-grams in so many parts that more parts than a link can differ in are left. Two sets differ in
   at most ``d = (100 - p) (a + b) / (100 + p)`` n-grams, so of any ``d + 1`` parts they agree in one. A set gives the sums of its first
   ``d + 1`` parts that hold enough n-grams, in the order of parts; one of two sets that link gives its last part no later than
   the other, and so they share a sum. A set with too few such parts gives them all and is cut anew with another seed,
   until it has enough. No pair that links is left out, whatever the numbers.
3. Sets of one band that share a sum form tiles of bounded size (``cells``): a row of pivots and a row of members. They
   meet as bitmaps of hashed n-grams first. Bits of one set that the other lacks are n-grams that it lacks, so bit counts
   bound the overlap from above; where the bound is too low, the pair is done, and a set with no pair left leaves the tile. The
   texts of the others meet then, and the sorted arrays of their n-grams are intersected exactly.
4. Union-find over the links that hold gives the components.

A sum that many sets share is told from the rest where it arises: if several sets of a slice have it, two of them go the common
way and the others are dealt by set, so that the task a sum comes to gets a few rows of it from each slice, whatever its
share of all sets. Numbers of n-grams are made of 64-bit digests; that two n-grams share one can only bring sets together in
vain, as links are confirmed on the words.

Defined cases: null and wordless texts have an empty set and are linked with nothing; fewer words than an n-gram make one of all
of them; repeated rows are of one component. Keys may be null or repeat: a component's id is its smallest key that is not
null, and null where it has none. Texts are read whole, however long; other columns are not read, so they may have any name; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.cells import BOTH, MEMBER, PASS_BYTES, PART, PIVOT, STAR, _block_cells, _in_parts, _open_buckets, _small_cells, _star_cells, _verified, find
from plumbline.llm.components import connected_components
from plumbline.llm.hot import join_by_key, likely
from plumbline.llm.shingles import WordHashes, exact_sets, mix64, shingle_sets, slices, text_buffer
from plumbline.llm.storage import materialize

NGRAM, PERCENT = 4, 85
#: N-grams a part must hold to count, in bands whose sets have so many, and parts a band has for each that it needs.
FULL_PART, FULL_FROM, SPARE = 2, 48, 1.25
SEEDS, LEAST_PERCENT = 4, 80
#: Text bytes a task turns into sets at once, and sets of such a slice that make a sum a frequent one.
SLICE_BYTES, FREQUENT = 2 << 20, 8
#: Parts that the sets of a frequent sum are dealt to.
DEALT = 1024
#: Bits a bitmap has for each n-gram, at least.
BITS_EACH = 2
SUM_NAMES, SUMS = ["value", "dealt", "short"], "value long, dealt int, short long"
_STEP, _SEED = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def band_edges(most: int) -> np.ndarray:
    """The least size of each band, up to the first one above ``most``."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(max(edges[-1] + 1, edges[-1] * 3 // 2))
    return np.array(edges, np.int64)


def _stands(sizes: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """Set, band, parts of the band, parts that the set gives, and n-grams such a part holds: for each band a set stands in."""
    most = 100 * sizes // percent
    edges = band_edges(int(most.max(initial=1)) + 1)
    held = np.flatnonzero(sizes > 0)
    low, high = (np.searchsorted(edges, x[held], side="right") - 1 for x in (sizes, most))
    sets = np.repeat(held, high - low + 1)
    band = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b + 1) for a, b in zip(low, high, strict=True))])
    top = edges[band + 1] - 1

    def differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (100 - percent) * (a + b) // (100 + percent)

    wanted = differ(sizes[sets], np.minimum(most[sets], top)) + 1
    needed = differ(top, top) + 1
    parts = np.where(needed == 1, 1, np.ceil(SPARE * needed).astype(np.int64) + 2)
    return sets, band, parts, wanted, np.where(edges[band] >= FULL_FROM, FULL_PART, 1)


def part_sums(values: np.ndarray, bounds: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set, band and sum of the parts that sets of ascending 64-bit numbers give: sets that link share one of a band.

    From seed ``SEEDS`` on parts hold one n-gram and are twice as many each time, so that in the end every set has enough.
    """
    if percent < LEAST_PERCENT:
        raise ValueError(f"sets are joined from a similarity of {LEAST_PERCENT} percent on")
    sizes = np.diff(bounds)
    sets, band, parts, wanted, full = _stands(sizes, percent)
    out, seed = [], 0
    while len(sets):
        width = sizes[sets]
        ends = np.cumsum(width)
        stand = np.repeat(np.arange(len(sets)), width)
        own = values[np.arange(int(ends[-1])) - np.repeat(ends - width - bounds[sets], width)]
        if seed:
            own = mix64(own + np.uint64(seed * _SEED & 2**64 - 1))
            own = own[np.lexsort((own, stand))]
        part = ((own >> np.uint64(32)) * parts[stand].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        new = np.ones(len(own), bool)
        new[1:] = (stand[1:] != stand[:-1]) | (part[1:] != part[:-1])
        at = np.flatnonzero(new)
        held = np.diff(np.append(at, len(own)))
        of, number = stand[at], part[at]
        sums = np.add.reduceat(mix64(own + np.uint64(_STEP)), at)
        enough = held >= full[of]
        of, number, sums = of[enough], number[enough], sums[enough]
        counts = np.bincount(of, minlength=len(sets))
        nth = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        given = nth < wanted[of]
        of, number, sums = of[given], number[given], sums[given]
        name = mix64(band[of].astype(np.uint64) * np.uint64(_STEP) + number.astype(np.uint64) + np.uint64(seed << 40))
        out.append((sets[of], band[of], mix64(sums + name * np.uint64(_SEED))))
        short = counts < wanted
        sets, band, parts, wanted, full = (x[short] for x in (sets, band, parts, wanted, full))
        seed += 1
        if seed >= SEEDS:
            parts, full = 2 * parts, np.ones_like(full)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def sketches(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """For each set its size, and a bitmap of its hashed n-grams whose bits are a power of two."""
    sizes, out = np.diff(bounds), []
    hashed = mix64(values * np.uint64(_SEED))
    for i, size in enumerate(sizes.tolist()):
        bits = max(64, 1 << max(0, BITS_EACH * size - 1).bit_length())
        held = np.zeros(bits, bool)
        held[(hashed[bounds[i] : bounds[i + 1]] & np.uint64(bits - 1)).astype(np.int64)] = True
        out.append(size.to_bytes(8, "little") + np.packbits(held, bitorder="little").tobytes())
    return out


def _unpacked(own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes, and bitmaps as rows of 64-bit words, all folded to the least number of bits among them."""
    sizes = np.array([int.from_bytes(x[:8], "little") for x in own], np.int64)
    words = min((len(x) - 8) // 8 for x in own)
    return sizes, np.stack([np.bitwise_or.reduce(np.frombuffer(x, np.uint64, offset=8).reshape(-1, words)) for x in own])


def _may_link(size: int, bitmap: np.ndarray, sizes: np.ndarray, bitmaps: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and bit counts allow a set to link with each of the others."""
    need = -(-percent * (size + sizes) // (100 + percent))
    lacks = np.bitwise_count(bitmap & ~bitmaps).sum(1, dtype=np.int64)
    lacked = np.bitwise_count(bitmaps & ~bitmap).sum(1, dtype=np.int64)
    return np.minimum(size - lacks, sizes - lacked) >= need


def left_over(pivots: list[tuple], members: list[tuple] | None, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Which pivots and which members have a pair left after the bounds; without members, pivots among themselves.

    Both are ``sketch, part``; those of one part are connected already, so they are no pair.
    """
    every = pivots + (members or [])
    sizes, maps = _unpacked([x[0] for x in every])
    number: dict = {}
    parts = np.array([number.setdefault(x[1], len(number)) for x in every])
    at = 0 if members is None else len(pivots)
    held, rest = np.zeros(len(pivots), bool), np.zeros(len(sizes) - at, bool)
    for i in range(len(pivots)):
        pairs = _may_link(sizes[i], maps[i], sizes[at:], maps[at:], percent) & (parts[at:] != parts[i])
        held[i] = pairs.any()
        rest |= pairs
    return held, rest


def link_tile(codes: np.ndarray, bounds: np.ndarray, pivots: int, others: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect as all do, between sets ``0 .. pivots - 1`` and sets from ``others`` on; sets must not be empty.

    Pairs that are within the bounds and not connected yet have their ascending codes intersected.
    """
    sizes, maps = _unpacked(sketches(codes.astype(np.uint64), bounds))
    up, out = list(range(len(sizes))), []
    for i in range(pivots):
        own = codes[bounds[i] : bounds[i + 1]]
        for j in (np.flatnonzero(_may_link(sizes[i], maps[i], sizes[others:], maps[others:], percent)) + others).tolist():
            x, y = find(up, i), find(up, j)
            if x != y:
                both = len(np.intersect1d(own, codes[bounds[j] : bounds[j + 1]], assume_unique=True))
                if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                    up[max(x, y)] = min(x, y)
                    out.append((i, j))
    return out


def _body(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def _node(text: str) -> Column:
    """The name of a text: the first 16 bytes of its SHA-256."""
    return F.unhex(F.substring(F.sha2(_body(text), 256), 1, 32))


def _sets(percent: int, k: int):
    """A task that gives each ``node, body`` the size and the sketch of its set, its sums, and for each sum how it is dealt:
    0 for the common way, where the sum is rare in the slice or this is one of the two sets that stand for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            _, offsets = text_buffer(batch.column(1))
            for i, j in slices(offsets, SLICE_BYTES):
                part = batch.slice(i, j - i)
                values, bounds = shingle_sets(part.column(1).to_pylist(), hashes, k)
                sets, _, value = part_sums(values, bounds, percent)
                order = np.argsort(value, kind="stable")
                ordered, own = value[order], sets[order]
                new = np.ones(len(ordered), bool)
                new[1:] = ordered[1:] != ordered[:-1]
                at = np.flatnonzero(new)
                counts = np.diff(np.append(at, len(ordered)))
                nth = np.arange(len(ordered)) - np.repeat(at, counts)
                often = (np.repeat(counts, counts) >= FREQUENT) & (nth > 1)
                dealt = np.where(often, 1 + (mix64(own.astype(np.uint64) + np.uint64(offsets[i])) % np.uint64(DEALT)).astype(np.int32), 0)
                by_set = np.argsort(own, kind="stable")
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(part)))]).astype(np.int32))
                columns = [
                    *part.columns, pa.array(np.diff(bounds)), pa.array(sketches(values, bounds), pa.binary()),
                    pa.ListArray.from_arrays(ends, pa.array(ordered[by_set].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(dealt[by_set].astype(np.int32))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "body", "n_shingles", "sketch", "sums", "dealt"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, sorted by ``value`` and ``dealt``, of values that several rows have; dealt rows are of such anyway."""
    held = [np.zeros(0, t) for t in (np.int64, np.int32, np.int64)]
    matched = False  # whether the held row has met an equal one

    def out(rows: list[np.ndarray], keep: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(r[keep]) for r in rows], names=SUM_NAMES)

    for batch in batches:
        rows = [np.concatenate([h, batch.column(n).to_numpy()]) for h, n in zip(held, SUM_NAMES, strict=True)]
        if not len(rows[0]):
            continue
        equal = (rows[0][1:] == rows[0][:-1]) & (rows[1][1:] == rows[1][:-1])
        before = np.concatenate([[matched], equal])
        keep = before | np.append(equal, False) | (rows[1] > 0)
        held, matched = [r[-1:] for r in rows], bool(before[-1])
        yield out([r[:-1] for r in rows], keep[:-1])
    if len(held[0]):
        yield out(held, np.array([matched or held[1][0] > 0]))


def _buckets(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """Buckets (``cells``) of the nodes that share a sum, from ``value, short`` rows: one of those that hold the same nodes.

    Sets that are much alike share many sums, so there are several times as many sums as buckets; number and two hashes tell them apart.
    """
    seen = shared.groupBy("value").agg(F.count("*").alias("n"), F.bit_xor("short").alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "short")).alias("y"))
    once = seen.where("n > 1").groupBy("n", "x", "y").agg(F.min("value").alias("value")).select("value", "n")
    met = shared.select("value", "short").join(once, "value").join(nodes.select("node", F.col("n_shingles").alias("weight"), F.xxhash64("node").alias("short")), "short")
    part = F.pmod(F.xxhash64("node"), F.floor(F.col("n") / PART) + 1).cast("int").alias("part_no")
    return materialize(met.select("node", "weight", F.lit(0).alias("band"), "value", "n", part), "join-buckets")


def _pruned(tiles: DataFrame, sketched: DataFrame, percent: int) -> DataFrame:
    """The rows of tiles (``cell, role, node``) that have a pair left after the bounds, by the ``sketch`` and ``part`` of each node.

    A task holds the sketches of a tile's pivots, and ``PASS_BYTES`` of those of the members that pass them.
    """
    n = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, pivots, held, members, size = None, [], None, [], 0

        def rows(kept: list[tuple]) -> pa.RecordBatch:
            roles, nodes = ([r[i] for r in kept] for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array([cell] * len(kept), pa.int64()), pa.array(roles, pa.int32()), pa.array(nodes, pa.binary())], names=["cell", "role", "node"])

        def passed() -> pa.RecordBatch:
            own, rest = left_over([p[2:] for p in pivots], [m[2:] for m in members], percent)
            held[:] |= own
            return rows([m for m, x in zip(members, rest, strict=True) if x])

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if pivots and pivots[0][0] == BOTH:
                held, _ = left_over([p[2:] for p in pivots], None, percent)
            elif pivots and members:
                yield passed()
            if pivots:
                yield rows([p for p, x in zip(pivots, held, strict=True) if x])

        for batch in batches:
            for c, role, node, sketch, part in zip(*(batch.column(x).to_pylist() for x in ("cell", "role", "node", "sketch", "part")), strict=True):
                if c != cell:
                    yield from closed()
                    cell, pivots, held, members, size = c, [], None, [], 0
                if role == MEMBER:
                    members.append((role, node, sketch, part))
                    size += len(sketch)
                    held = np.zeros(len(pivots), bool) if held is None else held
                    if size > PASS_BYTES and pivots:
                        yield passed()
                        members, size = [], 0
                else:
                    pivots.append((role, node, sketch, part))
                    held = np.zeros(len(pivots), bool)
        yield from closed()

    met = tiles.join(sketched, "node").select("cell", "role", "node", "sketch", "part")
    return met.repartition(n, "cell").sortWithinPartitions("cell", "role").mapInArrow(run, "cell long, role int, node binary")


def _once(tiles: DataFrame) -> DataFrame:
    """One of the tiles that hold the same sets in the same roles: sets that are much alike share many sums."""
    seen = tiles.groupBy("cell").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("role", "node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "role", "node")).alias("y"))
    return materialize(tiles.join(seen.groupBy("n", "x", "y").agg(F.min("cell").alias("cell")).select("cell"), "cell", "left_semi"), "join-once")


def _linked(buckets: DataFrame, nodes: DataFrame, percent: int, k: int) -> DataFrame:
    """Links ``a, b`` of the nodes of buckets that connect as all do, with sets pruned by their sketches before texts meet.

    Each set meets the most central one of its buckets first, then one of another component, which joins nearly all that link;
    and what is open then is gone through whole.
    """

    def link(found: list[bytes], pivots: int, others: int) -> list[tuple[int, int]]:
        return link_tile(*exact_sets(found, k), pivots, others, percent)

    def links(tiles: DataFrame, sketched: DataFrame) -> DataFrame:
        left = _once(materialize(_pruned(tiles, sketched, percent), "join-tiles"))
        return materialize(_verified(left, likely(nodes.select("node", "body"), left, "node"), link), "join-links")

    sketched = materialize(likely(nodes.select("node", "sketch"), buckets, "node"), "join-sketches")
    found = links(_star_cells(buckets), sketched.withColumn("part", F.col("node")))
    still = _open_buckets(buckets, found)
    more = links(_partner_tiles(still), sketched.join(still.select("node", "part").distinct(), "node"))
    if not more.isEmpty():
        found = found.unionByName(more)
        still = _open_buckets(still.drop("part"), found)
    parted = sketched.join(still.select("node", "part").distinct(), "node")
    return found.unionByName(links(_small_cells(still).unionByName(_block_cells(still)), parted))


def _partner_tiles(rows: DataFrame) -> DataFrame:
    """Each set of the open buckets with the set of another component that it shares most buckets with, of two a bucket:
    those of its least and of its greatest component. Components that link in any way mostly do so here."""
    one, keys = F.struct("part", "node"), ["band", "value", "part_no"]
    ends = _in_parts(rows.groupBy("band", "value", "n").agg(F.min(one).alias("low"), F.max(one).alias("high"))).drop("n")
    met = rows.join(ends, keys).select("node", F.when(F.col("part") != F.col("low.part"), F.col("low.node")).otherwise(F.col("high.node")).alias("head"))
    counted = met.groupBy("node", "head").agg(F.count("*").alias("n"))
    stars = materialize(counted.groupBy("node").agg(F.max(F.struct("n", "head")).alias("best")).select("node", F.col("best.head").alias("head")), "join-stars")
    sizes = stars.groupBy("head").agg(F.ceil(F.count("*") / STAR).alias("tiles"))
    cell = F.xxhash64(F.lit("partner"), "head", F.pmod(F.xxhash64("node"), F.col("tiles")))
    members = stars.join(sizes, "head").select("head", "node", cell.alias("cell"))
    pivots = members.select("cell", F.lit(PIVOT).alias("role"), F.col("head").alias("node")).distinct()
    return pivots.unionByName(members.select("cell", F.lit(MEMBER).alias("role"), "node"))


def jaccard_components(docs: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = PERCENT, k: int = NGRAM) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles long`` (size of its set), ``component_id`` (the smallest key reachable)."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(docs.select(F.col(key).alias("doc_id"), _node(text).alias("node")), "join-rows")
    texts = docs.select(_node(text).alias("node"), _body(text).alias("body")).groupBy("node").agg(F.first("body").alias("body"))
    nodes = materialize(texts.mapInArrow(_sets(percent, k), "node binary, body binary, n_shingles long, sketch binary, sums array<long>, dealt array<int>"), "join-texts")

    sums = nodes.select(F.xxhash64("node").alias("short"), F.explode(F.arrays_zip("sums", "dealt")).alias("s")).select(F.col("s.sums").alias("value"), "s.dealt", "short")
    shared = sums.repartition(n, "value", "dealt").sortWithinPartitions("value", "dealt").mapInArrow(_shared, SUMS)
    shared = materialize(shared, "join-sums")
    roots = connected_components(_linked(_buckets(shared, nodes), nodes, percent, k)).select("node", F.col("component").alias("root"))
    return with_components(rows, nodes.select("node", "n_shingles"), roots)


def with_components(rows: DataFrame, sizes: DataFrame, roots: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of ``doc_id, node`` rows: the smallest key of all nodes of a root that have a set."""
    texts = rows.groupBy("node").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies")).join(sizes, "node").join(roots, "node", "left")
    texts = materialize(texts.withColumn("root", F.coalesce("root", "node")), "join-nodes")
    lows = texts.where("n_shingles > 0").groupBy("root").agg(F.min("low").alias("component"), F.count("*").alias("members"))
    own = join_by_key(texts.drop("low"), lows, "root", "members").select("node", "n_shingles", "component", "copies")
    out = join_by_key(rows, materialize(own, "join-components"), "node")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))
