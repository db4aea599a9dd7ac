"""Token-id shards: raw id payloads with a minimal perfect hash index for keyed access.

Documents are encoded, sorted by key and written as shards, one per range of keys. A shard is two files:

``shard-N.bin``  the ids of its documents in key order, little-endian unsigned 16-bit (32-bit where ids need it);
``shard-N.idx``  an ``npz`` archive: the rows' keys and bounds, and a minimal perfect hash of the distinct keys. Slot ``h`` of
the hash holds a 32-bit fingerprint of its key and the first row and number of rows of that key.

A lookup costs a constant number of probes: hash the key level by level until its bit is set, take the rank of that bit
as the slot, compare the fingerprint, and read ``payload[bounds[row]:bounds[row + rows]]``. The manifest has the range of
keys of each shard, so ``Router`` goes from a key to its shard, or to several where texts of one key lie in neighbouring ones.

Defined cases: a null text is an empty one; rows of one key are adjacent, in the order of their texts, and are found
together; rows of a null key come first and are found under ``None``; only key and text are read, so other columns may have
any name; a long text is encoded whole; an empty table gives empty shards.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.shingles import mix64
from plumbline.llm.storage import arrow_schema, materialize, open_fs, write_file
from plumbline.llm.words import Vocabulary, text_slices

GAMMA, LEVELS = 2.0, 32
MANIFEST = "shard int, uri string, n_rows long, n_ids long, n_null long, first_key long, last_key long"


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    return mix64(keys.view(np.uint64) ^ mix64(np.full(1, np.uint64(seed) + np.uint64(1))))


class PerfectHash:
    """A minimal perfect hash of distinct int64 keys, by levels of bits that exactly one remaining key maps to.

    About ``GAMMA`` bits a key remain on each level; what ``LEVELS`` levels leave over (practically nothing) is kept
    sorted. ``slots`` numbers the keys 0 to n - 1; a foreign key gets -1 or some slot, which its fingerprint refutes.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, ranks: np.ndarray, rest: np.ndarray) -> None:
        self.sizes, self.bits, self.ranks, self.rest = sizes, bits, ranks, rest

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        rest, sizes, words = np.asarray(keys, np.int64), [], []
        for level in range(LEVELS):
            if not len(rest):
                break
            size = int(np.ceil(len(rest) * GAMMA / 64)) * 64
            at = (_hash(rest, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, np.uint8)
            bits[at[alone]] = 1
            sizes.append(size)
            words.append(np.packbits(bits, bitorder="little").view(np.uint64))
            rest = rest[~alone]
        bits = np.concatenate(words) if words else np.zeros(0, np.uint64)
        counts = np.cumsum(np.bitwise_count(bits), dtype=np.int64)
        return cls(np.array(sizes, np.int64), bits, np.concatenate([[0], counts]), np.sort(rest))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, np.int64)
        out, open_, first = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(open_):
                break
            at = first + (_hash(keys[open_], level) % np.uint64(size)).astype(np.int64)
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            found = (word >> bit) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[found]] = (self.ranks[at >> 6] + np.bitwise_count(below))[found]
            open_, first = open_[~found], first + size
        if len(open_) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            same = self.rest[at] == keys[open_]
            out[open_[same]] = self.ranks[-1] + at[same]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_hash(np.asarray(keys, np.int64), 1 << 20) >> np.uint64(32)).astype(np.uint32)


def pack_index(keys: np.ndarray, nulls: int, bounds: np.ndarray, dtype: str) -> bytes:
    """The index file of a shard; ``keys`` are those of its rows after the ``nulls`` rows without key, ascending."""
    distinct, first, rows = np.unique(keys, return_index=True, return_counts=True)
    table = PerfectHash.build(distinct)
    slot = table.slots(distinct)
    own = {k: np.zeros(len(distinct), t) for k, t in (("prints", np.uint32), ("first", np.int64), ("rows", np.int64))}
    own["prints"][slot], own["first"][slot], own["rows"][slot] = fingerprints(distinct), first + nulls, rows
    np.savez(
        out := io.BytesIO(), keys=keys, nulls=nulls, bounds=bounds, dtype=dtype,
        sizes=table.sizes, bits=table.bits, ranks=table.ranks, rest=table.rest, **own,
    )
    return out.getvalue()


class Shard:
    """A shard opened for reading: its index in memory, its payload read piece by piece."""

    def __init__(self, uri: str) -> None:
        store, path = open_fs(uri + ".idx")
        with store.open_input_file(path) as f:
            own = np.load(io.BytesIO(f.read()))
            self.index = {k: own[k] for k in own.files}
        self.table = PerfectHash(*(self.index[k] for k in ("sizes", "bits", "ranks", "rest")))
        self.dtype = np.dtype(str(self.index["dtype"]))
        self.bounds, self.nulls, self.keys = self.index["bounds"], int(self.index["nulls"]), self.index["keys"]
        store, path = open_fs(uri + ".bin")
        self.payload = store.open_input_file(path)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each key; zero rows for a key that the shard lacks."""
        keys, slot = np.asarray(keys, np.int64), self.table.slots(keys)
        there = np.flatnonzero(slot >= 0)
        there = there[self.index["prints"][slot[there]] == fingerprints(keys[there])]
        first, rows = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        first[there], rows[there] = self.index["first"][slot[there]], self.index["rows"][slot[there]]
        return first, rows

    def ids(self, begin: int, end: int) -> np.ndarray:
        size = self.dtype.itemsize
        return np.frombuffer(self.payload.read_at((end - begin) * size, begin * size), self.dtype)

    def get(self, key: int | None) -> list[np.ndarray]:
        """The ids of each row of a key."""
        first, rows = (0, self.nulls) if key is None else (int(x[0]) for x in self.find(np.array([key])))
        return [self.ids(int(self.bounds[r]), int(self.bounds[r + 1])) for r in range(first, first + rows)]


class Router:
    """From keys to shards, by the ranges of the manifest's rows (dictionaries or rows, one a shard)."""

    def __init__(self, manifest: list) -> None:
        rows = sorted(({c: m[c] for c in ("shard", "uri", "n_null", "first_key", "last_key")} for m in manifest), key=lambda m: m["shard"])
        self.without = [m["uri"] for m in rows if m["n_null"]]
        keyed = [m for m in rows if m["first_key"] is not None]
        self.uris = [m["uri"] for m in keyed]
        self.first, self.last = (np.array([m[c] for m in keyed], np.int64) for c in ("first_key", "last_key"))
        self.open: dict[str, Shard] = {}

    def uris_of(self, key: int | None) -> list[str]:
        """The shards whose range holds the key, in order."""
        if key is None:
            return self.without
        return self.uris[int(np.searchsorted(self.last, key, "left")) : int(np.searchsorted(self.first, key, "right"))]

    def get(self, key: int | None) -> list[np.ndarray]:
        """The ids of each row of a key, from all shards; shards stay open once they are used."""
        out = []
        for uri in self.uris_of(key):
            shard = self.open.get(uri) or self.open.setdefault(uri, Shard(uri))
            out += shard.get(key)
        return out


def find_keys(keys: DataFrame, manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """``doc_id, nth, n_tokens, ids binary`` (as in the payload) of every row of the given keys; a key that no row has gives none.

    The manifest, a row a shard, goes to every task; keys are dealt to their shards, each of which is opened once a task.
    """
    routes = keys.sparkSession.sparkContext.broadcast([r.asDict() for r in manifest.collect()])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = Router(routes.value)
        for batch in batches:
            pairs = [(k, uri) for k in batch.column(0).to_pylist() for uri in router.uris_of(k)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in pairs], pa.int64()), pa.array([u for _, u in pairs], pa.string())], names=["k", "uri"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, shard = None, None
        for batch in batches:
            rows = []
            for k, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != uri:
                    uri, shard = own, Shard(own)
                rows += [(k, n, len(ids), ids.tobytes()) for n, ids in enumerate(shard.get(k))]
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            types = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "nth", "n_tokens", "ids"])

    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.select(F.col(key).cast("long").alias("k")).distinct().mapInArrow(route, "k long, uri string")
    return dealt.repartition(n, "uri").sortWithinPartitions("uri").mapInArrow(read, "doc_id long, nth int, n_tokens long, ids binary")


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, *, key: str = "doc_id", text: str = "text", shards: int | None = None) -> DataFrame:
    """Encode ``docs`` and write them as shards under ``folder`` (a URI); returns the manifest, one row per shard.

    ``shards`` is the number of key ranges, by default that of shuffle partitions. A task streams its sorted rows, so it
    holds one slice of text and the keys and bounds of its rows. A repeated task writes the same files again.
    """
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = arrow_schema(MANIFEST)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        uri = f"{folder}/shard-{shard:06d}"
        words = Vocabulary(tokenizer)
        dtype = "<u2" if max(words.special.values(), default=0) < 1 << 16 and end_id < 1 << 16 and words.size <= 1 << 16 else "<u4"
        store, path = open_fs(f"{uri}.bin")
        store.create_dir(path.rpartition("/")[0], recursive=True)
        part = f"{path}.{TaskContext.get().taskAttemptId()}.part"
        keys, lengths, nulls = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        with store.open_output_stream(part) as out:
            for batch in batches:
                column = batch.column(0).drop_null()
                nulls += len(batch) - len(column)
                keys.append(column.to_numpy(zero_copy_only=False).astype(np.int64))
                for texts in text_slices(batch.column(1).to_pylist()):
                    ids, bounds = words.encode(texts)
                    ids = np.insert(ids, bounds[1:], end_id).astype(dtype)
                    out.write(ids.tobytes())
                    lengths.append(np.diff(bounds) + 1)
        store.move(part, path)
        bounds = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
        own = np.concatenate(keys)
        write_file(f"{uri}.idx", pack_index(own, nulls, bounds, dtype))
        ends = {"first_key": int(own[0]), "last_key": int(own[-1])} if len(own) else {"first_key": None, "last_key": None}
        yield pa.RecordBatch.from_pylist([{"shard": shard, "uri": uri, "n_rows": len(bounds) - 1, "n_ids": int(bounds[-1]), "n_null": nulls, **ends}], schema)

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    written = rows.repartitionByRange(n, "k", F.xxhash64("t")).sortWithinPartitions("k", F.xxhash64("t"), "t").mapInArrow(write, MANIFEST)
    return materialize(written, "token-shards-manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with the number of ids in all shards before each; one row per shard, so one window holds it."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read_shards(manifest: DataFrame, block_ids: int = 4 << 20) -> DataFrame:
    """Every row of the shards, read back from the files: key, global start, ids count and crc32 of the 32-bit ids.

    Each key of a shard goes through its perfect hash; payloads are read in blocks of about ``block_ids`` ids.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int32())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            shard = Shard(row["uri"])
            distinct = np.unique(shard.keys)
            first, rows = shard.find(distinct)
            order = np.concatenate([np.arange(shard.nulls), np.repeat(first - np.cumsum(rows) + rows, rows) + np.arange(rows.sum())])
            keys = np.concatenate([np.zeros(shard.nulls, np.int64), np.repeat(distinct, rows)])
            begin, end = shard.bounds[order], shard.bounds[order + 1]
            i = 0
            while i < len(order):
                j = max(i + 1, int(np.searchsorted(end, begin[i] + block_ids, side="right")))
                ids = shard.ids(int(begin[i]), int(end[j - 1])).astype("<u4")
                view, a, b = memoryview(ids.tobytes()), ((begin[i:j] - begin[i]) * 4).tolist(), ((end[i:j] - begin[i]) * 4).tolist()
                crc = [zlib.crc32(view[x:y]) for x, y in zip(a, b, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[i:j], mask=np.arange(i, j) < shard.nulls),
                        pa.array(begin[i:j] + row["start"]),
                        pa.array(end[i:j] - begin[i:j]),
                        pa.array(crc, pa.int64()),
                        pa.array(np.full(j - i, row["shard"], np.int32)),
                    ],
                    schema=schema,
                )
                i = j

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return with_starts(manifest).repartition(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")
