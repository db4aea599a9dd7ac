"""Exact deduplication over an extendible-hash index on shared files.

1. Each task combines equal texts of its rows (by their bytes), so a text that a third of all rows share leaves a task as
   one entry per batch: hash, text, smallest key, rows.
2. Owner tasks get ranges of hashes. An owner meets its entries in the order of their hashes; entries of one hash are
   compared byte by byte with the chain of texts met under that hash, so a colliding text becomes a link of its own.
3. The owner puts one entry per text into an extendible hash: a directory over the leading bits of the slot hash, which doubles
   when a full bucket needs a bit more than it has, and the full bucket splits. The slot hash is a hash of the hash, since all
   hashes of an owner begin alike; so a directory grows with its owner's entries, however many owners there are. Entries
   that no bit can part (one hash) stay chained in one bucket. The buckets are written to the shared folder as a table, a row each.
4. A row finds its text's entry as in any extendible hash: its owner's depth says how many leading bits of the slot hash are
   the slot of the directory, the slot holds the bucket, and of the bucket's entries that with the row's hash and digest is its own.
   A slot is one row of the index side, so that Spark can split the rows of a hot text in the join.

Defined cases: null counts as empty, so null and empty texts form one group (a text of white space only
normalises to one space, which is another text); repeated rows of one key are a group; of null and other keys the least that is
not null stays, and ``kept`` holds for a null key where there is no other; other columns are not read (``drop_copies`` keeps
them, whatever their names); long texts are compared whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shingles import slices, text_buffer
from plumbline.llm.storage import arrow_schema, materialize, with_rows

#: Hashes a bucket holds before it splits, and rows for each owner.
BUCKET_ENTRIES, OWNER_ROWS = 256, 50_000
#: Bytes of text combined at once by a task.
COMBINE_BYTES = 16 << 20


def normalised(text: Column) -> Column:
    """Runs of ``[\\x20\\x09-\\x0D]`` become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


class ExtendibleHash:
    """A directory of buckets over the leading bits of 64-bit hashes."""

    def __init__(self, capacity: int = BUCKET_ENTRIES) -> None:
        self.capacity, self.depth = capacity, 0
        self.buckets: list[dict] = [{"depth": 0, "prefix": 0, "entries": [], "hashes": set()}]
        self.directory = [0]

    def bucket(self, value: int) -> dict:
        return self.buckets[self.directory[value >> (64 - self.depth) if self.depth else 0]]

    def add(self, value: int, entry: tuple) -> None:
        """Entries of one hash are chained and count as one, since no bit can part them."""
        own = self.bucket(value)
        own["entries"].append((value, entry))
        own["hashes"].add(value)
        while len(own["hashes"]) > self.capacity:
            self._split(own)
            own = self.bucket(value)

    def _split(self, own: dict) -> None:
        if own["depth"] == self.depth:  # double: each slot becomes two
            self.directory = [b for b in self.directory for _ in (0, 1)]
            self.depth += 1
        depth = own["depth"] + 1
        bit = 64 - depth
        parts = [[e for e in own["entries"] if e[0] >> bit & 1 == x] for x in (0, 1)]
        low, high = ({"depth": depth, "prefix": own["prefix"] << 1 | x, "entries": p, "hashes": {v for v, _ in p}} for x, p in enumerate(parts))
        own |= low
        self.buckets.append(high)
        first = high["prefix"] << (self.depth - depth)
        for slot in range(first, first + (1 << (self.depth - depth))):
            self.directory[slot] = len(self.buckets) - 1


def _owner(h: str, owners: Column) -> Column:
    """The range of hashes, of so many, that a hash is in: by its 31 leading bits."""
    return F.floor(F.shiftrightunsigned(h, 33) * owners / F.lit(1 << 31)).cast("int")


def _slot_hash(h: str) -> Column:
    """The bits that an owner's directory is over: independent of the range of hashes it owns."""
    return F.xxhash64(h, F.lit("slot"))


def _entries(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Texts combined within each task: ``h long, body binary, keep_id, rows long``."""
    id_type = docs.schema[key].dataType.simpleString()

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_buffer(batch.column("body"))
            for i, j in slices(offsets, COMBINE_BYTES):
                part = pa.Table.from_batches([batch.slice(i, j - i)])
                coded = part.column("body").combine_chunks().dictionary_encode()
                part = part.select(["h", "key"]).append_column("code", coded.indices)
                sums = part.group_by("code").aggregate([("h", "min"), ("key", "min"), ("h", "count")])
                bodies = coded.dictionary.take(sums.column("code").combine_chunks())
                columns = [sums.column(c).combine_chunks() for c in ("h_min", "key_min", "h_count")]
                yield pa.RecordBatch.from_arrays([columns[0], bodies, *columns[1:]], names=["h", "body", "keep_id", "rows"])

    body = normalised(F.col(text))
    rows = docs.select(F.xxhash64(body).alias("h"), body.cast("binary").alias("body"), F.col(key).alias("key"))
    return rows.mapInArrow(combine, f"h long, body binary, keep_id {id_type}, rows long")


def build_index(docs: DataFrame, *, key: str = "doc_id", text: str = "text", owners: int | None = None) -> DataFrame:
    """The index of ``docs`` as a table of buckets in the shared folder.

    A row is a bucket: ``owner int``, ``owners int`` (of the index), ``depth int, prefix long`` (the leading bits of its
    slot hashes) and ``entries``, an array of
    ``h, digest (sha256 of the normalised text), chain (place among texts of one hash), keep_id, rows``. ``owners`` is the
    number of hash ranges, by default one for ``OWNER_ROWS`` rows and at least that of shuffle partitions: an owner's entries
    are in a task's memory at once.
    """
    n = owners or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // OWNER_ROWS))
    id_type = docs.schema[key].dataType.simpleString()
    schema = f"owner int, owners int, depth int, prefix long, entries array<struct<h:long,digest:string,chain:int,keep_id:{id_type},rows:long>>"
    fields = arrow_schema(schema)

    def least(a, b):
        return b if a is None else a if b is None else min(a, b)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, current, chain, number = ExtendibleHash(), (None, 0), [], None

        def flush() -> None:
            for link, (body, keep, rows) in enumerate(chain):
                table.add(current[1] & (1 << 64) - 1, (current[0], hashlib.sha256(body).hexdigest(), link, keep, rows))

        def buckets() -> Iterator[pa.RecordBatch]:
            flush()
            rows = [
                {
                    "owner": number, "owners": n, "depth": b["depth"], "prefix": b["prefix"],
                    "entries": [{"h": h, "digest": d, "chain": c, "keep_id": k, "rows": r} for _, (h, d, c, k, r) in b["entries"]],
                }
                for b in table.buckets if b["entries"]
            ]
            for i in range(0, len(rows), 64):
                yield pa.RecordBatch.from_pylist(rows[i : i + 64], fields)

        for batch in batches:
            for o, h, slot, body, keep, rows in zip(*(batch.column(c).to_pylist() for c in ("owner", "h", "slot", "body", "keep_id", "rows")), strict=True):
                if o != number:
                    if number is not None:
                        yield from buckets()
                    table, chain, current, number = ExtendibleHash(), [], (h, slot), o
                elif h != current[0]:
                    flush()
                    chain, current = [], (h, slot)
                for link in chain:
                    if link[0] == body:
                        link[1], link[2] = least(link[1], keep), link[2] + rows
                        break
                else:
                    chain.append([body, keep, rows])
        if number is not None:
            yield from buckets()

    entries = _entries(docs, key, text).withColumns({"owner": _owner("h", F.lit(n)), "slot": _slot_hash("h")})
    dealt = entries.repartition(n, "owner").sortWithinPartitions("owner", "h")
    return materialize(dealt.mapInArrow(own, schema), "extendible-index")


def lookup(docs: DataFrame, index: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its key, the key that stays, the group's rows, whether it stays, the text's sha256."""
    owners = index.groupBy("owner").agg(F.max("depth").alias("bits"), F.first("owners").alias("owners"))
    # The directory: a bucket stands in every slot whose leading bits are its own.
    width = F.expr("shiftleft(1L, bits - depth)")
    slots = F.sequence(F.col("prefix") * width, (F.col("prefix") + 1) * width - 1)
    directory = index.drop("owners").join(owners.drop("owners"), "owner").select("owner", F.explode(slots).alias("slot"), "entries")
    body = normalised(F.col(text))
    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(body).alias("h"), F.sha2(body.cast("binary"), 256).alias("digest"))
    rows = rows.crossJoin(F.broadcast(owners.agg(F.max("owners").alias("owners")))).withColumn("owner", _owner("h", F.col("owners")))
    rows = rows.join(owners.drop("owners"), "owner").withColumn("slot", _slot_hash("h"))
    rows = rows.withColumn("slot", F.expr("if(bits = 0, 0L, shiftrightunsigned(slot, 64 - bits))"))
    found = rows.join(directory, ["owner", "slot"])
    entry = F.get(F.filter("entries", lambda e: (e["h"] == F.col("h")) & (e["digest"] == F.col("digest"))), F.lit(0))
    found = found.select("doc_id", "digest", entry.alias("e"))
    kept = F.col("doc_id").eqNullSafe(F.col("e.keep_id")).alias("kept")
    return found.select("doc_id", F.col("e.keep_id").alias("keep_id"), F.col("e.rows").alias("group_size"), kept, F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without copies: of equal texts the row with the smallest key stays, where a null is the least.

    Rows are told apart by numbers of their own, so keys may be null or repeat.
    """
    rows, row = with_rows(docs, "exact-rows")
    found = lookup(rows, build_index(rows, key=row, text=text), key=row, text=text).select(F.col("doc_id").alias("row"), "keep_id")
    order = rows.select(F.col(row).alias("row"), F.struct(F.col(key).alias("key"), F.col(row).alias("row")).alias("order"))
    kept = found.join(order, "row").groupBy("keep_id").agg(F.min("order").alias("least")).select(F.col("least.row").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)
