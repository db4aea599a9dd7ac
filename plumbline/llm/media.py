"""Media columns: byte payloads kept as FLAC, and read back as PCM blocks with seekable sample offsets.

Defined cases: a null payload is an empty one and is padded to one block; payloads of any length are padded with bytes 255
to a positive multiple of the block; equal payloads give equal media. Repeated rows give a row each, and there are no ties;
an empty table gives no rows. Other columns are kept, and must not have the names of those that are added.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import flac

#: Payload bytes handled at once by a task.
SLICE_BYTES = 2 << 20


def padded(payload: bytes | None) -> bytes:
    payload = payload or b""
    return payload + b"\xff" * (-len(payload) % flac.BLOCK if payload else flac.BLOCK)


def _grouped(values: list[bytes], most: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    part: list[bytes] = []
    size = 0
    for v in values:
        if part and size + len(v) > most:
            yield part
            part, size = [], 0
        part.append(v)
        size += len(v)
    if part:
        yield part


def encode_media(df: DataFrame, payload: str, *, media: str = "media") -> DataFrame:
    """Replace the binary column ``payload`` by ``n_bytes`` (unpadded) and its FLAC stream in column ``media``."""
    kept = [c for c in df.columns if c != payload]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in _grouped([padded(b) for b in batch.column(payload).to_pylist()]):
                own = batch.slice(at, len(part))
                at += len(part)
                sizes = [len(b or b"") for b in own.column(payload).to_pylist()]
                columns = [own.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(sizes, pa.int64()), pa.array(flac.encode_streams(part), pa.binary())], names=[*kept, "n_bytes", media]
                )

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != payload)
    return df.mapInArrow(encode, f"{schema}, n_bytes long, `{media}` binary")


def decode_media(df: DataFrame, media: str = "media") -> DataFrame:
    """PCM blocks of the column ``media``: the other columns, ``sample_offset long`` and ``pcm binary``, a row per block."""
    kept = [c for c in df.columns if c != media]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in _grouped(batch.column(media).to_pylist()):
                payloads = flac.decode_streams(part)
                blocks = [len(p) // flac.BLOCK for p in payloads]
                own = batch.slice(at, len(part)).select(kept)
                at += len(part)
                rows = pa.array(np.repeat(np.arange(len(part)), blocks))
                offsets = np.concatenate([np.arange(n) * flac.BLOCK for n in blocks])
                pcm = [p[i : i + flac.BLOCK] for p in payloads for i in range(0, len(p), flac.BLOCK)]
                yield pa.RecordBatch.from_arrays(
                    [*own.take(rows).columns, pa.array(offsets, pa.int64()), pa.array(pcm, pa.binary())], names=[*kept, "sample_offset", "pcm"]
                )

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != media)
    return df.mapInArrow(decode, f"{schema}, sample_offset long, pcm binary")


def features(pcm: bytes, stream_bytes: int) -> str:
    """Features of a payload in whole numbers, so that equal samples give equal strings."""
    x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"blocks={len(x) // flac.BLOCK};sum={x.sum()};energy={(x * x).sum()};peak={np.abs(x).max()};crossings={crossings};ratio_permille={1000 * stream_bytes // len(x)}"


def media_digest(df: DataFrame, media: str = "media") -> DataFrame:
    """What the stored streams decode to, digested: the other columns and sizes, hashes and features, a row per stream."""
    kept = [c for c in df.columns if c != media]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in _grouped(batch.column(media).to_pylist()):
                payloads = flac.decode_streams(part)
                own = batch.slice(at, len(part)).select(kept)
                at += len(part)
                more = {
                    "payload_bytes": pa.array(map(len, payloads), pa.int64()),
                    "payload_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                    "tail_crc32": pa.array([zlib.crc32(p[-32:]) for p in payloads], pa.int64()),
                    "media_bytes": pa.array(map(len, part), pa.int64()),
                    "media_sha256": pa.array([hashlib.sha256(s).hexdigest() for s in part]),
                    "feature": pa.array([features(p, len(s)) for p, s in zip(payloads, part, strict=True)]),
                }
                yield pa.RecordBatch.from_arrays([*own.columns, *more.values()], names=[*kept, *more])

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != media)
    return df.mapInArrow(
        digest,
        f"{schema}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )


def text_payloads(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("payload"))
