"""Python data sources for files that Spark has no reader for: zstandard JSON lines and Arrow IPC files.

``spark.dataSource.register`` makes them formats of ``spark.read``. Files are opened with ``pyarrow.fs``, on the driver to plan and
in tasks to read, so a path may be in any store that pyarrow knows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of a file read, and of text taken out of it, at once.
CHUNK = 2 << 20


def list_files(path: str, suffixes: tuple[str, ...]) -> list[str]:
    """The URIs of a file, or of the files below a folder that have one of the suffixes, by name."""
    from pyarrow import fs

    store, own = fs.FileSystem.from_uri(path)
    if store.get_file_info(own).type == fs.FileType.File:
        return [path]
    found = sorted(f.path for f in store.get_file_info(fs.FileSelector(own, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(suffixes))
    return [path.rstrip("/") + f[len(own.rstrip("/")) :] for f in found]


def open_input(uri: str, *, seek: bool = False):
    from pyarrow import fs

    store, own = fs.FileSystem.from_uri(uri)
    return store.open_input_file(own) if seek else store.open_input_stream(own, compression=None)


@dataclass
class FilePart(InputPartition):
    """A file, or so many of its record batches."""

    path: str
    first: int = 0
    last: int = 0


class ZstdLines(DataSource):
    """``path`` (a file or a folder of ``.zst`` files) as lines: ``file, line`` (1 on), ``value`` and ``broken``.

    A line that is not UTF-8 is broken and has its bytes replaced where they are not; blank lines are skipped but counted. A
    file whose end is cut off gives its whole lines, and then a broken line without text. ``chunk`` bytes of text are
    held at once, and a line of any length.
    """

    @classmethod
    def name(cls) -> str:
        return "zstd_lines"

    def schema(self) -> str:
        return "file string, line long, value string, broken boolean"

    def reader(self, schema: StructType) -> ZstdLinesReader:
        return ZstdLinesReader(self.options["path"], int(self.options.get("chunk", CHUNK)))


def text_lines(stream, chunk: int) -> Iterator[tuple[list[bytes], bool]]:
    """The lines of a compressed stream, some at a time, and whether it was cut off behind them."""
    import zstandard

    parts: list[bytes] = []
    data, engine, begun = b"", None, False
    while data or (data := stream.read(chunk)):
        if engine is None or engine.eof:
            engine, begun = zstandard.ZstdDecompressor().decompressobj(), True
        whole = b""
        try:
            whole = engine.decompress(data)
        except zstandard.ZstdError:
            break
        data = engine.unused_data if engine.eof else b""
        for at in range(0, len(whole), chunk):
            head, *rest = whole[at : at + chunk].split(b"\n")
            parts.append(head)
            if rest:
                yield [b"".join(parts), *rest[:-1]], False
                parts = [rest[-1]]
    cut = begun and not engine.eof
    last = b"".join(parts)
    yield ([last] if last and not cut else []), cut


class ZstdLinesReader(DataSourceReader):
    def __init__(self, path: str, chunk: int) -> None:
        self.path, self.chunk = path, chunk

    def partitions(self) -> list[FilePart]:
        return [FilePart(f) for f in list_files(self.path, (".zst", ".zstd"))]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        names = ["file", "line", "value", "broken"]
        number = 0

        def batch(rows: list[tuple[int, str | None, bool]]) -> pa.RecordBatch:
            numbers, texts, broken = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([partition.path] * len(rows), pa.string()), pa.array(numbers, pa.int64()), pa.array(texts, pa.string()), pa.array(broken, pa.bool_())], names=names)

        with open_input(partition.path) as stream:
            for lines, cut in text_lines(stream, self.chunk):
                rows = []
                for line in lines:
                    number += 1
                    if line.strip():
                        try:
                            rows.append((number, line.decode(), False))
                        except UnicodeDecodeError:
                            rows.append((number, line.decode("utf-8", "replace"), True))
                if cut:
                    rows.append((number + 1, None, True))
                if rows:
                    yield batch(rows)


class ArrowBlocks(DataSource):
    """``path`` (a file or a folder of Arrow IPC files) with the columns named in ``columns`` (all, if not given).

    A partition is ``batches`` record batches of a file (16 by default), found by its footer; other columns aren't read.
    """

    @classmethod
    def name(cls) -> str:
        return "arrow_blocks"

    def _columns(self) -> list[str] | None:
        return [c.strip() for c in self.options["columns"].split(",")] if self.options.get("columns") else None

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        files = list_files(self.options["path"], (".arrow", ".feather"))
        if not files:
            raise FileNotFoundError(self.options["path"])
        with open_input(files[0], seek=True) as source:
            own = from_arrow_schema(pa.ipc.open_file(source).schema)
        return StructType([own[c] for c in self._columns() or own.names])

    def reader(self, schema: StructType) -> ArrowBlocksReader:
        return ArrowBlocksReader(self.options["path"], schema, int(self.options.get("batches", 16)))


class ArrowBlocksReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, batches: int) -> None:
        self.path, self.schema, self.batches = path, schema, batches

    def partitions(self) -> list[FilePart]:
        out = []
        for path in list_files(self.path, (".arrow", ".feather")):
            with open_input(path, seek=True) as source:
                n = pa.ipc.open_file(source).num_record_batches
            out += [FilePart(path, i, min(i + self.batches, n)) for i in range(0, n, self.batches)]
        return out or [FilePart("")]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if not partition.path:
            return
        names, fields = self.schema.names, to_arrow_schema(self.schema)
        with open_input(partition.path, seek=True) as source:
            own = pa.ipc.open_file(source).schema
            source.seek(0)
            wanted = pa.ipc.open_file(source, options=pa.ipc.IpcReadOptions(included_fields=[own.get_field_index(n) for n in names]))
            for i in range(partition.first, partition.last):
                batch = wanted.get_batch(i)
                yield pa.RecordBatch.from_arrays([batch.column(n).cast(f.type) for n, f in zip(names, fields, strict=True)], schema=fields)
