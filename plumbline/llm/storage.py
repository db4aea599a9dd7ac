"""Tables and files in the folder that all executors share, and Arrow schemas of tasks' batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.storage import materialize, new_path, shared_folder

__all__ = ["arrow_schema", "fresh", "materialize", "new_path", "open_fs", "shared_folder", "with_rows", "write_file"]


def fresh(columns: list[str], name: str) -> str:
    """``name``, with as many underscores before it as it takes to be none of the columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_rows(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs`` written to the shared folder with a distinct number in each row, so that keys may be null or repeat; and the
    name of the column that holds it, which is none of the others'."""
    row = fresh(docs.columns, "__row")
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), name), row


def open_fs(uri: str):
    """The pyarrow file system and path of a URI of any store pyarrow knows; a plain path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> None:
    """Write a file whole: under a name of its own first, then moved, so that a repeated task leaves one complete file."""
    store, path = open_fs(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, path)


def arrow_schema(ddl: str):
    """The Arrow schema of a DDL string, for record batches that tasks build."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
