"""Files as sinks: one file a row, written by the tasks that have the rows."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Row


def write_files(rows: DataFrame, folder: str, name: Column, content: Column) -> None:
    """Write ``content`` (bytes) of each row to ``folder`` under ``name``.

    ``folder`` is a path or URI that all executors can reach. A file is written under a name
    of its own and then moved, so a task that is run again or twice leaves whole files.
    Names are taken to be distinct; rows with a null name or content are left out.
    """

    def write(batch: Iterator[Row]) -> None:
        from pyarrow.fs import FileSystem

        files, base = FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        for row in batch:
            part = posixpath.join(base, f"_{uuid4()}.part")
            with files.open_output_stream(part) as out:
                out.write(bytes(row.content))
            files.move(part, posixpath.join(base, row.name))

    rows.select(name.alias("name"), content.alias("content")).where("name is not null and content is not null").foreachPartition(write)
