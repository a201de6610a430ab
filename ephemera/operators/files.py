"""The sink of feed files, a data source. It is sent to the workers by value, so they need no package of this library."""

from __future__ import annotations

import contextlib
import gzip
import re
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby

from pyspark import cloudpickle
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])
CRLF = "\r\n"
#: What packed files' names end in besides, and how hard they are packed: feeds to a ninth at level 1, to an eleventh at level 6 at less than half the speed.
PACKED, LEVEL = ".gz", 1


class FeedFiles(DataSource):
    """A sink of rows (filename, location_id, head, body, tail) that stand together by file and place. A head without body is the whole text, a null
    head a file that is to go.

    Tasks write below a folder of the job, each attempt under a name of its own, and move files to their places when all of the task's are whole. A
    task that dies leaves the feeds as they were and its files in that folder, which goes with the job. Two attempts of one task move equal bytes.

    Option packed: "true" for files in gzip, whose names end in PACKED besides; those to go are such too.
    """

    @classmethod
    def name(cls) -> str:
        return "feed_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _FeedWriter(self.options["path"], self.options.get("packed") == "true")


@dataclass
class _Moved(WriterCommitMessage):
    files: int


class _FeedWriter(DataSourceWriter):
    def __init__(self, directory: str, packed: bool = False):
        self.directory, self.job = directory, f".staged-{uuid.uuid4().hex}"
        self.packed = packed

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(re.sub("^file:/+", "/", self.directory))  # Hadoop writes file:/, which pyarrow does not take

    def _into(self, file):
        """Packed files tell no time and no name, so that attempts write equal bytes."""
        return gzip.GzipFile("", "wb", LEVEL, file, mtime=0) if self.packed else contextlib.nullcontext(file)

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        system, root = self._open()
        attempt = f"{root}/{self.job}/{uuid.uuid4().hex}"
        system.create_dir(attempt, recursive=True)
        written, gone = [], []
        for name, events in groupby(rows, key=lambda r: r["filename"] + (PACKED if self.packed else "")):
            first = next(events)
            if first["head"] is None:
                gone.append(name)
                continue
            with system.open_output_stream(f"{attempt}/{name}", compression=None) as file, self._into(file) as out:
                out.write(first["head"].encode())
                if first["body"] is not None:
                    for row in chain([first], events):
                        if row["location_id"] == first["location_id"]:
                            out.write((CRLF + row["body"]).encode())
                    out.write((CRLF + first["tail"]).encode())
            written.append(name)
        for name in written:
            system.move(f"{attempt}/{name}", f"{root}/{name}")
        for name in gone:
            with contextlib.suppress(FileNotFoundError):  # another attempt was first
                system.delete_file(f"{root}/{name}")
        return _Moved(len(written))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        system, root = self._open()
        with contextlib.suppress(FileNotFoundError):  # a table without partitions
            system.delete_dir(f"{root}/{self.job}")
