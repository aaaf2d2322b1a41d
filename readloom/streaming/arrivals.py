"""Streaming reads of a folder in which alignment files arrive.

A batch reads the files that came since the last one, each in file order, without
an index. The offset is the time of the newest file and the names of that time,
so it doesn't grow with what was read; a file must have a later time than those
that were there, or the same and another name, as a new file has.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSourceStreamReader, InputPartition

from readloom import ship
from readloom.codec import bam, bgzf

ship(__name__)


class ArrivalReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], columns: list[str]) -> None:
        self.options, self.columns = options, columns
        self.folder = options["path"].rstrip("/")

    def _files(self) -> list[tuple[int, str]]:
        from pyarrow import fs

        local = "://" not in self.folder or self.folder.startswith("file:")
        store, inner = (fs.LocalFileSystem(), self.folder.removeprefix("file://").removeprefix("file:")) if local else fs.FileSystem.from_uri(self.folder)
        found = store.get_file_info(fs.FileSelector(inner))
        return sorted((f.mtime_ns or 0, f.base_name) for f in found if f.is_file and f.base_name.endswith(".bam"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": -1, "names": []}

    def latestOffset(self) -> dict:  # noqa: N802
        found = self._files()
        if not found:
            return self.initialOffset()
        newest = found[-1][0]
        return {"time": newest, "names": [n for t, n in found if t == newest]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        seen, last = set(start["names"]), set(end["names"])
        return [
            InputPartition(n) for t, n in self._files()
            if (t > start["time"] or t == start["time"] and n not in seen) and (t < end["time"] or t == end["time"] and n in last)
        ]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from readloom.sources.bam import renamer

        source = bgzf.Source(f"{self.folder}/{partition.value}")
        header = bam.read_header(source, renamer(self.options))
        for buf, starts, ids in bam.records(source, header.first_record, None):
            yield bam.batch(buf, starts, ids, [n for n, _ in header.references], self.columns)
