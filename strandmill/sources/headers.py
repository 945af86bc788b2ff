"""A data source of session files that reads only their header lines.

Spark plans one task for some files each; filters on the key are pushed into the reader,
which then opens only files whose names can hold such a key, so no message is read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Files of a task.
FILES = 64


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class HeaderReader(DataSourceReader):
    def __init__(self, path: str, pattern: str) -> None:
        self.path, self.pattern, self.keys = path, pattern, None

    def _fs(self):
        from pyarrow import fs

        uri = re.sub("^file:/+", "file:///", self.path)
        return fs.FileSystem.from_uri(uri)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and membership of the key; all others are left to Spark."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("key",):
                self.keys = values if self.keys is None else self.keys & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = self._fs()
        found = [i.path for i in system.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file and re.search(self.pattern, i.path)]
        if self.keys is not None:
            found = [p for p in found if re.search(self.pattern, p)[1] in self.keys]
        found.sort()
        return [Files(tuple(found[a : a + FILES])) for a in range(0, len(found), FILES)] or [Files(())]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = self._fs()
        for path in partition.paths:
            with system.open_input_stream(path) as f:
                line = b""
                while b"\n" not in line and (more := f.read(4096)):
                    line += more
            try:
                head = json.loads(line.split(b"\n", 1)[0] or b"null")
            except ValueError:
                continue
            if isinstance(head, dict) and head.get("_type") == "metadata" and (self.keys is None or head.get("key") in self.keys):
                yield head.get("key"), head.get("created_at"), head.get("updated_at"), path


class SessionHeaders(DataSource):
    """Options: path of the folder, and name, a pattern whose first group in a path is the key."""

    @classmethod
    def name(cls) -> str:
        return "session_headers"

    def schema(self) -> str:
        return "key string, created_at string, updated_at string, path string"

    def reader(self, schema) -> DataSourceReader:
        return HeaderReader(self.options["path"], self.options.get("name", r"([^/]+)\.jsonl$"))


def session_headers(spark: SparkSession, path: str, name: str = r"([^/]+)\.jsonl$") -> DataFrame:
    """(key, created_at, updated_at, path) of the sessions below a folder, broken headers left out."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(SessionHeaders)
    return spark.read.format("session_headers").option("name", name).load(path)
