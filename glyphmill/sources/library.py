"""The remote bibliography as a data source: S13 what was modified, S14 what was deleted, since a version.

The library counts its versions: each change raises the number, and a record
has the number of its last change.  A read asks for the pages of what changed
after one version up to another; its offset in a stream is that number, its
partitions are the pages.  What changes while pages are read has a higher
number and belongs to the next read, so nothing is missed or taken twice.

``Folder`` is the transport: pages lie in ``version=<n>/items`` and
``version=<n>/deleted``, a file each, a record a line; a version counts when
both are complete (``_SUCCESS``).  A transport for a server has the same three
methods.

Defined results: lines that are no JSON objects with a key are skipped; empty
files are pages without records; a library without versions is at version 0.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from glyphmill.operators.biblio import RECORD

SCHEMA = "kind string, key string, version bigint, json string"


@dataclass
class Page(InputPartition):
    kind: str
    uri: str
    after: int
    until: int


class Folder:
    """Pages in a folder of any store that pyarrow opens."""

    def __init__(self, uri: str):
        import pyarrow.fs as pafs

        if uri.startswith("file:"):
            self.fs, self.path = pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
        elif uri.startswith("/"):
            self.fs, self.path = pafs.LocalFileSystem(), uri
        else:
            self.fs, self.path = pafs.FileSystem.from_uri(uri)

    def _files(self, folder: str) -> list[str]:
        import pyarrow.fs as pafs

        return sorted(f.path for f in self.fs.get_file_info(pafs.FileSelector(f"{self.path}/{folder}", allow_not_found=True)))

    def versions(self) -> list[int]:
        names = (f.rpartition("/")[2] for f in self._files(""))
        found = sorted(int(n[8:]) for n in names if n.startswith("version=") and n[8:].isdigit())
        done = lambda v, kind: any(f.endswith("/_SUCCESS") for f in self._files(f"version={v}/{kind}"))
        return [v for v in found if done(v, "items") and done(v, "deleted")]

    def pages(self, after: int, until: int) -> list[Page]:
        return [Page(kind, f, after, until) for v in self.versions() if after < v <= until for kind in ("items", "deleted") for f in self._files(f"version={v}/{kind}") if not f.rpartition("/")[2].startswith(("_", "."))]

    def lines(self, uri: str) -> Iterator[str]:
        with self.fs.open_input_stream(uri) as f:
            yield from f.read().decode().splitlines()


def _read(path: str, page: Page) -> Iterator[tuple]:
    for line in Folder(path).lines(page.uri):
        try:
            record = json.loads(line)
        except ValueError:
            continue
        if isinstance(record, dict) and record.get("key") and page.after < int(record.get("version") or 0) <= page.until:
            yield page.kind, record["key"], int(record["version"]), line


class _Batch(DataSourceReader):
    def __init__(self, path: str, after: int):
        self.path, self.after = path, after

    def partitions(self) -> list[Page]:
        folder = Folder(self.path)
        pages = folder.pages(self.after, max(folder.versions(), default=0))
        return pages or [Page("items", "", 0, 0)]

    def read(self, partition: Page) -> Iterator[tuple]:
        return _read(self.path, partition) if partition.uri else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, after: int):
        self.path, self.after = path, after

    def initialOffset(self) -> dict:
        return {"version": self.after}

    def latestOffset(self) -> dict:
        return {"version": max([self.after, *Folder(self.path).versions()])}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return Folder(self.path).pages(start["version"], end["version"]) or [Page("items", "", 0, 0)]

    def read(self, partition: Page) -> Iterator[tuple]:
        return _read(self.path, partition) if partition.uri else iter(())

    def commit(self, end: dict) -> None:
        pass


class Library(DataSource):
    """Options: ``path``, and ``since``, the version after which changes are read (0: all)."""

    @classmethod
    def name(cls) -> str:
        return "library"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Batch:
        return _Batch(self.options["path"], int(self.options.get("since", 0)))

    def streamReader(self, schema) -> _Stream:
        return _Stream(self.options["path"], int(self.options.get("since", 0)))


def _parsed(changes: DataFrame) -> DataFrame:
    """(key, version, data, deleted): deleted records have no data."""
    data = F.from_json("json", RECORD)["data"]
    return changes.select("key", "version", F.when(F.col("kind") == "items", data).alias("data"), (F.col("kind") == "deleted").alias("deleted"))


def changes(spark: SparkSession, path: str, since: int = 0) -> DataFrame:
    spark.dataSource.register(Library)
    return _parsed(spark.read.format("library").option("path", path).option("since", str(since)).load())


def change_stream(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(Library)
    return _parsed(spark.readStream.format("library").option("path", path).load())


def write_version(records: DataFrame, path: str, version: int, deleted: str = "deleted") -> None:
    """Pages of a version of a library in a folder: ``records`` has key, version, data and a boolean column ``deleted``."""
    at = f"{path.rstrip('/')}/version={version}"
    records.where(F.col(deleted)).select(F.to_json(F.struct("key", "version"))).write.text(f"{at}/deleted")
    records.where(~F.col(deleted)).select(F.to_json(F.struct("key", "version", "data"))).write.text(f"{at}/items")
