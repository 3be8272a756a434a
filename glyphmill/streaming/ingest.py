"""Ingestion as a stream of files: changes are applied batch by batch to a versioned table.

K1, K10, K11, K13: each batch writes the next version beside the current one
and then moves a pointer to it, so readers see whole versions only; a batch
that comes again after a failure is found to be applied already.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glyphmill.operators.relational import latest


#: Versions that are kept for readers that began before a newer one came.
RETAINED = 5


class VersionedTable:
    """A table in a folder that any Hadoop file system has: ``v<N>`` folders, and a pointer ``current-<N>`` for each that is complete.

    A pointer is written beside its name and then renamed, which happens whole
    or not at all, and no pointer is deleted before a newer one stands; so
    after a crash at any moment the newest pointer is that of the last whole
    version.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType | str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.schema = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        return sorted(int(n.removeprefix("current-")) for n in names if n.startswith("current-") and n[8:].isdigit())

    def _pointer(self) -> dict:
        versions = self._versions()
        if not versions:
            return {"version": -1, "batch": -1}
        stream = self._fs.open(self._path(f"{self.folder}/current-{versions[-1]:012d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _point(self, value: dict) -> None:
        new = self._path(f"{self.folder}/new-{uuid.uuid4().hex}")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        if not self._fs.rename(new, self._path(f"{self.folder}/current-{value['version']:012d}")):
            raise OSError(f"version {value['version']} of {self.folder} has a pointer already")
        for old in self._versions()[:-RETAINED]:
            self._fs.delete(self._path(f"{self.folder}/current-{old:012d}"), False)
            self._fs.delete(self._path(f"{self.folder}/v{old}"), True)

    def read(self) -> DataFrame:
        version = self._pointer()["version"]
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/v{version}") if version >= 0 else self.spark.createDataFrame([], self.schema)

    def apply(self, changes: DataFrame, key: str, version: str, deleted: Column, batch: int) -> None:
        """Upsert the highest version of each key and drop those that it deletes; nothing if the batch was applied before."""
        at = self._pointer()
        if batch <= at["batch"]:
            return
        columns = [f.name for f in self.schema]
        gone = changes.withColumn("_gone", deleted)
        newest = latest(gone, key, version, "_gone", *[c for c in columns if c not in (key, version)])
        kept = self.read().join(newest.select(key), key, "left_anti")
        kept.select(*columns).unionByName(newest.where("not _gone").select(*columns)).write.mode("overwrite").parquet(f"{self.folder}/v{at['version'] + 1}")
        self._point({"version": at["version"] + 1, "batch": batch})


def ingest(source: DataFrame, into: VersionedTable, key: str, version: str, deleted: Column, checkpoint: str, every: str | None = None):
    """Apply a streaming source's changes: all that it has now (the finished query is returned), or with ``every`` (as ``10 seconds``) batch after batch, no oftener than that (ST2, ST3).

    How much a batch takes is the source's ``maxFilesPerTrigger``.  A batch that
    fails ends the query; started again with its checkpoint it goes on from that batch.
    """
    writer = source.writeStream.foreachBatch(lambda df, n: into.apply(df, key, version, deleted, n)).option("checkpointLocation", checkpoint)
    if every:
        return writer.trigger(processingTime=every).start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def refreshes(spark: SparkSession, seconds: int = 3600) -> DataFrame:
    """A stream of the event ``all``: one at the start, then one each so many seconds."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.where(F.col("value") % seconds == 0).select(F.lit("all").alias("value"))


def due(repos: DataFrame, seen: DataFrame) -> DataFrame:
    """ST5, ST6: (repo, action) of repositories (repo, commit_hash, code_hash) against the state that was stored for them.

    ``skip`` if both hashes are as before, ``all`` (every file again) if only
    the code's differs or nothing is stored, else ``changed``.
    """
    before = seen.select("repo", F.col("commit_hash").alias("_commit"), F.col("code_hash").alias("_code"))
    joined = repos.join(before, "repo", "left")
    same_commit, same_code = F.col("commit_hash").eqNullSafe(F.col("_commit")), F.col("code_hash").eqNullSafe(F.col("_code"))
    action = F.when(same_commit & same_code, "skip").when(~same_code, "all").otherwise("changed")
    return joined.select("repo", action.alias("action"))


def webhook_names(events: DataFrame, robots: list[str]) -> DataFrame:
    """Names of repositories that someone else than robots pushed to; ``events`` has JSON in ``value``."""
    kind = "struct<repository:struct<name:string>,commits:array<struct<author:struct<email:string>>>>"
    parsed = events.select(F.from_json("value", kind).alias("e"))
    human = F.exists("e.commits", lambda c: ~F.coalesce(c["author"]["email"], F.lit("")).isin(*robots))
    return parsed.where(human).select(F.col("e.repository.name").alias("name"))


def routed(events: DataFrame, known: DataFrame) -> DataFrame:
    """(name, action): ``all``, ``bib``, ``repository`` for a known one, else ``junk``."""
    name = F.trim("value")
    joined = events.select(name.alias("name")).join(known.select(F.col("repo").alias("name"), F.lit(True).alias("_known")), "name", "left")
    action = F.when(F.col("name").isin("all", "bib"), F.col("name")).when(F.col("_known"), "repository").otherwise("junk")
    return joined.select("name", action.alias("action"))
