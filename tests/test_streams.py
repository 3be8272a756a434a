"""Streams that stop and start again: the library's versions, repositories' state, lines of chunks."""

import datetime

import pytest
from pyspark.sql import functions as F

from glyphmill.sources import library
from glyphmill.streaming import state
from glyphmill.streaming.ingest import VersionedTable, ingest

RECORDS = "key string, version long, deleted boolean"


def records(spark, rows):
    data = F.struct(F.lit("book").alias("itemType"), F.concat(F.lit("t"), "version").alias("shortTitle"))
    return spark.createDataFrame(rows, RECORDS).withColumn("data", data)


def stored(into):
    return {(r.key, r.version, r.data.shortTitle) for r in into.read().collect()}


def test_library_in_three_versions_with_a_crash(spark, tmp_path):
    pages, table = f"file://{tmp_path}/pages", f"file://{tmp_path}/table"
    into = VersionedTable(spark, table, f"key string, version bigint, data {library.RECORD[library.RECORD.index('data:') + 5 : -1]}")
    run = lambda t: ingest(library.change_stream(spark, pages), t, "key", "version", F.col("deleted"), f"file://{tmp_path}/checkpoint")
    library.write_version(records(spark, [("a", 1, False), ("b", 2, False), ("c", 3, False)]), pages, 3)
    run(into)
    assert stored(into) == {("a", 1, "t1"), ("b", 2, "t2"), ("c", 3, "t3")}
    # Modified twice and deleted, with a page that is no JSON; the batch is written but its pointer isn't.
    library.write_version(records(spark, [("a", 4, False), ("a", 5, False), ("b", 6, True), ("d", 6, False)]), pages, 6)
    (tmp_path / "pages" / "version=6" / "items" / "more.txt").write_text('no JSON\n{"version": 6}\n[1]\n\n')

    class Crashing(VersionedTable):
        def _point(self, value):
            raise RuntimeError("crash")

    with pytest.raises(Exception, match="crash"):
        run(Crashing(spark, table, into.schema))
    assert stored(into) == {("a", 1, "t1"), ("b", 2, "t2"), ("c", 3, "t3")}
    # A version whose deletions aren't complete yet doesn't count.
    library.write_version(records(spark, [("c", 7, True), ("b", 8, False)]), pages, 8)
    done = tmp_path / "pages" / "version=8" / "deleted" / "_SUCCESS"
    done.rename(tmp_path / "aside")
    run(into)
    assert stored(into) == {("a", 5, "t5"), ("c", 3, "t3"), ("d", 6, "t6")}
    (tmp_path / "aside").rename(done)
    run(into)
    run(into)
    assert stored(into) == {("a", 5, "t5"), ("d", 6, "t6"), ("b", 8, "t8")}
    batch = library.changes(spark, pages, since=3)
    assert {(r.key, r.version, r.deleted) for r in batch.collect()} == {("a", 4, False), ("a", 5, False), ("b", 6, True), ("d", 6, False), ("c", 7, True), ("b", 8, False)}
    assert library.changes(spark, pages, since=8).count() == 0


def test_an_empty_library(spark, tmp_path):
    assert library.changes(spark, f"file://{tmp_path}/none").count() == 0
    library.write_version(records(spark, []), f"file://{tmp_path}/pages", 1)
    assert library.changes(spark, f"file://{tmp_path}/pages").count() == 0


def at(hours, minutes=0):
    return datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(hours=hours, minutes=minutes)


def stream_of(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_states_survive_a_restart(spark, tmp_path):
    schema = "repo string, number long, commit_hash string, code_hash string, at timestamp"
    source, into = f"file://{tmp_path}/source", f"file://{tmp_path}/into"

    def send(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        return {(r.repo, r.number, r.action, r.periods) for r in state.run_to_end(state.refreshed(stream_of(spark, source, schema)), into).collect()}

    first = send([("x", 2, "c1", "k", at(0, 1)), ("x", 1, "c1", "k", at(0)), ("y", 3, "c1", "k", at(0, 2))])
    assert first == {("x", 1, "all", 0), ("x", 2, "skip", 0), ("y", 3, "all", 0)}
    second = send([("x", 4, "c2", "k", at(0, 30)), ("x", 5, "c2", "k2", at(0, 31))]) - first
    assert second == {("x", 4, "changed", 0), ("x", 5, "all", 0)}
    # Nothing of y for three hours and a half, nothing of x for three; z has just come.
    third = send([("z", 6, None, None, at(3, 32))]) - first - second
    assert third == {("z", 6, "all", 0), ("y", None, "refresh", 3), ("x", None, "refresh", 3)}
    fourth = send([("z", 7, None, None, at(3, 40)), ("y", 8, "c1", "k", at(3, 59))]) - first - second - third
    assert fourth == {("z", 7, "skip", 0), ("y", 8, "skip", 0)}
    fifth = send([("z", 9, "c", None, at(5))]) - first - second - third - fourth
    assert fifth == {("z", 9, "changed", 0), ("x", None, "refresh", 1), ("y", None, "refresh", 1)}


def test_lines_go_on_across_batches(spark, tmp_path):
    schema = "source string, number long, chunk string"
    source, into = f"file://{tmp_path}/source", f"file://{tmp_path}/into"
    got = set()
    for rows in ([("a", 1, "on"), ("a", 2, "e\ntw"), ("b", 1, None)], [("a", 3, "o\n\nlong"), ("b", 2, "x\n")], [("a", 4, "er\nend")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        got = {tuple(r) for r in state.run_to_end(state.framed(stream_of(spark, source, schema), most=5), into).collect()}
    assert got == {("a", 0, "one"), ("a", 1, "two"), ("a", 2, ""), ("a", 3, None), ("b", 0, "x")}
