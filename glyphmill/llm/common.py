"""What several operators share: the shared folder, files in it, table reads."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of payload after which a Python stage hands its rows on.
FLUSH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder's URI under ``spark.checkpoint.dir``, which driver and executors share.

    Where a session on one machine has no such setting (tests), a temporary
    folder of this machine is set as its checkpoint folder; a cluster without
    the setting is an error, as its executors couldn't read such a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: a folder that driver and executors share is needed")
        base = "file://" + tempfile.mkdtemp(prefix="glyphmill-")
        spark.sparkContext.setCheckpointDir(base)
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + base
    return f"{base.rstrip('/')}/glyphmill/{uuid.uuid4().hex}"


#: Folders written within each ``temporaries`` block that is open.
_open_blocks: list[list[str]] = []


def materialise(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` to the shared folder (``options``: the writer's) and read it back: later steps neither redo it nor lose it with an executor."""
    spark = df.sparkSession
    at = shared_dir(spark)
    df.write.options(**options).parquet(at)
    for block in _open_blocks[-1:]:
        block.append(at)
    return spark.read.schema(df.schema).parquet(at)


def discard(spark: SparkSession, folders: list[str]) -> None:
    """Delete folders that ``materialise`` wrote and that nothing reads any more, and let Spark's cleaner find the shuffles that made them."""
    for at in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if folders:
        gc.collect()  # the cleaner goes by what the driver's garbage collection finds, on both sides
        spark._jvm.System.gc()


@contextlib.contextmanager
def temporaries(spark: SparkSession) -> Iterator[list[str]]:
    """Delete at the end what is materialised in the block, but for the folders that are taken out of the list it gives."""
    made: list[str] = []
    _open_blocks.append(made)
    try:
        yield made
    finally:
        _open_blocks.remove(made)
        discard(spark, made)


def kept_from(spark: SparkSession, make) -> tuple[DataFrame, str]:
    """``make()`` materialised, without the intermediate folders it needed; and its own folder."""
    with temporaries(spark) as made:
        out = materialise(make())
        at = made.pop()
    for block in _open_blocks[-1:]:
        block.append(at)
    return out, at


#: A group of more rows than this, and than this part of all, has its rows met where they are.
HOT_ROWS, HOT_GROUPS = 1000, 10_000


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], total: int, size: str = "n", most: int | None = None) -> DataFrame:
    """``rows`` joined with the one row of their group in ``groups``, whose column ``size`` counts the group's rows (of ``total``; of the largest group ``most``, if known).

    Rows of hot groups aren't sent to one task: at most HOT_GROUPS groups can
    have more than that part of all rows, so these are broadcast.  Both frames
    are read twice and should be cheap to read.
    """
    least = max(HOT_ROWS, total // HOT_GROUPS)
    if min(total, total if most is None else most) <= least:
        return rows.join(groups.drop(size), on)
    hot = groups.where(F.col(size) > least).drop(size)
    cold = groups.where(F.col(size) <= least).drop(size)
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on))


def in_written_order(df: DataFrame, name: str = "position") -> tuple[DataFrame, int]:
    """``df`` with each row's number, from 0, in the order in which its folder was written; and the number of rows.

    Reads pack and split files by length, so that order is only in the names of
    the parts and in the rows' places in them.  A ``df`` that is not a folder as
    it was read is written first, which keeps its own order.  A column called
    ``name`` is replaced.
    """
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        df = materialise(df)
    spark, columns = df.sparkSession, [c for c in df.columns if c.lower() != name.lower()]
    counts = df.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n")).collect()  # a row for each file
    numbers = lambda file: [int(n) for n in re.findall(r"^part-(\d+)|-c(\d+)\b", file) for n in n if n]
    befores, total = [], 0
    for file, n in sorted(counts, key=lambda r: (numbers(r.file), r.file)):
        befores.append((file, total))
        total += n
    placed = df.select(*columns, F.col("_metadata.file_name").alias("file of row"), F.col("_metadata.row_index").alias("row in file"))
    starts = spark.createDataFrame(befores, "`file of row` string, before long")
    return placed.join(F.broadcast(starts), "file of row").select(*columns, (F.col("before") + F.col("row in file")).alias(name)), total


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it; works on executors, for any store pyarrow knows."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


class StoreWriter:
    """A new file in a store; it gets its name only when it is complete.

    The name holds a fresh uuid, so a second attempt of a task never touches
    the first one's file; only names that a finished task returned are read.
    """

    def __init__(self, folder: str, suffix: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}{suffix}"
        self.fs, self.path = open_store(self.uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.path + ".part")
        self.size = 0

    def write(self, data) -> None:
        self.out.write(data)
        self.size += len(data) if isinstance(data, bytes) else data.nbytes

    def close(self) -> str:
        self.out.close()
        self.fs.move(self.path + ".part", self.path)
        return self.uri


def read_range(uri: str, offset: int, length: int) -> bytes:
    fs, path = open_store(uri)
    with fs.open_input_file(path) as f:
        return f.read_at(length, offset)


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Python rows of Arrow batches, a thousand at a time so that few long texts are live at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            yield from zip(*(part.column(n).to_pylist() for n in names), strict=True)


#: Rows of an Arrow batch: texts are long, and both sides hold whole batches.
BATCH_ROWS = 1000


def map_arrow(df: DataFrame, run, kinds: str) -> DataFrame:
    """``df.mapInArrow`` with batches of at most BATCH_ROWS rows, a setting of the session."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(run, kinds)


def giving_back(run):
    """``run`` of a Python stage; when a task ends, the memory it has freed goes back to the system.

    Workers live on, and else hold it beside what the tasks of later stages need.
    """
    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
                trim(0)

    return lean


def without_collection(work):
    """``work`` without Python's search for cycles, which it makes none of: so many small objects set it off again and again."""
    @functools.wraps(work)
    def calm(*args, **options):
        before = gc.isenabled()
        gc.disable()
        try:
            return work(*args, **options)
        finally:
            if before:
                gc.enable()

    return calm


def forgetting(memo: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; then, or if a task ends early, ``memo`` is emptied: workers outlive tasks."""
    try:
        yield from batches
    finally:
        memo.clear()


def chunks(rows: Iterator[tuple], chars: int, most: int = 10_000) -> Iterator[list[tuple]]:
    """Lists of rows whose second fields have about ``chars`` characters together."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1] or "")
        if size >= chars or len(held) >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def with_columns(df: DataFrame, column: str, kinds: str, work) -> DataFrame:
    """``df`` with more columns (``kinds``: their DDL), which ``work`` makes as tuples from lists of values of ``column``; nothing is shuffled."""
    names = df.columns
    types = pa.schema(df.sparkSession.createDataFrame([], kinds).limit(0).toArrow().schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                made = zip(*work(part.column(names.index(column)).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, f.type) for c, f in zip(made, types, strict=True))], names=[*part.schema.names, *types.names])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return map_arrow(df, run, f"{own}, {kinds}")


def batches_of(rows: Iterator[tuple], schema: pa.Schema, sizes=None, most: int = 4000) -> Iterator[pa.RecordBatch]:
    """Arrow batches of row tuples; ``sizes`` (bytes of a row) also bounds a batch by FLUSH_BYTES."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sizes(row) if sizes else 0
        if len(held) >= most or weight >= FLUSH_BYTES:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
