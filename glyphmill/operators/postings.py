"""A postings index over folded texts, for searches that read only what their terms need.

Q5, Q8: the index has three tables in a folder.  ``documents`` has the folded
fields, each row with a number; ``lists`` has, for each gram (a trigram or a
word, behind its field's name) and each block of numbers, the sorted places in
that block and how often the gram stands there; it is range-partitioned by gram
into parts, delta-coded by Parquet's encoding; ``directory`` has the first and
last gram of each part.  A search looks up its grams' parts in the directory,
reads these parts' row groups with the grams, intersects the rarest lists
first, and tests the texts of the documents that are left, from the folders
that hold them.

Q15: ranking, facets and snippets go by words.  A word's weight in a document
is an integer, floor(1000 ln(N / df)) (1000 + floor(1000 ln tf)), so scores are
exact.  A block's bound adds up the weights of its largest counts, which are
stored beside the lists; after the blocks with the largest bounds are scored,
only blocks are read whose bounds reach the k-th score.

Defined results: null fields count as empty ones; repeated keys are documents
of their own; an empty index gives empty results; terms of fewer than three
characters match nothing, as in the catalogue.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glyphmill.functions.text import trigrams
from glyphmill.operators.catalog import LEAST_TERM, Exact, Op, Term, condition

#: Documents of a block, as a power of two; a file of documents holds one range of numbers.
BLOCK_BITS, SEGMENT_BITS = 12, 33
#: Blocks that are scored first, to find the least score of a page.
FIRST_BLOCKS = 4
#: Lines that a Python stage gets at a time.
BATCH_LINES = 1000
LISTS = "gram string, block long, n int, most int, places array<int>, tfs array<int>, part int"
#: What a word is.
WORD = r"[\p{L}\p{N}]+"


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({WORD})"), F.lit(1))


@dataclass(frozen=True)
class Index:
    documents: DataFrame
    lists: DataFrame
    directory: DataFrame
    key: str
    fields: tuple[str, ...]


def build(df: DataFrame, key: str, fields: list[str], folder: str, grams: Callable[[Column], Column] = trigrams, carry: tuple[str, ...] = ()) -> Index:
    """Write the index of ``fields``, which are folded already; ``carry`` are more columns of its documents.

    The texts are not shuffled; grams are, once counted within their tasks.
    """
    spark = df.sparkSession
    numbered = df.select(key, *carry, *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields], F.monotonically_increasing_id().alias("number"))
    numbered = numbered.withColumn("segment", F.shiftright("number", SEGMENT_BITS).cast("int"))
    numbered.write.partitionBy("segment").parquet(f"{folder}/documents")
    documents = spark.read.schema(numbered.schema).parquet(f"{folder}/documents")
    found = F.concat(*[F.transform(grams(F.col(f)), _behind(f)) for f in fields])
    block, place = F.shiftright("number", BLOCK_BITS), F.col("number").bitwiseAND((1 << BLOCK_BITS) - 1).cast("int")
    counted = documents.select("number", F.explode(found).alias("gram")).groupBy("gram", "number").agg(F.count("*").cast("int").alias("tf"))
    own = counted.groupBy("gram", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct(place.alias("place"), "tf"))).alias("p"))
    lists = own.select("gram", "block", F.size("p").alias("n"), F.array_max("p.tf").alias("most"), F.col("p.place").alias("places"), F.col("p.tf").alias("tfs"))
    sorted_lists = lists.repartitionByRange("gram", "block").withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", "gram", "block")
    delta = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false", "parquet.block.size": str(16 << 20)}
    sorted_lists.write.options(**delta).partitionBy("part").parquet(f"{folder}/lists")
    spark.read.schema(LISTS).parquet(f"{folder}/lists").groupBy("part").agg(F.min("gram").alias("first"), F.max("gram").alias("last"), F.count("*").alias("lists")).coalesce(1).write.parquet(f"{folder}/directory")
    return open_index(spark, folder, key, fields, numbered.schema)


def _behind(field: str) -> Callable[[Column], Column]:
    return lambda gram: F.concat(F.lit(f"{field}:"), gram)


def open_index(spark: SparkSession, folder: str, key: str, fields: list[str], documents: StructType) -> Index:
    """The index in a folder; ``documents`` is the schema of its documents."""
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{folder}/{name}")
    lists = read("lists", LISTS)
    return Index(read("documents", documents), lists, read("directory", "part int, first string, last string, lists long"), key, tuple(fields))


def lists_of(index: Index, grams: list[str]) -> DataFrame:
    """The lists of some grams, from the parts that the directory names."""
    if not grams:
        return index.lists.limit(0)
    holds = reduce(Column.__or__, [(F.col("first") <= g) & (F.col("last") >= g) for g in grams])
    parts = [r["part"] for r in index.directory.where(holds).select("part").collect()]  # those of the grams' own lists
    return index.lists.where(F.col("part").isin(parts) & F.col("gram").isin(grams)) if parts else index.lists.limit(0)


def _number() -> Column:
    return F.shiftleft(F.col("block"), BLOCK_BITS) + F.col("place")


# ---- search by trigrams

def candidates(index: Index, node) -> DataFrame | None:
    """Numbers of the documents that can fulfil a query; None if its grams exclude none."""
    if isinstance(node, Op) and node.kind == "and":
        parts = [c for c in (candidates(index, p) for p in node.parts) if c is not None]
        return reduce(lambda a, b: a.join(b, "number", "left_semi"), parts) if parts else None
    if isinstance(node, Op) and node.kind == "or":
        parts = [candidates(index, p) for p in node.parts]
        return None if any(p is None for p in parts) else reduce(DataFrame.union, parts).distinct()
    if not isinstance(node, Term):
        return None
    text = node.text if len(node.text) >= LEAST_TERM else ""
    own = {text[i : i + 3] for i in range(len(text) - 2)}
    fields = [node.field] if node.field else index.fields
    lists = lists_of(index, [f"{f}:{g}" for f in fields for g in sorted(own)])
    grouped = lists.groupBy(F.substring_index("gram", ":", 1).alias("field"), "block").agg(F.sort_array(F.collect_list(F.struct("n", "places"))).alias("x"))
    whole = grouped.where(F.size("x") == len(own)).select("block", F.col("x.places").alias("x"))
    # The shortest list first: what is left of it only shrinks.
    both = F.aggregate(F.slice("x", 2, F.size("x")), F.element_at("x", 1), F.array_intersect)
    return whole.select("block", F.explode(both).alias("place")).select(_number().alias("number")).distinct()


def search(index: Index, node) -> DataFrame:
    """The index's documents that a parsed query selects: candidates by their lists, then a test of their texts."""
    found, documents = candidates(index, node), index.documents
    if found is not None:
        found = found.persist()  # numbers of candidates; read for their folders and for the join
        segments = [r["s"] for r in found.select(F.shiftright("number", SEGMENT_BITS).alias("s")).distinct().collect()]  # one for each file of documents at most
        documents = documents.where(F.col("segment").isin(segments)).join(found, "number", "left_semi") if segments else documents.limit(0)
    return documents.where(condition(node, {f: F.col(f) for f in index.fields})).drop("number", "segment")


# ---- ranking by words

def _weighted(index: Index, lists: DataFrame) -> DataFrame:
    """The lists with their gram's idf; only counts are read for it."""
    total = index.documents.count()
    held = lists.groupBy("gram").agg(F.sum("n").alias("df")).select("gram", F.floor(1000 * F.log(F.lit(float(total)) / F.col("df"))).cast("long").alias("idf"))
    return lists.join(F.broadcast(held), "gram")  # one row for each word of the query


def weight_of(tf: Column) -> Column:
    return 1000 + F.floor(1000 * F.log(tf.cast("double"))).cast("long")


def _scores(weighted: DataFrame) -> DataFrame:
    postings = weighted.select("block", "idf", F.explode(F.arrays_zip("places", "tfs")).alias("p")).select("block", "idf", F.col("p.places").alias("place"), F.col("p.tfs").alias("tf"))
    return postings.groupBy("block", "place").agg(F.sum(F.col("idf") * weight_of(F.col("tf"))).alias("score")).where("score > 0").select(_number().alias("number"), "score")


def ranked(index: Index, query: list[str], field: str, size: int) -> DataFrame:
    """(key, rank, score) of the ``size`` documents that score highest, equal ones by key."""
    weighted = _weighted(index, lists_of(index, [f"{field}:{w}" for w in sorted(set(query))]))
    bounds = weighted.groupBy("block").agg(F.sum(F.col("idf") * weight_of(F.col("most"))).alias("bound")).persist()  # no list is read for it
    first = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(FIRST_BLOCKS).select("block").collect()]
    kth = _scores(weighted.where(F.col("block").isin(first))).orderBy(F.desc("score")).limit(size).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
    least = kth["least"] if kth["n"] == size else 0
    scored = _scores(weighted.join(bounds.where(F.col("bound") >= least).select("block"), "block", "left_semi")).where(F.col("score") >= least)
    best = scored.join(index.documents.select("number", index.key), "number").orderBy(F.desc("score"), index.key).limit(size)
    order = Window.orderBy(F.desc("score"), index.key)  # over ``size`` rows
    return best.select(index.key, F.row_number().over(order).alias("rank"), "score")


def holding(index: Index, query: list[str], field: str) -> DataFrame:
    """The index's documents with any of the words."""
    lists = lists_of(index, [f"{field}:{w}" for w in sorted(set(query))])
    numbers = lists.select("block", F.explode("places").alias("place")).select(_number().alias("number")).distinct()
    return index.documents.join(numbers, "number", "left_semi").drop("number", "segment")


def facets(found: DataFrame, names: list[str]) -> DataFrame:
    """(facet, value, n): how many of the documents have each value of each facet, all facets counted in one pass."""
    counts = found.groupingSets([[F.col(n)] for n in names], *names).agg(F.count("*").alias("n"), F.grouping_id(*names).alias("g"))
    bits = {n: (1 << len(names)) - 1 - (1 << (len(names) - 1 - k)) for k, n in enumerate(names)}
    facet = F.coalesce(*[F.when(F.col("g") == b, F.lit(n)) for n, b in bits.items()])
    value = F.coalesce(*[F.when(F.col("g") == b, F.col(n).cast("string")) for n, b in bits.items()])
    return counts.select(facet.alias("facet"), value.alias("value"), "n")


def snippets(df: DataFrame, key: str, text: str, fold: Callable[[Column], Column], weights: dict[str, int], width: int = 120) -> DataFrame:
    """(key, line, start, n_matches, snippet): of each text the stretch of at most ``width`` characters, from one match to another, that weighs most; the first of equal ones.

    Matches are words of the displayed text whose folded form is asked for, so
    places are those of the display.  A snippet is filled up with the words that
    follow and stays within its paragraph (a line of the text); "[...]" marks
    where the paragraph goes on.  Texts are read twice, first for the forms in
    which the words are written; only snippets are shuffled.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_LINES))
    lines = df.select(key, F.monotonically_increasing_id().alias("row"), F.posexplode(F.split(text, "\n")).alias("line", "t"))
    cut = lines.select(F.col(key).alias("key"), "row", F.col("line").cast("long").alias("line"), F.regexp_extract_all("t", F.lit(rf"({WORD}|[^\p{{L}}\p{{N}}]+)"), F.lit(1)).alias("parts"))

    def different(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("parts").flatten().unique()], names=["part"])

    forms = cut.select("parts").mapInArrow(different, "part string")
    weighed = forms.select("part", F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), fold(F.col("part"))).cast("long").alias("w"))
    asked = weighed.where("w > 0").distinct().collect()  # a row for each way to write a word that is asked for
    written, worth = pa.array([r["part"] for r in asked], pa.string()), np.array([r["w"] for r in asked], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _heaviest(batch, written, worth, width)

    kinds = f"key {df.schema[key].dataType.simpleString()}, line long, start long, n_matches long, weight long, snippet string"
    first = Window.partitionBy("key").orderBy(F.desc("weight"), "line", "start")
    best = cut.mapInArrow(run, kinds).withColumn("row", F.row_number().over(first)).where("row = 1")
    return best.select(F.col("key").alias(key), "line", "start", "n_matches", "snippet")


def _heaviest(batch: pa.RecordBatch, written: pa.Array, worth: np.ndarray, width: int) -> pa.RecordBatch:
    """The best snippet of each text that has lines in the batch; places are counted through all its lines."""
    lists = batch.column("parts")
    parts, edges = lists.flatten(), np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
    stops = np.concatenate(([0], np.cumsum(pc.utf8_length(parts).to_numpy(zero_copy_only=False), dtype=np.int64)))  # of each part, one place on
    form = pc.index_in(parts, value_set=written).fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(form >= 0)
    line = np.searchsorted(edges, at, "right") - 1
    begin, end, start = stops[edges[line]], stops[edges[line + 1]], stops[at]
    # A match belongs to the stretch that begins at another one if it ends within its width; a longer word alone is a stretch too.
    reach, own = np.minimum(start + width, end), np.arange(len(at))
    last = np.maximum(np.searchsorted(stops[at + 1], reach, "right"), own + 1)
    sums = np.concatenate(([0], np.cumsum(worth[form[at]])))
    weight = sums[last] - sums[own]
    rows = batch.column("row").to_numpy()[line]
    order = np.lexsort((at, -weight, rows))
    best = order[np.flatnonzero(np.diff(rows[order], prepend=-1))]
    ends = np.maximum(np.searchsorted(stops[1:], reach[best], "right"), at[best] + 1)
    shown = []
    for k, stop in zip(best.tolist(), ends.tolist(), strict=True):
        body = "".join(parts.slice(at[k], stop - at[k]).to_pylist())
        shown.append(("[...]" if start[k] > begin[k] else "") + body + ("[...]" if stops[stop] < end[k] else ""))
    lined = line[best]
    columns = batch.column("key").take(pa.array(lined)), batch.column("line").take(pa.array(lined)), pa.array((start - begin)[best]), pa.array((last - own)[best]), pa.array(weight[best]), pa.array(shown, pa.string())
    return pa.RecordBatch.from_arrays(list(columns), names=["key", "line", "start", "n_matches", "weight", "snippet"])
