"""Ranked lexical search: short lists are summed a term at a time, long ones are walked a document at a time.

The index has a row for each segment of documents: their ids and lengths, the
segment's terms, and for each term the documents that hold it (as gaps) with
its occurrences there.  Tasks write these rows to the shared folder and read
them there one at a time; Spark's own rows only say where they are.  A task
searches its segments one after the other for all queries.  For a query it first sums the weighted parts of its short lists
into accumulators, which then are one bounded iterator among those of the long
lists.  Together they are walked by ascending document, a block of documents at
a time for the sake of numpy: a block whose bounds add up to less than the k-th
best score so far is skipped; in another one only documents that an essential
iterator holds are candidates, and each further list is probed, the largest
bound first, for candidates that can still reach that score.  Skipping loses
nothing, as bounds are exact maxima and a score equal to the k-th is kept.
k-th best scores are carried from segment to segment of a task; what tasks
found is ranked at the end, ``top`` rows of a query and segment at most.

Defined results: null and empty texts have no terms and aren't counted;
repeated rows are documents of their own; rows of a null id rank after equal
scores of other ids; a query without terms, or with none that a document
holds, gets no rows; repeated queries get rows each; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import StoreWriter, batches_of, giving_back, map_arrow, materialise, open_store, rows_of, shared_dir

#: The weight's scale, and the parts of a score.
SCALE, SATURATED, PER_TF, PER_LENGTH = 1000, 1_000_000_000, 1000, 8
BASE, SLOPE = 100, 75
#: Bytes of text in a segment; documents of a block; a list is short that holds less than one of so many of the segment's documents.
SEGMENT_BYTES, BLOCK, SHORT = 8 << 20, 512, 16
#: Queries and their terms that a task reads at a time; segments that a task searches.
QUERY_ROWS, TERM_ROWS, TASK_SEGMENTS = 2000, 50_000, 4

#: A-Z to lower case; bytes below 0x80 but digits and letters to blanks.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())

SEGMENT = pa.schema([("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("terms", pa.list_(pa.binary())), ("counts", pa.list_(pa.int32())), ("gaps", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())), ("n_docs", pa.int64()), ("n_terms", pa.int64())])
LISTED = pa.schema([("file", pa.string()), ("number", pa.int64()), ("n_docs", pa.int64()), ("n_terms", pa.int64())])


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


# ---- the index

class Numbers(dict):
    """Numbers of terms, given as they are first seen."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def _segment(ids: list[int | None], found: list[np.ndarray], terms: Numbers) -> pa.RecordBatch:
    """A segment's row: occurrences are put in order by term and document; what is equal becomes one posting."""
    lengths = np.fromiter(map(len, found), np.int32, len(found))
    keys = np.concatenate(found).astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), lengths)
    keys.sort()
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    term, doc = np.divmod(keys[first], len(ids))
    counts = np.bincount(term, minlength=len(terms)).astype(np.int32)
    gaps, starts = np.diff(doc, prepend=0), np.cumsum(counts) - counts
    gaps[starts] = doc[starts]
    tfs = np.diff(first, append=len(keys))
    columns = ids, lengths, list(terms), counts, gaps.astype(np.int32), tfs.astype(np.int32), len(ids), int(lengths.sum(dtype=np.int64))
    return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(columns, SEGMENT, strict=True)], schema=SEGMENT)


def build(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all terms of all texts, written to the shared folder: (file, number, n_docs, n_terms) of every segment."""
    folder = shared_dir(df.sparkSession)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, terms, size = [], [], Numbers(), 0
        for doc, text in rows_of(batches, "i", "t"):
            words = terms_of(text or b"")
            if not words:
                continue
            ids.append(doc)
            found.append(np.fromiter(map(terms.__getitem__, words), np.int32, len(words)))
            size += len(text)
            if size >= SEGMENT_BYTES:
                yield _segment(ids, found, terms)
                ids, found, terms, size = [], [], Numbers(), 0
        if ids:
            yield _segment(ids, found, terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, made = None, []
        for segment in segments(batches):
            if out is None:
                out = StoreWriter(folder, ".arrow")
                writer = pa.ipc.new_file(out.out, SEGMENT, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            writer.write_batch(segment)
            made.append((out.uri, len(made), *(segment.column(n)[0].as_py() for n in ("n_docs", "n_terms"))))
        if out is not None:
            writer.close()
            out.close()
        yield from batches_of(iter(made), LISTED)

    rows = df.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("binary").alias("t"))
    return materialise(map_arrow(rows, giving_back(run), "file string, number long, n_docs long, n_terms long"))


def _stored(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The listed segments, one at a time; of other columns than those asked for nothing is read."""
    fields = sorted(SEGMENT.get_field_index(c) for c in columns)
    for uri, number in rows_of(batches, "file", "number"):
        fs, path = open_store(uri)
        with fs.open_input_file(path) as f:
            yield pa.ipc.open_file(f, options=pa.ipc.IpcReadOptions(included_fields=fields)).get_batch(number)


def _dealt(index: DataFrame) -> DataFrame:
    """The list of segments, a few for each task."""
    return index.repartition(max(1, -(-index.count() // TASK_SEGMENTS)))


# ---- the queries

def weighted(index: DataFrame, queries: DataFrame, id_col: str, text_col: str, n_docs: int) -> DataFrame:
    """(row, query, terms, weights) of every query with a term that a document holds; a term's weight counts its repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("row", pa.int64()), ("query", pa.int64()), ("term", pa.binary()), ("times", pa.int64())])
        yield from batches_of(((row, query, term, times) for row, query, text in rows_of(batches, "row", "query", "t") for term, times in Counter(terms_of(text or b"")).items()), schema)

    numbered = queries.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("query"), F.col(text_col).cast("binary").alias("t"))
    asked = materialise(numbered.mapInArrow(run, "row long, query long, term binary, times long"))
    files = materialise(asked.select("term").distinct()).inputFiles()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segment in _stored(batches, ("terms", "counts")):
            terms, counts = (segment.column(n).flatten() for n in ("terms", "counts"))
            for block in _stored_rows(files, ["term"], TERM_ROWS):
                known = pc.is_in(terms, value_set=block.column("term"))
                yield pa.RecordBatch.from_arrays([terms.filter(known), counts.filter(known).cast(pa.int64())], names=["term", "df"])

    held = _dealt(index).mapInArrow(counted, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(float(SCALE)) * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    parts = asked.join(held, "term").withColumn("weight", weight * F.col("times")).where("weight > 0")
    return parts.groupBy("row", "query").agg(F.collect_list(F.struct("term", "weight")).alias("x")).select("row", "query", F.col("x.term").alias("terms"), F.col("x.weight").alias("weights"))


# ---- the search of a segment

@dataclass(frozen=True)
class Postings:
    """A term's documents in a segment, ascending; what each gets for one unit of weight; the largest such part in each block; where the blocks start."""

    docs: np.ndarray
    parts: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray


class Segment:
    """A row of the index, decoded list by list as queries ask for them."""

    def __init__(self, ids, lengths, terms, counts, gaps, tfs, n_docs: int, n_terms: int):
        self.ids, self.terms, self.gaps, self.tfs = ids, terms, gaps, tfs
        self.size, self.blocks = len(lengths), -(-len(lengths) // BLOCK)
        self.ends = np.cumsum(counts, dtype=np.int64)
        self.begins = self.ends - counts
        self.edges = np.arange(self.blocks + 1) * BLOCK
        lengths = lengths.astype(np.int64)
        if SLOPE * int(lengths.max(initial=0)) * n_docs < 1 << 63:
            self.m = BASE - SLOPE + SLOPE * lengths * n_docs // n_terms
        else:
            self.m = np.array([BASE - SLOPE + SLOPE * int(n) * n_docs // n_terms for n in lengths], np.int64)
        self.known: dict[int, Postings] = {}

    def postings(self, term: int) -> Postings:
        if term not in self.known:
            a, b = self.begins[term], self.ends[term]
            docs, tf = np.cumsum(self.gaps[a:b]), self.tfs[a:b].astype(np.int64)
            parts = SATURATED * tf // (PER_TF * tf + PER_LENGTH * self.m[docs])
            self.known[term] = self._bounded(docs, parts)
        return self.known[term]

    def _bounded(self, docs: np.ndarray, parts: np.ndarray) -> Postings:
        starts, bounds = np.searchsorted(docs, self.edges), np.zeros(self.blocks, np.int64)
        full = np.flatnonzero(np.diff(starts))
        if len(full):
            bounds[full] = np.maximum.reduceat(parts, starts[full])
        return Postings(docs, parts, bounds, starts)

    def best(self, asked: list[tuple[int, int]], least: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of at most ``top`` documents with a score of at least ``least``; ``asked`` has terms and their weights."""
        lists = [(self.postings(t), w) for t, w in asked]
        short = [x for x in lists if len(x[0].docs) * SHORT < self.size]
        walked = [x for x in lists if len(x[0].docs) * SHORT >= self.size]
        if short:  # term at a time
            sums = np.zeros(self.size, np.int64)
            for p, w in short:
                sums[p.docs] += w * p.parts
            docs = np.flatnonzero(sums)
            walked.append((self._bounded(docs, sums[docs]), 1))
        if not walked:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        bounds = np.array([p.bounds * w for p, w in walked])
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for block in np.flatnonzero(bounds.sum(axis=0) >= least):  # documents at a time
            if bounds[:, block].sum() < least:  # which may have risen
                continue
            got, values = self._block(walked, bounds[:, block], int(block), least)
            docs, scores = np.append(docs, got), np.append(scores, values)
            if len(docs) > top:
                docs, scores = self._first(docs, scores, top)
            if len(docs) == top:
                least = max(least, int(scores.min()))
        return self._first(docs, scores, top)

    def _block(self, walked: list[tuple[Postings, int]], bounds: np.ndarray, block: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """A block's documents that reach ``least``, with their scores."""
        order = np.argsort(bounds, kind="stable")
        order = order[bounds[order] > 0]
        below = np.concatenate(([0], np.cumsum(bounds[order])))  # what the lists before one can add up to
        essential = int(np.searchsorted(below[1:], least))  # documents that only lists before this one hold can't reach it
        sums, lo = np.zeros(BLOCK, np.int64), block * BLOCK
        for k in order[essential:]:
            p, w = walked[k]
            a, b = p.starts[block], p.starts[block + 1]
            sums[p.docs[a:b] - lo] += w * p.parts[a:b]
        found = np.flatnonzero((sums > 0) & (sums + below[essential] >= least))
        values = sums[found]
        for at in range(essential - 1, -1, -1):
            if not len(found):
                break
            p, w = walked[order[at]]
            a, b = p.starts[block], p.starts[block + 1]
            place = np.searchsorted(p.docs[a:b], found + lo) + a
            hit = p.docs[np.minimum(place, b - 1)] == found + lo
            values[hit] += w * p.parts[place[hit]]
            may = values + below[at] >= least
            found, values = found[may], values[may]
        return found + lo, values

    def _first(self, docs: np.ndarray, scores: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        ids = [(i is None, i or 0) for i in map(self.ids.__getitem__, docs.tolist())]
        order = sorted(range(len(docs)), key=lambda k: (-scores[k], ids[k]))[:top]
        return docs[order], scores[order]


def _stored_rows(files: list[str], columns: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    for uri in files:
        fs, path = open_store(uri)
        with fs.open_input_file(path) as f:
            yield from pq.ParquetFile(f).iter_batches(rows, columns=columns)


def _searched(segment: Segment, queries: pa.RecordBatch, kth: dict[int, np.ndarray], top: int) -> Iterator[tuple]:
    """Rows of the segment's best documents of a block of queries; ``kth`` has each query's best scores so far."""
    asked = queries.column("terms")
    places = pc.index_in(asked.values, value_set=segment.terms).fill_null(-1).to_numpy(zero_copy_only=False)
    weights, offsets = queries.column("weights").values.to_numpy(), asked.offsets.to_numpy()
    for k, (row, query) in enumerate(zip(queries.column("row").to_pylist(), queries.column("query").to_pylist(), strict=True)):
        a, b = offsets[k], offsets[k + 1]
        known = np.flatnonzero(places[a:b] >= 0) + a
        if not len(known):
            continue
        best = kth.get(row, np.zeros(top, np.int64))
        docs, scores = segment.best(list(zip(places[known].tolist(), weights[known].tolist(), strict=True)), max(1, int(best[0])), top)
        if len(docs):
            kth[row] = np.sort(np.concatenate((best, scores)))[-top:]
        yield from ((row, query, segment.ids[d], s) for d, s in zip(docs.tolist(), scores.tolist(), strict=True))


def search(index: DataFrame, queries: DataFrame, top: int = 10, query_id: str = "item_id", query_text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(query_id, rank, id_col, score) of each query's ``top`` best documents."""
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    files = materialise(weighted(index, queries, query_id, query_text, n_docs)).inputFiles()
    schema = pa.schema([("row", pa.int64()), ("query", pa.int64()), ("doc", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kth: dict[int, np.ndarray] = {}

        def found() -> Iterator[tuple]:
            for row in _stored(batches, ("ids", "lengths", "terms", "counts", "gaps", "tfs")):
                lists = {name: row.column(name).flatten() for name in row.schema.names}
                lengths, counts, gaps, tfs = (lists[name].to_numpy() for name in ("lengths", "counts", "gaps", "tfs"))
                segment = Segment(lists["ids"].to_pylist(), lengths, lists["terms"], counts, gaps, tfs, n_docs, n_terms)
                yield from itertools.chain.from_iterable(_searched(segment, q, kth, top) for q in _stored_rows(files, ["row", "query", "terms", "weights"], QUERY_ROWS))

        yield from batches_of(found(), schema)

    found = materialise(_dealt(index).mapInArrow(giving_back(run), "row long, query long, doc long, score long"))
    by_score = Window.partitionBy("row", "query").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    ranked = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= top)
    return ranked.select(F.col("query").alias(query_id), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(id_col), "score")


ORACLE = r"""
with t as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents where text is not null),
d as (select doc_id, count(*)::bigint as n from t group by doc_id),
g as (select count(*)::bigint as big_n, sum(n)::bigint as big_l from d),
p as (select doc_id, term, count(*)::bigint as tf from t group by all),
w as (select term, floor(1000 * ln((2 * big_n + 2)::double / (2 * count(*) + 1)::double))::bigint as w from p, g group by term, big_n),
q as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark where text is not null),
a as (select item_id, term, count(*)::bigint as times from q group by all),
s as (select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * big_n) // big_l))))::bigint as score
      from a join w using (term) join p using (term) join d using (doc_id), g group by item_id, doc_id)
select item_id, rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from s where score > 0) where rank <= 10
"""
