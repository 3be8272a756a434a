"""Token files: flat unsigned ids beside 64-bit document offsets, memory-mapped when read.

Each task of a range-partitioned, sorted table writes ``.bin`` (the ids, 16 or
32 bits each as the vocabulary needs, little-endian, nothing else) and ``.idx`` (three arrays: n + 1
offsets in ids as unsigned 64-bit integers from 0, n document ids as signed
64-bit integers, n bytes that are 1 where that id is null).  The manifest has
a row per pair of files; a running sum of its token counts gives each pair's
base, so a document's place in the whole is base + offset.  The manifest has
the ids' width too; an id that doesn't fit is an error.

Defined results: a null text is an empty one and has just the end id; null
document ids come first; rows with equal document ids follow each other in the order of
their texts' hashes; an empty table has no files and no rows; other columns of the
input are ignored.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from glyphmill.llm.common import StoreWriter, batches_of, chunks, materialise, open_store, rows_of, shared_dir

#: Parts kept per Python worker before its memory of them is emptied; longer ones count by their characters too.
MEMO_ENTRIES, MEMO_CHARS = 1_200_000, 48


class _Numbers(dict):
    """Numbers parts as they are asked for; ``new`` has those that came last."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, part: str) -> int:
        self[part] = n = len(self)
        self.new.append(part)
        return n


class WordTokenizer:
    """Ids of whole texts by a ``tokenizers`` file that drops white space and never joins words across it.

    Texts are cut at spaces and line feeds only; each distinct part goes
    through the library once and its ids stay in one flat array.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        fs, at = open_store(path)
        with fs.open_input_stream(at) as f:
            self.tokenizer = Tokenizer.from_str(f.read().decode())
        self.clear()

    def clear(self) -> None:
        self.number, self.long = _Numbers(), 0
        self.ids = np.zeros(1 << 16, "<u4")
        self.start = np.zeros(1 << 12, np.int64)  # of each known part, and the end of the last

    def learn(self) -> None:
        parts, self.number.new = self.number.new, []
        n = len(self.number) - len(parts)
        coded = [x.ids for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter(itertools.chain.from_iterable(coded), "<u4", int(lengths.sum()))
        end = int(self.start[n])
        while len(self.start) <= n + len(parts):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        while len(self.ids) < end + len(flat):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.start[n + 1 : n + 1 + len(parts)] = end + np.cumsum(lengths)
        self.ids[end : end + len(flat)] = flat
        if any(len(x) > MEMO_CHARS for x in parts):
            self.long += sum(len(x) for x in parts if len(x) > MEMO_CHARS)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.number) >= MEMO_ENTRIES or self.long >= MEMO_CHARS * MEMO_ENTRIES:
            self.clear()
        known = self.number.__getitem__
        asked = [np.fromiter(map(known, parts), np.int64, len(parts)) for parts in (text.replace("\n", " ").split(" ") for text in texts)]
        if self.number.new:
            self.learn()
        out = []
        for at in asked:
            begin, length = self.start[at], self.start[at + 1] - self.start[at]
            ends = np.cumsum(length)
            out.append(self.ids[np.arange(ends[-1]) + np.repeat(begin - ends + length, length)])
        return out


@lru_cache(maxsize=4)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def width_of(largest: int) -> str:
    """The narrowest unsigned type, of 16 or 32 bits, for ids up to ``largest``."""
    if not 0 <= largest < 1 << 32:
        raise OverflowError(f"{largest} is no unsigned integer of 32 bits")
    return "<u2" if largest < 1 << 16 else "<u4"


def write(df: DataFrame, encoder: Callable[[], Callable[[list[str]], list[np.ndarray]]], end_id: int, largest_id: int = (1 << 32) - 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files in ascending order of ``id_col``; return their manifest, in which ``base`` is a running sum.

    ``encoder`` is called on the executors; what it returns turns texts into arrays of ids.
    ``largest_id`` of its vocabulary decides the ids' width.
    """
    spark, folder, dtype = df.sparkSession, shared_dir(df.sparkSession), width_of(max(largest_id, end_id))
    most = int(np.iinfo(dtype).max)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, ids, offsets, docs = encoder(), None, [0], []
        for row in chunks(rows_of(batches, "i", "t"), 1 << 20):
            ids = ids or StoreWriter(folder, ".bin")
            for (doc, _), tokens in zip(row, encode([t or "" for _, t in row]), strict=True):
                if len(tokens) and not 0 <= int(np.min(tokens)) <= int(np.max(tokens)) <= most:
                    raise OverflowError(f"document {doc} has an id that doesn't fit in {dtype}")
                ids.write(np.append(tokens, end_id).astype(dtype).tobytes())
                offsets.append(offsets[-1] + len(tokens) + 1)
                docs.append(doc)
        if ids:
            idx = StoreWriter(folder, ".idx")
            idx.write(np.asarray(offsets, "<u8").tobytes())
            idx.write(np.asarray([x or 0 for x in docs], "<i8").tobytes())
            idx.write(bytes(x is None for x in docs))
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "bin": [ids.close()], "idx": [idx.close()], "n_docs": [len(docs)], "n_tokens": [offsets[-1]], "dtype": [dtype]})

    sorted_rows = df.selectExpr(f"`{id_col}` as i", f"`{text_col}` as t", f"xxhash64(`{text_col}`) as h").repartitionByRange("i", "h").sortWithinPartitions("i", "h").drop("h")
    kinds = "part long, bin string, idx string, n_docs long, n_tokens long, dtype string"
    manifest = materialise(sorted_rows.mapInArrow(run, kinds))
    rows = sorted(manifest.collect())  # one for each task
    bases = itertools.accumulate((r.n_tokens for r in rows), initial=0)
    return spark.createDataFrame([(*r, b) for r, b in zip(rows, bases, strict=False)], f"{kinds}, base long").repartition(max(1, len(rows)))


def mapped(uri: str) -> pa.Buffer:
    """A file's bytes: memory-mapped where the store is a local one."""
    fs, path = open_store(uri)
    if fs.type_name == "local":
        with pa.memory_map(path) as f:
            return f.read_buffer()
    with fs.open_input_file(path) as f:
        return f.read_buffer()


def documents_of(bin_uri: str, idx_uri: str, n_docs: int, dtype: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(document id, offset in this file, its ids) in file order."""
    idx = mapped(idx_uri)
    offsets = np.frombuffer(idx, "<u8", n_docs + 1)
    docs = np.frombuffer(idx, "<i8", n_docs, offset=8 * (n_docs + 1))
    null = np.frombuffer(idx, np.uint8, n_docs, offset=8 * (2 * n_docs + 1))
    ids = np.frombuffer(mapped(bin_uri), dtype)
    for k in range(n_docs):
        a, b = int(offsets[k]), int(offsets[k + 1])
        yield None if null[k] else int(docs[k]), a, ids[a:b]


def digest(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("i", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        rows = ((doc, base + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for a, b, n, dtype, base in rows_of(batches, "bin", "idx", "n_docs", "dtype", "base") for doc, at, ids in documents_of(a, b, n, dtype))
        yield from batches_of(rows, schema)

    return manifest.mapInArrow(run, "i long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("i", id_col)
