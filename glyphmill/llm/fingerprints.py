"""Fingerprints from prefix polynomial hashes.

A text's prefix hashes are running sums of its code points times powers of a
base, modulo a prime, for two bases.  They give the hash of any span in
constant time, so equal spans are told without looking at them, and the longest
common extension of two places is found by binary search.  The hashes of all
spans of SPAN code points are mixed, and the least in each of BUCKETS buckets
goes into the fingerprint, after the length and the hash of the whole text.
Two fingerprints with equal lengths and hashes are alike by 1; others by the
share of spans that the texts have in common, as the buckets tell it.

A text whose end is replaced shares the prefix hashes before that place and the
least span hashes of what lies there; only its new end is hashed.

Defined results: a null text counts as an empty one; a text of fewer than SPAN
code points is one span; an empty text has none and is alike only to empty
ones; equal ids are ordered by their texts' hashes, null ids come last;
repeated rows follow one another; a table of one row is its own successor;
other columns are ignored; an empty table gives an empty one.  A task holds the
hashes of two texts at a time, 16 bytes for each code point.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import batches_of, map_arrow, materialise, rows_of

PRIME, BASES = (1 << 31) - 1, (1_203_441_967, 846_925_031)
SPAN, BUCKETS = 12, 128
#: Code points that are hashed at a time.
CHUNK = 1 << 18

_EMPTY = np.uint64((1 << 64) - 1)
_EDGES = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(57)


class _Powers:
    """Powers of a base modulo PRIME, as many as were asked for so far."""

    def __init__(self, base: int):
        self.base, self.known = base, np.array([1], np.uint64)

    def to(self, n: int) -> np.ndarray:
        while len(self.known) < n:
            step = pow(self.base, len(self.known), PRIME)
            self.known = np.concatenate((self.known, self.known * np.uint64(step) % np.uint64(PRIME)))
        return self.known


_UP = [_Powers(b) for b in BASES]
_DOWN = [_Powers(pow(b, -1, PRIME)) for b in BASES]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class PrefixHashes:
    """Prefix hashes of a text's code points, for both bases; ``head`` are the hashes of a text with which it starts."""

    def __init__(self, chars: np.ndarray, head: list[np.ndarray] | None = None):
        known = len(head[0]) - 1 if head else 0
        self.n = known + len(chars)
        self.sums = []
        for k in range(len(BASES)):
            sums, powers = np.zeros(self.n + 1, np.uint32), _UP[k].to(self.n + 1)
            if head:
                sums[: known + 1] = head[k]
            for a in range(0, len(chars), CHUNK):
                b = min(a + CHUNK, len(chars))
                terms = (chars[a:b].astype(np.uint64) + np.uint64(1)) * powers[known + a : known + b] % np.uint64(PRIME)
                terms[0] += sums[known + a]
                sums[known + a + 1 : known + b + 1] = np.cumsum(terms) % np.uint64(PRIME)
            self.sums.append(sums)

    def with_end(self, cut: int, chars: np.ndarray) -> PrefixHashes:
        """Those of the text's first ``cut`` code points followed by ``chars``."""
        return PrefixHashes(chars, [s[: cut + 1] for s in self.sums])

    def span(self, i: int, j: int) -> tuple[int, int]:
        """The hash of the code points from ``i`` to before ``j``, wherever they stand."""
        return tuple((int(s[j]) - int(s[i])) * int(d.to(i + 1)[i]) % PRIME for s, d in zip(self.sums, _DOWN, strict=True))

    def extension(self, i: int, other: PrefixHashes, j: int) -> int:
        """How many code points from ``i`` on equal the other text's from ``j`` on: the longest common extension, by binary search."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(i, i + middle) == other.span(j, j + middle):
                low = middle
            else:
                high = middle - 1
        return low

    def least(self, first: int, last: int) -> np.ndarray:
        """The least mixed hash in each bucket, of the spans that start from ``first`` to before ``last``."""
        width, best = min(SPAN, self.n), np.full(BUCKETS, _EMPTY)
        last = min(last, self.n - width + 1) if self.n else 0
        for a in range(first, last, CHUNK):
            b = min(a + CHUNK, last)
            s = self.sums[0]
            span = (s[a + width : b + width].astype(np.uint64) + np.uint64(PRIME) - s[a:b]) % np.uint64(PRIME)
            x = span * _DOWN[0].to(b)[a:b] % np.uint64(PRIME) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
            x.sort()
            at = np.searchsorted(x, _EDGES)
            found = x[np.minimum(at, len(x) - 1)]
            held = (at < len(x)) & (found >> np.uint64(57) == np.arange(BUCKETS, dtype=np.uint64))
            best = np.minimum(best, np.where(held, found, _EMPTY))
        return best


def fingerprint(hashes: PrefixHashes, least: np.ndarray) -> str:
    """Length, hash of the whole, and a byte for each bucket (0: no span), in hex."""
    marks = np.where(least == _EMPTY, 0, 1 + least % np.uint64(255)).astype(np.uint8)
    a, b = hashes.span(0, hashes.n)
    return f"{hashes.n:x}-{a:08x}{b:08x}-{marks.tobytes().hex()}"


def likeness(a: str, b: str) -> float:
    """From 0 to 1: the share of common spans, by the buckets that either fills."""
    if a.rpartition("-")[0] == b.rpartition("-")[0]:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f.rpartition("-")[2]), np.uint8) for f in (a, b))
    either, same = np.count_nonzero(x | y), np.count_nonzero((x == y) & (x > 0))
    return 2 * same / (either + same) if either else 0.0


class Hashed:
    """A text with its prefix hashes, the place where its last third begins, and its fingerprint."""

    def __init__(self, doc: int | None, text: str | None):
        self.doc, self.text = doc, text or ""
        self.hashes = PrefixHashes(points(self.text))
        self.end = len(self.text) // 3
        self.cut = len(self.text) - self.end
        #: Spans before this place are also those of the edited text, if it has spans of the same width.
        self.shared = max(0, self.cut - SPAN + 1) if len(self.text) >= SPAN else 0
        self.before = self.hashes.least(0, self.shared)
        self.fingerprint = fingerprint(self.hashes, np.minimum(self.before, self.hashes.least(self.shared, self.hashes.n)))

    def edited(self, following: str, following_print: str) -> tuple:
        """The row of this text whose last third is replaced by what ``following`` starts with."""
        new = following[: self.end]
        hashes = self.hashes.with_end(self.cut, points(new))
        same_width = hashes.n >= SPAN
        least = np.minimum(self.before, hashes.least(self.shared, hashes.n)) if same_width else hashes.least(0, hashes.n)
        edited = fingerprint(hashes, least)
        digest = hashlib.sha256((self.text[: self.cut] + new).encode("utf-8", "surrogatepass")).hexdigest()
        return self.doc, len(self.text), digest, self.fingerprint, edited, likeness(self.fingerprint, edited), likeness(self.fingerprint, following_print), self.hashes.extension(0, hashes, 0)


KINDS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"
_ROW = [("i", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("common_prefix", pa.int64())]


def edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint beside that of the text whose last third the next row's text replaces, by descending id.

    One range shuffle puts the rows in order.  What stands at the edges of its
    parts is written with the results; the last row of each part meets the first
    one of the next part in a small join.
    """
    spark = df.sparkSession
    schema = pa.schema([*_ROW, ("part", pa.int64()), ("edge", pa.string()), ("text", pa.string())])
    blank = (None,) * (len(_ROW) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            held, part = None, TaskContext.get().partitionId()
            for doc, text in rows_of(batches, "i", "t"):
                now = Hashed(doc, text)
                if held is None:
                    yield doc, None, None, now.fingerprint, *blank[3:], part, "first", now.text
                else:
                    yield *held.edited(now.text, now.fingerprint), part, None, None
                held = now
            if held is not None:
                yield held.doc, *blank, part, "last", held.text

        yield from batches_of(found(), schema, sizes=lambda r: len(r[-1] or ""))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of((Hashed(doc, text).edited(following, mark) for doc, text, following, mark in rows_of(batches, "i", "text", "following", "mark")), pa.schema(_ROW))

    order = [F.desc_nulls_last("i"), F.col("h")]
    rows = df.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("h")
    done = materialise(map_arrow(ordered, run, f"i long, {KINDS}, part long, edge string, text string"))
    parts = sorted(r.part for r in done.where("edge = 'last'").select("part").collect())  # one for each task
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part long, then long")
    lasts = done.where("edge = 'last'").select("i", "text", "part").join(F.broadcast(follows), "part")
    firsts = done.where("edge = 'first'").select(F.col("part").alias("then"), F.col("text").alias("following"), F.col("fingerprint").alias("mark"))
    edges = map_arrow(lasts.join(firsts, "then").select("i", "text", "following", "mark"), meet, f"i long, {KINDS}")
    return done.where("edge is null").drop("part", "edge", "text").unionByName(edges).withColumnRenamed("i", id_col)
