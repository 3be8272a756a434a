"""Removal of repeated byte strings, by interval trees over an enhanced suffix array of anchored suffixes.

Of every window of ``LENGTH`` bytes, the 32-byte string with the least hash is
its anchor, so equal windows have equal anchors at equal places.  Windows in a
row with one anchor share an entry: the anchor, and the text that its windows
cover (its context).  Entries meet by the anchor's hash, which decides nothing
by itself.  Of contexts with equal bytes (told by a cryptographic digest of
128 bits) the first stands for all.  Where an anchor has several contexts, the
suffixes that begin at it are sorted into an enhanced suffix array; a stack
scan over the common-prefix lengths gives the tree of intervals, each a string
with all its occurrences.  The texts before the anchors, read backwards, are
scanned the same way within each interval: its nodes are where the
occurrences' left extensions differ.  A node of both gives a maximal repeat
with all its occurrences, and every occurrence but the first is marked.

No anchor makes a large group.  One with more than ``HOT_CONTEXTS`` different
contexts sends their windows by themselves, each by its own hash; equal ones
become one before they are sent, and what meets is compared by its bytes in
the same tree.  Anchors that would fill more than a small part of all buckets
are found beforehand and their windows become entries of their own, whose
bytes are told apart as those of contexts are.  Which anchors take which way
changes no result.

``repeat_groups`` gives the maximal repeats themselves, with all occurrences.

Defined results: a null text is an empty one; texts under ``LENGTH`` bytes stay
whole; rows of a null id stay whole and repeat nothing; rows with equal ids
and texts have equal results, and of different texts under one id only the
least takes part while the others stay whole; other columns are ignored; an
empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import batches_of, giving_back, kept_from, materialise, rows_of

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1  # anchors that a window can have
#: Bytes of text hashed at a time (positions fit in 20 bits), and entries that are sorted together before they are sent.
CHUNK_BYTES, SEND_ENTRIES = 1 << 18, 1 << 19
#: Entries of a bucket, about.
BUCKET_ENTRIES = 150_000
#: Contexts of one anchor that are compared in one place.
HOT_CONTEXTS = 4000
#: Anchors with more than this part of all entries are found beforehand, and none with less than half of it.
HOT_PARTS = 100_000
#: Entries whose anchors are counted together, and windows of hot anchors that a task holds to find equal ones.
COUNT_ENTRIES, HELD_WINDOWS = 4_000_000, 200_000

_RNG = np.random.default_rng(20240502)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64)
_POWER, *_PLACE = (_RNG.integers(0, 1 << 62, 10, dtype=np.uint64) * np.uint64(4) + np.uint64(1)).tolist()
_LOW = np.uint64((1 << 20) - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position (as far as there are so many)."""
    x, size, power = _BYTE[data], 1, _POWER
    while size < GRAM:
        x = x[:-size] * np.uint64(power) + x[size:]
        size, power = 2 * size, power * power % (1 << 64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(_PLACE[0])
    return x ^ (x >> np.uint64(29))


def entries(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hashes, anchor, first and last window) of all windows that lie in one document; ``ends``: of each byte's document."""
    grams = gram_hashes(data)
    least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while 2 * size <= SPAN:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = SPAN - size
    least = np.minimum(least[: len(least) - rest], least[rest:])
    starts = np.flatnonzero(ends[: len(least)] - np.arange(len(least)) >= LENGTH)
    if not len(starts):
        return grams, *[np.zeros(0, np.int64)] * 3
    anchor = (least[starts] & _LOW).astype(np.int64)
    cut = np.flatnonzero(np.diff(anchor)) + 1
    return grams, anchor[np.append(0, cut)], starts[np.append(0, cut)], starts[np.append(cut - 1, len(starts) - 1)]


def context_hashes(grams: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from window ``lo`` to the end of window ``hi``, from grams that cover them."""
    end = hi + LENGTH - GRAM
    places = (lo, lo + GRAM, lo + 2 * GRAM, np.minimum(lo + 3 * GRAM, end), end - GRAM, end)
    mixed = sum(grams[at] * np.uint64(p) for at, p in zip(places, _PLACE[1:7], strict=True)) + (hi - lo).astype(np.uint64) * np.uint64(_PLACE[7])
    return mixed ^ (mixed >> np.uint64(32))


def digests(raw: bytes, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """128 bits, as two columns, of the bytes from window ``lo`` to the end of window ``hi``."""
    made = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(lo.tolist(), (hi + LENGTH).tolist(), strict=True)])
    return np.frombuffer(made, "<u8").reshape(-1, 2)


# Columns of entries as they travel: anchor's hash, context's digest in two parts, document, anchor, windows before it, windows in all less one.
FIELDS = (("h", "<u8"), ("c", "<u8"), ("d", "<u8"), ("doc", "<i8"), ("pos", "<u4"), ("back", "u1"), ("wide", "u1"))


def _pack(columns: list[np.ndarray]) -> bytes:
    return b"".join(np.asarray(c, k).tobytes() for c, (_, k) in zip(columns, FIELDS, strict=True))


def _unpack(blobs: list[bytes]) -> list[np.ndarray]:
    width = sum(np.dtype(k).itemsize for _, k in FIELDS)
    parts = []
    for blob in blobs:
        n, at, own = len(blob) // width, 0, []
        for _, k in FIELDS:
            own.append(np.frombuffer(blob, k, n, at))
            at += n * np.dtype(k).itemsize
        parts.append(own)
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def text_entries(rows: Iterator[tuple], hot: np.ndarray | None, exact: bool = True) -> Iterator[list[np.ndarray]]:
    """FIELDS of the documents (id, text) in chunks; anchors in ``hot`` (sorted) give an entry for each window.

    Unless ``exact``, digests are replaced by hashes that are cheaper and only good for counting.
    """
    def flush(ids: list[int], texts: list[bytes]) -> list[np.ndarray]:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        stop = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(texts)), sizes)
        raw = b"".join(texts)
        grams, pos, lo, hi = entries(np.frombuffer(raw, np.uint8), stop[owner])
        h = grams[pos]
        if hot is not None and len(hot) and len(h):
            found = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
            if found.any():
                count = (hi - lo + 1)[found]
                start = np.repeat(lo[found] - np.cumsum(count) + count, count) + np.arange(count.sum())
                h = np.append(h[~found], context_hashes(grams, start, start))
                pos, lo, hi = np.append(pos[~found], start), np.append(lo[~found], start), np.append(hi[~found], start)
        both = digests(raw, lo, hi) if exact else np.stack([context_hashes(grams, lo, hi), np.zeros(len(h), np.uint64)], axis=1)
        who = owner[pos]
        return [h, both[:, 0], both[:, 1], np.array(ids, np.int64)[who], pos - (stop - sizes)[who], pos - lo, hi - lo]

    ids, texts, size = [], [], 0
    for i, text in rows:
        raw = text.encode()
        if len(raw) < LENGTH:
            continue
        # A text longer than a chunk goes in overlapping parts that share no window.
        step = CHUNK_BYTES - LENGTH + 1
        for at in range(0, len(raw) - LENGTH + 1, step):
            part = raw[at : at + CHUNK_BYTES]
            if size + len(part) > CHUNK_BYTES and texts:
                yield flush(ids, texts)
                ids, texts, size = [], [], 0
            if len(raw) > CHUNK_BYTES:
                out = flush([i], [part])
                out[4] = out[4] + at
                yield out
            else:
                ids.append(i), texts.append(part)
                size += len(part)
    if texts:
        yield flush(ids, texts)


def _gathered(parts: Iterator[list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= SEND_ENTRIES:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, n = [], 0
    if n:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _sorted_runs(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Entries whose h isn't alone, by h, digest, document and position; where an h begins, where a context begins."""
    h = columns[0]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    order = order[np.append(same, False) | np.append(False, same)]
    columns = [x[order] for x in columns]
    h, c, d, doc, pos = columns[:5]
    order = np.lexsort((pos, doc, d, c, h))
    columns = [x[order] for x in columns]
    differ = [np.append(True, x[1:] != x[:-1])[: len(order)] for x in columns[:3]]
    return columns, differ[0], differ[0] | differ[1] | differ[2]


# ---- the tree of common-prefix intervals

def lcp_intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int, int]]:
    """(first, last, depth, parent's depth) of all intervals of at least ``least``; lcp[k] is between sorted suffixes k and k + 1."""
    stack: list[tuple[int, int]] = []  # (first, depth), depths rising
    for k, depth in enumerate(itertools.chain(lcp, [0])):
        first = k
        while stack and stack[-1][1] > depth:
            first, deep = stack.pop()
            yield first, k, deep, max(depth, stack[-1][1] if stack else 0, least - 1)
        if depth >= least and (not stack or stack[-1][1] < depth):
            stack.append((first, depth))


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(k for k in range(n) if a[k] != b[k])


def maximal_repeats(contexts: list[tuple[bytes, bytes]]) -> Iterator[tuple[list[int], int, int]]:
    """(occurrences, fewest and most bytes before the anchor) of windows that several contexts have.

    A context is the text before its anchor and the text from there on.  For
    each number of bytes before the anchor in the range, the occurrences have
    the same window, and no others do.
    """
    size = np.fromiter((min(len(r), LENGTH) for _, r in contexts), np.int64, len(contexts))
    # Bytes are raised by one (UTF-8 has no 255), so the padding differs from all of them.
    right = np.zeros((len(contexts), LENGTH), np.uint8)
    for k, (_, r) in enumerate(contexts):
        right[k, : size[k]] = np.frombuffer(r, np.uint8, size[k])
        right[k, : size[k]] += 1
    order = np.argsort(right.view(f"S{LENGTH}").ravel(), kind="stable")
    ranked = right[order]
    differ = ranked[1:] != ranked[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
    lcp = np.minimum(lcp, np.minimum(size[order][1:], size[order][:-1]))
    suffix = order.tolist()
    for first, last, depth, above in lcp_intervals(lcp.tolist(), GRAM):
        members = [(contexts[k][0][::-1], k) for k in suffix[first : last + 1]]
        members.sort()
        before = [_common(a, b) for (a, _), (b, _) in itertools.pairwise(members)]
        fewest, most = LENGTH - depth, LENGTH - above - 1
        if not fewest:  # windows that begin at the anchor need no left context
            yield [k for _, k in members], 0, 0
            fewest = 1
        for a, b, deep, over in lcp_intervals(before, 1):
            low, high = max(over + 1, fewest), min(deep, most)
            if low <= high:
                yield [k for _, k in members[a : b + 1]], low, high


# ---- stages

_MARKS = pa.schema([("id", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])


def _anchors(docs: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, marks, entries): entries by their hash; copies within what is sent together come as marks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for columns in _gathered(text_entries(rows_of(batches, "id", "text"), hot)):
                h, doc = columns[0], columns[3]
                order = np.argsort(h, kind="stable")
                same = h[order][1:] == h[order][:-1]
                again = order[np.append(same, False) | np.append(False, same)]
                drop = np.zeros(len(h), bool)
                if len(again):
                    again = again[np.lexsort([x[again] for x in columns[4::-1]])]
                    drop[again[1:][np.logical_and.reduce([x[again][1:] == x[again][:-1] for x in columns[:3]])]] = True
                kind = np.where(drop, doc.astype(np.uint64) * np.uint64(_PLACE[2]) >> np.uint64(40), h >> np.uint64(24)) % np.uint64(buckets)
                for chosen, marks in ((drop, True), (~drop, False)):
                    at = np.flatnonzero(chosen)
                    at = at[np.argsort(kind[at], kind="stable")]
                    cuts = np.flatnonzero(np.diff(kind[at])) + 1
                    for part in np.split(at, cuts) if len(at) else ():
                        yield int(kind[part[0]]), marks, _pack([x[part] for x in columns])

        yield from batches_of(rows(), pa.schema([("bucket", pa.int32()), ("marks", pa.bool_()), ("entries", pa.binary())]), lambda r: len(r[2]))

    return docs.mapInArrow(giving_back(run), "bucket int, marks boolean, entries binary")


def _hot_anchors(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Hashes (sorted) of all anchors with 1/HOT_PARTS of the entries or more, and of none with less than half of that; the number of entries.

    Equal contexts that are sent together count once.  A task drops counts of
    under 1/(2 HOT_PARTS) of what it counts at a time, so what is dropped of an
    anchor is at most that part of all entries, and the rest of it is enough.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            held, total, size = [], 0, 0

            def counted():
                h, often = np.unique(np.concatenate(held), return_counts=True)
                most = often >= max(2, size // (2 * HOT_PARTS))
                return zip(h[most].view(np.int64).tolist(), often[most].tolist(), strict=True)

            for columns in _gathered(text_entries(rows_of(batches, "id", "text"), None, exact=False)):
                total += len(columns[0])
                _, first = np.unique(columns[0] * np.uint64(_PLACE[8]) + columns[1], return_index=True)
                held.append(columns[0][first])
                size += len(first)
                if size >= COUNT_ENTRIES:
                    yield from counted()
                    held, size = [], 0
            if held:
                yield from counted()
            yield None, total

        yield from batches_of(rows(), pa.schema([("h", pa.int64()), ("n", pa.int64())]))

    counted = docs.mapInArrow(giving_back(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counted = materialise(counted.where(f"h is null or n >= {HOT_CONTEXTS}"))
    total = counted.where("h is null").agg(F.sum("n")).first()[0] or 0
    rows = counted.where(f"h is not null and n >= {max(HOT_CONTEXTS, total // (2 * HOT_PARTS))}").collect()  # at most 2 HOT_PARTS
    return np.sort(np.array([r["h"] for r in rows], np.int64).view(np.uint64)), total


def _meet(anchored: DataFrame) -> DataFrame:
    """(id, lo, hi, h, pos, apart): windows marked (h null), or contexts that an anchor of several has; ``apart`` if it has more than HOT_CONTEXTS."""
    schema = pa.schema([*_MARKS, ("h", pa.int64()), ("pos", pa.int32()), ("apart", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in itertools.groupby(rows_of(batches, "bucket", "marks", "entries"), key=lambda r: r[0]):
            marked, met = [], []
            for _, marks, blob in group:
                (marked if marks else met).append(blob)
            if marked:
                yield from _emit(*_unpack(marked)[3:], None, None)
            if met:
                columns, new_h, new_c = _sorted_runs(_unpack(met))
                again = ~new_c
                yield from _emit(*(x[again] for x in columns[3:]), None, None)
                group_of = np.cumsum(new_h) - 1
                contexts = np.bincount(group_of[new_c], minlength=1)
                several = (contexts > 1)[group_of] & new_c if len(group_of) else new_c
                yield from _emit(*(x[several] for x in columns[3:]), columns[0][several], contexts[group_of[several]] > HOT_CONTEXTS)

    def _emit(doc, pos, back, wide, h, apart) -> Iterator[pa.RecordBatch]:
        lo, n = pos.astype(np.int32) - back, len(doc)
        if n:
            more = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_())] if h is None else [pa.array(h.view(np.int64)), pa.array(pos.astype(np.int32)), pa.array(apart)]
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(lo), pa.array(lo + wide.astype(np.int32)), *more], schema=schema)

    return anchored.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(giving_back(run), "id long, lo int, hi int, h long, pos int, apart boolean")


def _contexts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(h, id, pos, before, after) of the contexts asked for; of those ``apart`` each window, by its own hash.

    Of equal windows in a task the first is sent; the others are marks, whose
    ``before`` and ``after`` are null and whose last window is in ``h``.
    """
    lists = asked.groupBy("id").agg(F.collect_list(F.struct("h", "pos", "lo", "hi", "apart")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[int, int]] = {}

        def sent():
            for window, (i, at) in held.items():
                yield xxhash.xxh3_64_intdigest(window) - (1 << 63), i, at, b"", window
            held.clear()

        def rows():
            for i, text, asked in rows_of(batches, "id", "text", "asked"):
                raw = text.encode()
                for x in asked:
                    if not x["apart"]:
                        yield x["h"], i, x["pos"], raw[x["lo"] : x["pos"]], raw[x["pos"] : x["hi"] + LENGTH]
                        continue
                    for at in range(x["lo"], x["hi"] + 1):
                        window = raw[at : at + LENGTH]
                        first = held.get(window)
                        if first is None or (i, at) < first:
                            held[window] = (i, at)
                        if first is not None and first != (i, at):
                            later = max(first, (i, at))
                            yield later[1], later[0], later[1], None, None
                    if len(held) >= HELD_WINDOWS:
                        yield from sent()
            yield from sent()

        yield from batches_of(rows(), _CONTEXTS, lambda r: 168, most=20_000)

    return docs.join(lists, "id").select("id", "text", "asked").mapInArrow(giving_back(run), "h long, id long, pos int, before binary, after binary")


_CONTEXTS = pa.schema([("h", pa.int64()), ("id", pa.int64()), ("pos", pa.int32()), ("before", pa.binary()), ("after", pa.binary())])


def _compare(contexts: DataFrame, block: int = 20_000) -> DataFrame:
    """(id, lo, hi): windows that begin earlier in another context of the same anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            held: list[tuple] = []
            for _, group in itertools.groupby(rows_of(batches, "h", "id", "pos", "before", "after"), key=lambda r: r[0]):
                last = None
                for row in group:
                    if row[4] is None:  # a mark already
                        yield row[1], row[2], row[0]
                    elif last is not None and row[3:] == last[3:]:  # the bytes of the context before it, which begins earlier
                        yield row[1], row[2] - len(row[3]), row[2] + len(row[4]) - LENGTH
                    else:
                        held.append(last := row)  # an anchor's contexts stay together; HOT_CONTEXTS of them at most
                if len(held) >= block:
                    yield from marks(held)
                    held = []
            if held:
                yield from marks(held)

        def marks(held: list[tuple]) -> Iterator[tuple]:
            for members, fewest, most in maximal_repeats([r[3:] for r in held]):
                first = min(members, key=lambda k: held[k][1:3])
                for k in members:
                    if k != first:
                        yield held[k][1], held[k][2] - most, held[k][2] - fewest

        yield from batches_of(rows(), _MARKS, most=50_000)

    return contexts.repartition("h").sortWithinPartitions("h", "before", "after", "id", "pos").mapInArrow(giving_back(run), "id long, lo int, hi int")


def _cut(rows: Iterator[tuple]) -> Iterator[tuple]:
    for i, text, marks, *more in rows:
        raw = (text or "").encode()
        spans: list[list[int]] = []
        for x in sorted((m["lo"], m["hi"]) for m in marks or ()):
            if spans and x[0] <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], x[1] + LENGTH)
            else:
                spans.append([x[0], x[1] + LENGTH])
        edges = [0, *itertools.chain.from_iterable(spans), len(raw)]
        kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        yield i, text, len(raw), len(raw) - len(kept), len(spans), kept, *more


def repeat_marks(docs: DataFrame) -> DataFrame:
    """(id, lo, hi): windows from ``lo`` to ``hi`` of a document begin earlier elsewhere; ``docs`` has unique ids and texts."""
    hot, total = _hot_anchors(docs)
    met = materialise(_meet(_anchors(docs, hot, max(1, total // BUCKET_ENTRIES))))
    found = _compare(_contexts(docs, met.where("h is not null").select("id", "h", "pos", "lo", "hi", "apart")))
    return met.where("h is null").select("id", "lo", "hi").unionByName(found)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] | None = None) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row; with ``carry`` also kept_text and those columns.

    ``kept_text`` is the text that is left, without the bytes of characters that a cut went through.
    """
    own = [F.col(c).alias(f"own_{k}") for k, c in enumerate(carry or ())]
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *own)
    docs = rows.select("id", "text").where("id is not null and text is not null")
    unique = rows.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    if not unique:
        docs = materialise(docs.groupBy("id").agg(F.min("text").alias("text")))
    # Written, so that what led to them can go before the texts are shuffled again.
    marks, _ = kept_from(df.sparkSession, lambda: repeat_marks(docs))
    marks = marks.groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))
    marked = rows.join(marks, "id", "left") if unique else rows.join(docs.join(marks, "id"), ["id", "text"], "left")
    extra = [(f"own_{k}", df.schema[c].dataType.simpleString()) for k, c in enumerate(carry or ())]
    types = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    types = pa.schema([*types, ("kept_text", pa.string()), *df.select(*own).limit(0).toArrow().schema]) if carry is not None else types
    names = [n for n, _ in extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for i, text, n, gone, spans, kept, *more in _cut(rows_of(batches, "id", "text", "marks", *names)):
                own = (kept.decode(errors="ignore") if gone else text, *more) if carry is not None else ()
                yield i, n, gone, spans, hashlib.sha256(kept).hexdigest(), *own

        yield from batches_of(rows(), types, (lambda r: len(r[5] or "")) if carry is not None else None)

    kinds = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" if carry is not None else "") + "".join(f", {n} {k}" for n, k in extra)
    out = marked.select("id", "text", "marks", *names).mapInArrow(giving_back(run), kinds).withColumnRenamed("id", id_col)
    return out.withColumnsRenamed(dict(zip(names, carry or (), strict=True)))


# ---- the groups themselves

def repeat_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 2000) -> DataFrame:
    """(repeat, n_bytes, occurrences, id, start, cut): the maximal repeats of LENGTH bytes and more, a row for each occurrence.

    A repeat is maximal if neither the bytes before all its occurrences nor
    those after them agree; shorter and longer ones that overlap are all given.
    Each is found at the anchor of its first window, which all its occurrences
    share.  Suffixes are compared for ``reach`` bytes: a longer repeat is given
    with the length found so far, and ``cut`` is true.  Contexts with equal
    bytes are one leaf of the tree; its occurrences are joined to what it is
    part of.  An anchor's different contexts are compared in one task, so this
    is for tables without an anchor of millions of different contexts.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    docs = materialise(docs.groupBy("id").agg(F.min("text").alias("text")))
    kinds = "h long, id long, pos long, leaf binary, back int, least int, before binary, after binary, cut boolean"
    schema = pa.schema([("h", pa.int64()), ("id", pa.int64()), ("pos", pa.int64()), ("leaf", pa.binary()), ("back", pa.int32()), ("least", pa.int32()), ("before", pa.binary()), ("after", pa.binary()), ("cut", pa.bool_())])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for i, text in rows_of(batches, "id", "text"):
                raw = text.encode()
                for h, _, _, _, pos, back, wide in (row for part in text_entries(iter([(i, text)]), None, exact=False) for row in zip(*(x.tolist() for x in part), strict=True)):
                    # One byte before the first window too: it tells whether all occurrences go on to the left.
                    before, after = raw[max(0, pos - back - 1) : pos], raw[pos : pos + reach]
                    leaf = hashlib.blake2b(b"%d,%d,%d," % (back, wide, len(before)) + before + after, digest_size=16).digest()
                    yield h - (1 << 63), i, pos, leaf, back, back - wide, before, after, pos + reach < len(raw)

        yield from batches_of(rows(), schema, lambda r: reach)

    found = materialise(docs.mapInArrow(contexts, kinds))
    leaves = found.groupBy("h", "leaf").agg(F.first("back").alias("back"), F.first("least").alias("least"), F.first("before").alias("before"), F.first("after").alias("after"), F.max("cut").alias("cut"), F.count("*").alias("n"))
    parts_kind = "repeat binary, n_bytes long, back long, leaf binary, cut boolean, n long"
    parts_schema = pa.schema([("repeat", pa.binary()), ("n_bytes", pa.int64()), ("back", pa.int64()), ("leaf", pa.binary()), ("cut", pa.bool_()), ("n", pa.int64())])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for _, group in itertools.groupby(rows_of(batches, "h", "leaf", "back", "least", "before", "after", "cut", "n"), key=lambda r: r[0]):
                held = [r[1:] for r in group]
                if len(held) > 1 or held[0][6] > 1:
                    for members, back, length in _maximal_groups([r[1:5] for r in held], [r[6] for r in held]):
                        _, _, _, before, after, _, _ = held[members[0]]
                        name = hashlib.blake2b(before[len(before) - back :] + after[: length - back], digest_size=16).digest()
                        for k in members:
                            yield name, length, back, held[k][0], held[k][5] and length - back == reach, held[k][6]

        yield from batches_of(rows(), parts_schema)

    parts = materialise(leaves.repartition("h").sortWithinPartitions("h").select("h", "leaf", "back", "least", "before", "after", "cut", "n").mapInArrow(groups, parts_kind))
    occurrences = parts.groupBy("repeat").agg(F.sum("n").alias("occurrences"), F.max("cut").alias("cut"))
    named = parts.drop("cut", "n").join(occurrences, "repeat")
    out = named.join(found.select("leaf", "id", "pos"), "leaf")
    return out.select(F.lower(F.hex("repeat")).alias("repeat"), "n_bytes", "occurrences", F.col("id").alias(id_col), (F.col("pos") - F.col("back")).alias("start"), "cut")


def _maximal_groups(contexts: list[tuple[int, int, bytes, bytes]], weights: list[int]) -> Iterator[tuple[list[int], int, int]]:
    """(members, bytes before the anchor, length) of the maximal repeats of LENGTH bytes and more, from contexts (most and fewest bytes before the anchor in its windows, text before it, text from it on).

    A member of weight 2 and more repeats by itself.  Strings whose first window has another anchor belong to that one.
    """
    def alone(sizes: list[int], common: list[int], own: list[int]) -> Iterator[tuple[int, int, int]]:
        """Nodes of single members that repeat, where no interval has their whole length."""
        for k, (size, x) in enumerate(zip(sizes, own, strict=True)):
            if weights[x] > 1 and size > max((common[j] for j in (k - 1, k) if 0 <= j < len(common)), default=-1):
                yield k, k, size

    order = sorted(range(len(contexts)), key=lambda k: contexts[k][3])
    rights = [contexts[k][3] for k in order]
    lcp = [_common(a, b) for a, b in itertools.pairwise(rights)]
    right_nodes = [(a, b, depth) for a, b, depth, _ in lcp_intervals(lcp, GRAM)]
    for first, last, depth in (*right_nodes, *alone([len(x) for x in rights], lcp, order)):
        members = sorted((contexts[k][2][::-1], k) for k in order[first : last + 1])
        own = [k for _, k in members]
        before = [_common(a, b) for (a, _), (b, _) in itertools.pairwise(members)]
        left_nodes = [(a, b, deep) for a, b, deep, _ in lcp_intervals(before, 1)]
        if before and not min(before):
            left_nodes.append((0, len(members) - 1, 0))
        for a, b, back in (*left_nodes, *alone([len(x) for x, _ in members], before, own)):
            chosen = own[a : b + 1]
            after = [contexts[k][3] for k in chosen]
            # The interval's depth counts only if these members alone don't go on to the right together.
            deep = _common(min(after), max(after))
            if deep == depth and back + depth >= LENGTH and all(contexts[k][1] <= back <= contexts[k][0] for k in chosen):
                yield chosen, back, back + depth
