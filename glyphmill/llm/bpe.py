"""Byte-level BPE with a rank queue of buckets under a hierarchical bitmap.

The queue keeps, for each merge rank, a bucket of positions in a linked list
of parts.  A tree of 64-bit words tells which buckets have entries, so
find-first-set on three words gives the lowest rank.  A merge leaves the
entries of vanished pairs where they are; they are skipped when they come up.
A piece of n bytes takes O(n log n) steps, however long it is.

Short pieces are encoded many at a time: one linked list holds them all, a
bucket holds the positions of 64 neighbouring ranks (a leaf word of the tree),
and numpy takes from the lowest bucket each piece's first entry at once.
Pieces don't meet, so each still merges in the order it would alone.

Defined results: a null text is an empty one, an empty text has no ids;
repeated rows give repeated rows; other columns of the input are ignored;
an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from glyphmill.llm.common import batches_of, chunks, forgetting, giving_back, map_arrow, open_store, rows_of, without_collection

#: Parts of texts that a task keeps before its memory of them is emptied, and the longest part kept.
MEMO_ENTRIES, MEMO_CHARS = 400_000, 48
#: Pieces of more bytes are encoded one by one.
SHORT = 64
#: Characters of text whose new pieces are encoded together.
TOGETHER = 2 << 20


class RankBitmap:
    """A set of small integers with find-first-set, as levels of 64-bit words."""

    def __init__(self, size: int):
        self.levels: list[list[int]] = []
        while not self.levels or size > 1:
            size = (size + 63) >> 6
            self.levels.append([0] * max(1, size))
        self.down = self.levels[::-1]

    def add(self, i: int) -> None:
        for level in self.levels:
            word = level[i >> 6]
            level[i >> 6] = word | 1 << (i & 63)
            if word:
                return
            i >>= 6

    def discard(self, i: int) -> None:
        for level in self.levels:
            level[i >> 6] &= ~(1 << (i & 63))
            if level[i >> 6]:
                return
            i >>= 6

    def first(self) -> int:
        """The least member, -1 if there is none."""
        i = 0
        for level in self.down:
            word = level[i]
            if not word:
                return -1
            i = i << 6 | (word & -word).bit_length() - 1
        return i


class BpeCodec:
    """Encodes as tiktoken's ``encode_ordinary`` does with the same ranks and pattern; decodes ids to bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.name_of = {i: str(i) for i in self.bytes_of}
        self.queue = RankBitmap(max(ranks.values(), default=0) + 1)
        self.memo: dict[str, tuple[str, int, bytes]] = {}
        pairs = sorted((ranks[token[:k]] << 32 | ranks[token[k:]], rank) for token, rank in ranks.items() for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks)
        self.pair_keys, self.pair_ranks = np.array([*(k for k, _ in pairs), 1 << 62], np.int64), np.array([*(r for _, r in pairs), -1], np.int64)
        self.of_byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)

    def encode_piece(self, piece: bytes) -> list[int]:
        ranks, queue = self.ranks, self.queue
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        after, before, pair = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
        buckets: dict[int, list[int]] = {}

        def offer(at: int, end: int) -> None:
            rank = ranks.get(piece[at:end])
            if rank is None:
                pair[at] = -1
                return
            pair[at] = rank
            if bucket := buckets.get(rank):
                heappush(bucket, at)
            else:
                buckets[rank] = [at]
                queue.add(rank)

        for i in range(n - 1):
            offer(i, i + 2)
        while (rank := queue.first()) >= 0:
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                queue.discard(rank)
            if pair[i] != rank:
                continue
            gone = after[i]
            end = after[i] = after[gone]
            pair[gone] = -1
            if end < n:
                before[end] = i
                offer(i, after[end])
            else:
                pair[i] = -1
            if (left := before[i]) >= 0:
                offer(left, end)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return ids

    def _pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def encode_short(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pieces that are no tokens themselves, by one queue for all."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        size = int(lengths.sum())
        token = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.append(np.repeat(np.arange(len(pieces)), lengths), -1)
        after, before, gone = np.arange(1, size + 1), np.arange(-1, size - 1), np.zeros(size, bool)
        rank = np.append(np.where(owner[:-2] == owner[1:-1], self._pair_rank(token[:-1], token[1:]), -1), -1)
        buckets: dict[int, list[np.ndarray]] = {}
        queue = RankBitmap((max(self.ranks.values()) >> 6) + 1)

        def offer(at: np.ndarray) -> None:
            word = rank[at] >> 6
            order = np.argsort(word, kind="stable")
            at, word = at[order], word[order]
            cuts = np.flatnonzero(np.diff(word)) + 1
            for w, part in zip(word[np.append(0, cuts)].tolist(), np.split(at, cuts), strict=True):
                if w in buckets:
                    buckets[w].append(part)
                else:
                    buckets[w] = [part]
                    queue.add(w)

        if len(first := np.flatnonzero(rank >= 0)):
            offer(first)
        while (word := queue.first()) >= 0:
            entries = buckets.pop(word)
            queue.discard(word)
            at = entries[0] if len(entries) == 1 else np.concatenate(entries)
            at = at[rank[at] >> 6 == word]
            if not len(at):
                continue
            key = np.sort((owner[at] << 6 | rank[at] & 63) << 32 | at)
            key = key[np.append(True, key[1:] != key[:-1])]
            at, own = key & 0xFFFFFFFF, key >> 38
            lead = np.append(True, own[1:] != own[:-1])
            if len(rest := at[~lead]):
                buckets[word] = [rest]
                queue.add(word)
            at, own = at[lead], own[lead]
            right = after[at]
            end = after[right]
            token[at] = rank[at]
            gone[right], rank[right], rank[at] = True, -1, -1
            after[at] = end
            inner = owner[end] == own
            mid, end = at[inner], end[inner]
            before[end] = mid
            rank[mid] = self._pair_rank(token[mid], token[end])
            left = before[at]
            inner = (left >= 0) & (owner[left] == own)
            left, here = left[inner], at[inner]
            rank[left] = self._pair_rank(token[left], token[here])
            new = np.concatenate([mid, left])
            if len(new := new[rank[new] >= 0]):
                offer(new)
        counts = np.bincount(owner[:-1][~gone], minlength=len(pieces))
        ids, ends = token[~gone].tolist(), np.cumsum(counts).tolist()
        return [ids[e - n : e] for e, n in zip(ends, counts.tolist(), strict=True)]

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        found: list[list[int] | None] = [None] * len(pieces)
        short = []
        for k, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                found[k] = [whole]
            elif len(piece) <= SHORT:
                short.append(k)
            else:
                found[k] = self.encode_piece(piece)
        if short:
            for k, ids in zip(short, self.encode_short([pieces[k] for k in short]), strict=True):
                found[k] = ids
        return found

    def encode(self, text: str) -> list[int]:
        pieces = self.pattern.findall(text)
        new = list(dict.fromkeys(pieces))
        ids = dict(zip(new, self.encode_pieces([x.encode() for x in new]), strict=True))
        return [i for piece in pieces for i in ids[piece]]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def parts(self, text: str) -> list[str]:
        """Cuts of ``text`` no match of the pattern crosses.

        A cut before a space is safe unless white space stands on both its
        sides (or before it at the end): only then could one match of a run of
        white space cover both parts.  Texts with such spaces stay whole.
        """
        if _UNSAFE.search(text):
            return [text]
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + x for x in rest]

    @without_collection
    def round_trip(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text: number of ids; SHA-256 of the ids in decimal, joined by commas; SHA-256 of the bytes they decode to."""
        memo, name = self.memo, self.name_of.__getitem__
        if len(memo) >= MEMO_ENTRIES:
            memo.clear()
        parted = list(map(self.parts, texts))
        new = list(dict.fromkeys(filterfalse(memo.__contains__, chain.from_iterable(parted))))
        split = list(map(self.pattern.findall, new))
        pieces = list(dict.fromkeys(chain.from_iterable(split)))
        found = {}
        for piece, ids in zip(pieces, self.encode_pieces(list(map(str.encode, pieces))), strict=True):
            found[piece] = ",".join(map(name, ids)), len(ids), self.decode(ids)
        for part, xs in zip(new, split, strict=True):
            if len(xs) == 1:
                memo[part] = found[xs[0]]
            else:
                names, counts, data = zip(*map(found.__getitem__, xs), strict=True)
                memo[part] = ",".join(names), sum(counts), b"".join(data)
        out = []
        for parts in parted:
            names, counts, data = zip(*map(memo.__getitem__, parts), strict=True) if parts else ((), (), ())
            out.append((sum(counts), hashlib.sha256(",".join(names).encode()).hexdigest(), hashlib.sha256(b"".join(data)).hexdigest()))
        for part in new:
            if len(part) > MEMO_CHARS:
                del memo[part]
        return out


_UNSAFE = re.compile(r"\s (?:\s|\Z)")


@lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str) -> BpeCodec:
    """The codec of a ``.tiktoken`` file, once per Python worker."""
    fs, path = open_store(ranks_path)
    with fs.open_input_stream(path) as f:
        lines = f.read().split(b"\n")
    return BpeCodec({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}, pattern)


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): every text's token ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        rows = ((i, own.encode(t or "")) for i, t in rows_of(batches, "i", "t"))
        yield from batches_of(rows, pa.schema([("i", pa.int64()), ("ids", pa.list_(pa.int32()))]), lambda r: 4 * len(r[1]))

    return df.selectExpr(f"`{id_col}` as i", f"`{text_col}` as t").mapInArrow(run, "i long, ids array<int>").withColumnRenamed("i", id_col)


def decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes): what the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        rows = ((i, own.decode(x or [])) for i, x in rows_of(batches, "i", "x"))
        yield from batches_of(rows, pa.schema([("i", pa.int64()), ("bytes", pa.binary())]), lambda r: len(r[1]))

    return df.selectExpr(f"`{id_col}` as i", f"`{ids_col}` as x").mapInArrow(run, "i long, bytes binary").withColumnRenamed("i", id_col)


def round_trip(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", number_col: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, and a long column ``number_col`` if named): encodes and decodes every text without shipping its ids."""
    more = [number_col] if number_col else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        rows = ((i, *x, *kept) for part in chunks(rows_of(batches, "i", "t", *more), TOGETHER) for (i, _, *kept), x in zip(part, own.round_trip([r[1] or "" for r in part]), strict=True))
        yield from forgetting(own.memo, batches_of(rows, pa.schema([("i", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *((c, pa.int64()) for c in more)])))

    rows = df.selectExpr(f"`{id_col}` as i", f"`{text_col}` as t", *(f"`{c}`" for c in more))
    return map_arrow(rows, giving_back(run), "i long, n_tokens long, ids_sha256 string, decoded_sha256 string" + "".join(f", `{c}` long" for c in more)).withColumnRenamed("i", id_col)
