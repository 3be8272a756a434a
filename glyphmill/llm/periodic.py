"""Runs of words that repeat with a period, by a dictionary of basic factors.

For each power of two, every place of a text that another one equals gets a
name: equal names, equal factors of that many words.  Names of the next power
come from pairs of names; places whose factor stands only once drop out, so
the levels soon are short.  Within a level, places in order of name and number
give each factor's successor.  A run of smallest period q is at least three
periods long, so at the level whose factors have q to 2q - 1 words each of its
places has its successor exactly q words on: the occurrences are arithmetic
progressions of difference q, from the run's first word to the last place whose
factor and successor lie in it.  A stretch of consecutive places with one
distance therefore is a run already extended as far as it goes, and as each
period belongs to one level, no run is found twice; distances beyond the
factor's length are left to the next level, where they can't be multiples of a
smaller period.

Texts are searched many at a time, their names kept apart by the text's number.

Defined results: null and empty texts have no words and no runs; texts of any
length are searched whole, by a task that holds a few integers for each word;
repeated rows give repeated rows; rows of a null id are not altered by
``plant``; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import batches_of, chunks, map_arrow, rows_of

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Bytes of text that are searched together.
TOGETHER = 1 << 20


def _in_order(keys: np.ndarray, top: int) -> np.ndarray:
    """Indices that put the keys (below ``top``) in order, equal ones in theirs."""
    shift = max(1, len(keys)).bit_length()
    if int(top).bit_length() + shift > 63:
        return np.argsort(keys, kind="stable")
    packed = keys << shift | np.arange(len(keys))
    packed.sort()
    return packed & (1 << shift) - 1


def runs(words: np.ndarray, owner: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> np.ndarray:
    """(start, length, period) of all runs, in order of start and period; ``words`` and ``owner`` are the numbers of each place's word and text."""
    if periods < 3:
        raise ValueError("runs of fewer than three periods can't be told by successors alone")
    n, found = len(words), []
    places, keys = np.arange(n), owner.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
    top, size = int(keys.max(initial=0)) + 1, 1
    longest = int(np.bincount(owner).max(initial=0)) if n else 0
    while len(places) and size < 2 * longest:
        order = _in_order(keys, top)
        at, same = places[order], np.diff(keys[order]) == 0
        distance = np.diff(at)
        near = same & (distance <= size) & (distance > size // 2)
        found.append(_stretches(at[:-1][near], distance[near], size, least, periods))
        # Places of a factor that stands elsewhere too, with its name.
        twice = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        names = np.full(n, -1, np.int64)
        names[at[twice]] = np.concatenate(([0], np.cumsum(~same)))[twice]
        places = np.flatnonzero(names >= 0)
        places = places[places + size < n]
        places = places[names[places + size] >= 0]
        top = int(names.max(initial=0)) + 1
        keys = names[places] * top + names[places + size]
        top, size = top * top, 2 * size
    every = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def _stretches(at: np.ndarray, distance: np.ndarray, size: int, least: int, periods: int) -> np.ndarray:
    """Runs from places whose factors of ``size`` words come again at a distance."""
    order = np.lexsort((at, distance))
    at, distance = at[order], distance[order]
    new = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(distance) != 0))) if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1 if len(first) else first
    start, period = at[first], distance[first]
    length = at[last] + size + period - start
    kept = length >= np.maximum(least, periods * period)
    return np.stack((start, length, period), axis=1)[kept]


def planted(doc: int | None, n: int) -> tuple[int, int] | None:
    """Place and period with which the words of every tenth document (by its id's checksum) are made periodic."""
    h = zlib.crc32(str(doc).encode())
    if doc is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _rows(docs: list[tuple[int | None, bytes | None]], plant) -> Iterator[tuple]:
    numbers: dict[bytes, int] = {}
    texts, sources, codes = [], [], []
    for doc, text in docs:
        words = (text or b"").split()
        source, where = np.arange(len(words)), plant and plant(doc, len(words))
        if where:
            a, p = where
            source[a:] = a + (source[a:] - a) % p
        texts.append(words)
        sources.append(source)
        codes.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))[source])
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    found = runs(np.concatenate(codes), np.repeat(np.arange(len(texts)), lengths))
    change = np.zeros(int(ends[-1]) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    kept = np.cumsum(change[:-1]) == 0
    edges = np.searchsorted(found[:, 0], np.concatenate((ends - lengths, ends[-1:])))
    for k, (doc, _) in enumerate(docs):
        begin = int(ends[k] - lengths[k])
        own = [(s - begin, length, q) for s, length, q in found[edges[k] : edges[k + 1]].tolist()]
        best = (None,) * 4
        if own:
            s, length, q = own[0]
            for other in own[1:]:
                if other[1] * q > length * other[2]:  # the first of equal ones has the smallest start, then period
                    s, length, q = other
            best = s, length, q, 1000 * length // q
        words = texts[k]
        left = sources[k][kept[begin : int(ends[k])]].tolist()
        yield doc, len(own), *best, _digest("".join(f"{s},{length},{q}\n" for s, length, q in own).encode()), _digest(b" ".join([words[j] for j in left]))


def collapse(df: DataFrame, plant: Callable[[int | None, int], tuple[int, int] | None] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's runs, the run of the greatest exponent, and the digest of its words without what a run repeats.

    ``plant`` tells for an id and a number of words from where on, and with
    which period, the words are to be made periodic before the search.
    """
    names = ("n_runs", "start", "length", "period", "exponent_milli")
    schema = pa.schema([("i", pa.int64()), *((n, pa.int64()) for n in names), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of((row for docs in chunks(rows_of(batches, "i", "t"), TOGETHER) for row in _rows(docs, plant)), schema)

    rows = df.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("binary").alias("t"))
    return map_arrow(rows, run, "i long, " + ", ".join(f"{n} long" for n in names) + ", runs_sha256 string, collapsed_sha256 string").withColumnRenamed("i", id_col)


#: Checksums by a table of bytes; windows of eight words that come again at a distance; their stretches; what no run of a smaller period covers.
ORACLE = r"""
with crc as (select list(v order by b) as t from (select b, list_reduce(list_prepend(b, range(8)), lambda c, x: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as v from range(256) r(b))),
h as (select doc_id, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, strlen(doc_id::varchar) + 1), lambda k: ascii(substr(doc_id::varchar, k, 1))::bigint)), lambda c, x: xor(c // 256, t[1 + (xor(c, x) % 256)])), 4294967295) as h from documents, crc),
w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
p as (select doc_id, w, len(w)::bigint as n, h, case when len(w) > 0 then (h // 10) % len(w) end as a from w join h using (doc_id)),
d as (select doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(n), lambda i: w[1 + case when i >= a then a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) else i end]) else w end as w from p),
g as (select doc_id, n, i, array_to_string(w[i + 1:i + 8], ' ') as x from (select doc_id, n, w, unnest(range(0, n - 7)) as i from d where n >= 24)),
e as (select a.doc_id, a.i, b.i - a.i as q from g a join g b on a.doc_id = b.doc_id and a.x = b.x and b.i > a.i and 3 * (b.i - a.i) <= a.n),
s as (select doc_id, q, min(i) as s, max(i) + 8 + q - min(i) as l from (select *, i - row_number() over (partition by doc_id, q order by i) as k from e) group by doc_id, q, k),
c as (select distinct * from s where l >= 24 and l >= 3 * q),
r as (select doc_id, s, l, q from c where not exists (select 1 from c o where o.doc_id = c.doc_id and o.q < c.q and o.s <= c.s and o.s + o.l >= c.s + c.l)),
b as (select * from r qualify row_number() over (partition by doc_id order by l::double / q desc, s, q) = 1),
t as (select doc_id, count(*)::bigint as k, string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q) as x from r group by doc_id),
m as (select distinct doc_id, unnest(range(s + q, s + l)) as i from r),
o as (select u.doc_id, string_agg(u.x, ' ' order by u.i) as x from (select doc_id, unnest(range(n)) as i, unnest(w) as x from d) u anti join m on m.doc_id = u.doc_id and m.i = u.i group by u.doc_id)
select d.doc_id, coalesce(k, 0) as n_runs, b.s::bigint as start, b.l::bigint as length, b.q::bigint as period, (1000 * b.l // b.q)::bigint as exponent_milli,
       sha256(coalesce(t.x, '')) as runs_sha256, sha256(coalesce(o.x, '')) as collapsed_sha256
from d left join b using (doc_id) left join t using (doc_id) left join o using (doc_id)
"""
