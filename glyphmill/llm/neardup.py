"""Near-duplicate documents by MinHash with tensored banding, every link confirmed on whole sets.

A document is its set of five-word shingles.  Two collections of ``HALVES``
half-keys each, of two minima apiece, make a table key of every pair of a
first and a second half-key: HALVES² tables out of 4 HALVES minima.  Pairs of
similarity 0.75 meet in some table with probability 1 - 2 * 0.4375^HALVES,
0.99998 for 14.  Only documents that share a first half-key with another go on
to the pairs of halves, which changes no table's buckets of two and more.

Documents that share a table key are candidates.  A bucket's members are tied
to its smallest one; the components of these ties are clusters.  Within a
cluster documents meet by the rarest of their shingles, of which linked ones
share some, and are then compared on full sets, unless they are known to be in
one component.  Clusters of over ``CHUNK_BYTES`` of text are dealt out: each
chunk also gets the cluster's pivots, so what hangs together in several chunks
is found through them; documents left outside the cluster's largest component
then meet all chunks, block by block.

Defined results: texts without words have the empty set and no links; rows of
a null id have no links; texts with equal sets are compared once; rows with
equal ids and different texts are documents of their own, each with the links
of its text; other columns are ignored; an empty table gives an empty one.
``unlike`` keeps one row of each component, so repeated rows leave one, and of
texts under one id each is judged by itself.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import batches_of, forgetting, in_written_order, join_groups, kept_from, map_arrow, materialise, rows_of
from glyphmill.llm.components import connected_components

WORDS, HALVES = 5, 14
#: Documents are linked if 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Text compared in one place, about; and documents of a larger cluster that all its chunks share.
CHUNK_BYTES, PIVOTS = 4 << 20, 8

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = np.random.default_rng(20240501).integers(1, 1 << 63, 4 * HALVES + WORDS + 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHINGLE, _MINIMA, _TAIL = _ODD[:WORDS], _ODD[WORDS : WORDS + 4 * HALVES], _ODD[WORDS + 4 * HALVES :]
#: Words whose hashes a task keeps before it forgets them; all are forgotten when it ends, as workers live on.
_MEMO_ENTRIES = 400_000
_memo: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _TAIL[0]
    return (x ^ (x >> np.uint64(29))) * _TAIL[1]


def shingles(text: str) -> np.ndarray:
    """The sorted set of 64-bit hashes of a text's shingles."""
    words = text.encode().translate(_LOWER).split()  # bytes split at ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    if len(_memo) > _MEMO_ENTRIES:
        _memo.clear()
    memo, digest = _memo, xxhash.xxh3_64_intdigest
    try:
        hashed = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    except KeyError:
        for w in words:
            if w not in memo:
                memo[w] = digest(w)
        hashed = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = len(words) - WORDS + 1
    mixed = sum(hashed[k : k + n] * _SHINGLE[k] for k in range(WORDS))
    return np.unique(_mix(mixed))


def half_keys(shingle_set: np.ndarray) -> np.ndarray:
    """HALVES first half-keys, then HALVES second ones, each from two minima."""
    minima = np.empty(4 * HALVES, np.uint64)
    for k in range(4 * HALVES):
        x = shingle_set * _MINIMA[k]
        minima[k] = ((x ^ (x >> np.uint64(32))) * _TAIL[2]).min()
    return _mix(minima[::2] * _TAIL[3] + minima[1::2])


def signatures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, n_bytes, n_shingles, set_digest, first, second) of every row; the last three are null for empty sets.  ``t`` is a hash of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for i, t, text in rows_of(batches, "i", "h", "t"):
                own = shingles(text or "")
                if not len(own):
                    yield i, t, len(text or ""), 0, None, None, None
                    continue
                keys = half_keys(own).view(np.int64)
                yield i, t, len(text.encode()), len(own), xxhash.xxh3_128_digest(own.tobytes()), keys[:HALVES], keys[HALVES:]

        yield from forgetting(_memo, batches_of(rows(), pa.schema([("id", pa.int64()), ("t", pa.int64()), ("n_bytes", pa.int64()), ("n_shingles", pa.int64()), ("set_digest", pa.binary()), ("first", pa.list_(pa.int64())), ("second", pa.list_(pa.int64()))])))

    texts = df.select(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))
    return map_arrow(texts, run, "id long, t long, n_bytes long, n_shingles long, set_digest binary, first array<long>, second array<long>")


def candidate_ties(signed: DataFrame) -> DataFrame:
    """(a, b), repeated for each table: each bucket's members tied to its smallest; ``signed`` (node, first, second) has a row for each distinct set."""
    halves = signed.select("node", F.posexplode("first").alias("i", "x"))
    shared = halves.groupBy("i", "x").agg(F.count("*").alias("n")).where("n > 1")
    mine = join_groups(halves, shared, ["i", "x"], HALVES * signed.count()).groupBy("node").agg(F.collect_list("i").alias("mine"))  # at most HALVES
    second = mine.join(signed, "node").select("node", F.explode("mine").alias("i"), "first", "second")
    second = second.select("node", "i", F.get("first", "i").alias("x"), F.posexplode("second").alias("j", "y"))
    keyed = materialise(second.select("node", F.xxhash64("i", "x", "j", "y").alias("key")))
    least = keyed.groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1")
    return join_groups(keyed, least, ["key"], keyed.count()).where("node <> b").select(F.col("node").alias("a"), "b")


class SetIndex:
    """Shingle sets of a group of documents, and who has what.

    Two linked documents share at least ``percent`` of each one's shingles, so
    with all shingles in one order, the rarest first, the heads of their lists
    share one: heads of all but ``percent`` of a list, and one more.  Only heads
    are indexed, so what many documents share brings none of them together as
    long as they have rarer shingles.
    """

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT):
        self.percent, self.sizes = percent, np.fromiter(map(len, sets), np.int64, len(sets))
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        _, shingle, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        order = np.argsort(count, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        #: Each document's shingles by rank, ascending; a rank's document frequency only falls behind higher ranks'.
        self.shingle = rank[shingle]
        self.shingle = self.shingle[np.lexsort((self.shingle, owner))]
        self.marked = np.zeros(len(order), bool)
        head = self.sizes - -(-percent * self.sizes // 100) + 1
        self.head_ends = self.starts + np.minimum(head, self.sizes)
        at = np.arange(len(owner)) < np.repeat(self.head_ends, self.sizes)
        heads, held = self.shingle[at], owner[at]
        by_shingle = np.argsort(heads, kind="stable")
        self.holders = held[by_shingle]
        self.count = np.bincount(heads, minlength=len(order))
        self.first = np.cumsum(self.count) - self.count

    def _holders(self, own: np.ndarray) -> np.ndarray:
        """The documents in whose heads any of the shingles stands."""
        count = self.count[own]
        ends = np.cumsum(count)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[own] - ends + count, count)
        return np.unique(self.holders[at])

    def linked(self, k: int, component: np.ndarray | None = None, mixed: np.ndarray | None = None) -> np.ndarray:
        """The documents linked with document k, itself among them; with ``component`` only those of another, by the ``mixed`` shingles."""
        own = self.shingle[self.starts[k] : self.head_ends[k]]
        others = self._holders(own if mixed is None else own[mixed[own]])
        if component is not None:
            others = others[component[others] != component[k]]
        size = self.sizes[others]
        others = others[(100 * size >= self.percent * self.sizes[k]) & (100 * self.sizes[k] >= self.percent * size)]
        if not len(others):
            return others
        whole = self.shingle[self.starts[k] : self.ends[k]]
        self.marked[whole] = True
        sizes = self.sizes[others]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.starts[others] - ends + sizes, sizes)
        both = np.add.reduceat(self.marked[self.shingle[at]], ends - sizes, dtype=np.int64)
        self.marked[whole] = False
        return others[100 * both >= self.percent * (sizes + self.sizes[k] - both)]

    def mixed(self, component: np.ndarray) -> np.ndarray:
        """The shingles that stand in heads of several components."""
        out, held = np.zeros(len(self.count), bool), np.flatnonzero(self.count)
        own = component[self.holders]
        if len(held):
            out[held] = np.minimum.reduceat(own, self.first[held]) != np.maximum.reduceat(own, self.first[held])
        return out


def group_components(index: SetIndex) -> np.ndarray:
    """The number of each document's component, counted by its first document.

    A component is grown from each document that none has reached, as long as
    that finds more.  Links that this misses are between documents not asked;
    all of these but the largest component's then ask the other components,
    whose documents share a shingle of their heads with them.
    """
    n = len(index.sizes)
    root = np.arange(n)

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return int(k)

    def join(k: int, near: np.ndarray) -> None:
        roots = sorted({find(k), *(find(int(r)) for r in np.unique(root[near]))})
        root[roots] = roots[0]
        root[near] = roots[0]

    inside, asked = np.zeros(n, bool), np.zeros(n, bool)
    for start in range(n):
        if inside[start]:
            continue
        inside[start] = True
        queue, idle = [start], 0
        while queue and idle < 3:
            k = queue.pop()
            near = index.linked(k)
            asked[k] = True
            new = near[~inside[near]]
            inside[new] = True
            join(k, near)
            queue += new.tolist()
            idle = 0 if len(new) else idle + 1
    component = np.array([find(k) for k in range(n)])
    quiet = np.flatnonzero(~asked)
    if len(quiet) and len(own := np.unique(component[quiet])) > 1:
        sizes = np.bincount(component[quiet], minlength=n)
        largest, mixed = own[np.argmax(sizes[own])], index.mixed(component)
        for k in quiet[component[quiet] != largest].tolist():
            if len(near := index.linked(k, component, mixed)):
                join(k, near)
        component = np.array([find(k) for k in range(n)])
    return component


def _grouped(df: DataFrame, keys: list[str], columns: list[str], work, schema: pa.Schema, kinds: str) -> DataFrame:
    """Rows that ``work`` makes of each group's rows (of ``columns``); groups are bounded by CHUNK_BYTES."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = rows_of(batches, *keys, *columns)
        groups = itertools.groupby(rows, key=lambda r: r[: len(keys)])
        yield from forgetting(_memo, batches_of((x for _, g in groups for x in work([r[len(keys) :] for r in g])), schema))

    return map_arrow(df.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys), run, kinds)


def _roots(percent: int):
    def work(rows: list[tuple]) -> Iterator[tuple]:
        # Pivots first, then by id: a component's name is its first pivot, else its smallest id.
        rows.sort(key=lambda r: (not r[1], r[0]))
        found = group_components(SetIndex([shingles(t) for _, _, t in rows], percent))
        for (i, _, _), k in zip(rows, found, strict=True):
            yield i, rows[k][0]

    return work


def _outer_links(percent: int):
    def work(rows: list[tuple]) -> Iterator[tuple]:
        # (id, component, asks, text): documents that ask are compared with all; one link to each component is enough.
        index = SetIndex([shingles(r[3]) for r in rows], percent)
        for k, (i, own, asks, _) in enumerate(rows):
            if asks:
                near = {rows[x][1] for x in index.linked(k)}
                yield from ((i, c) for c in near if c != own)

    return work


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def confirmed_components(texts: DataFrame, clusters: DataFrame, sizes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, component) by confirmed links; ``texts`` has (id, t, text), ``clusters`` (node, component) of all candidates and ``sizes`` (node, id, t, n_bytes)."""
    known = clusters.join(sizes, "node").select("id", "t", "node", "component", "n_bytes")
    total = known.groupBy("component").agg(F.ceil(F.sum("n_bytes") / CHUNK_BYTES).alias("chunks"), F.count("*").alias("n"))
    dealt = join_groups(materialise(known), total, ["component"], clusters.count()).select("id", "t", F.col("node"), "component", "chunks", F.pmod(F.xxhash64("node"), F.col("chunks")).alias("chunk"))
    dealt = materialise(dealt.join(texts, ["id", "t"]).select(F.col("node").alias("id"), "component", "chunks", "chunk", "text"))
    large = dealt.where("chunks > 1")
    pivots = large.groupBy("component", "chunks").agg(F.slice(F.array_sort(F.collect_set(F.when(F.col("chunk") == 0, F.struct(F.xxhash64("id").alias("h"), "id")))), 1, PIVOTS).alias("p")).select("component", "chunks", F.explode("p.id").alias("id"))
    spread = pivots.join(dealt.select("id", "text"), "id").select("id", "component", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(True).alias("pivot"), "text")
    plain = dealt.join(pivots.select("id"), "id", "left_anti").select("id", "component", "chunk", F.lit(False).alias("pivot"), "text")
    roots = materialise(_grouped(plain.unionByName(spread), ["component", "chunk"], ["id", "pivot", "text"], _roots(percent), _LINKS, "a long, b long"))
    small_roots = roots.select(F.col("a").alias("node"), F.col("b").alias("component"))
    if large.isEmpty():
        return small_roots
    big_ids = large.select("id", F.col("component").alias("cluster"))
    links = roots.join(big_ids.select(F.col("id").alias("a")), "a", "left_semi")
    named = materialise(_named(big_ids, links))
    # The largest component of each cluster needs no more comparing within itself; all other documents ask all chunks.
    main = named.groupBy("cluster", "component").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    asking = named.join(main, "cluster").where("component <> main").select("id", "cluster", "component")
    if not asking.isEmpty():
        blocks = asking.join(sizes.select(F.col("node").alias("id"), "n_bytes"), "id").groupBy("cluster").agg(F.ceil(F.sum("n_bytes") / CHUNK_BYTES).alias("blocks"))
        asking = asking.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")))
        text = dealt.select("id", "text", "chunk", "chunks", F.col("component").alias("cluster"))
        asked = text.join(named.select("id", "component"), "id").join(blocks, "cluster").select("cluster", "chunk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "component", F.lit(False).alias("asks"), "text")
        asks = asking.join(text.drop("cluster", "chunk"), "id").select("cluster", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "block", "id", "component", F.lit(True).alias("asks"), "text")
        more = _grouped(asked.unionByName(asks), ["cluster", "chunk", "block"], ["id", "component", "asks", "text"], _outer_links(percent), _LINKS, "a long, b long")
        links = links.unionByName(materialise(more))
        named = _named(big_ids, links)
    small = small_roots.join(big_ids.select(F.col("id").alias("node")), "node", "left_anti")
    return small.unionByName(named.select(F.col("id").alias("node"), "component"))


def _named(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(id, cluster, component) of all ``ids``; those without a link are alone."""
    found = connected_components(links).select(F.col("node").alias("id"), "component")
    return ids.join(found, "id", "left").select("id", "cluster", F.coalesce("component", "id").alias("component"))


def _judged(df: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """(id, t, n_shingles, component_id, component) of every row; the last is one value for each component, where an id may stand in several."""
    signed = materialise(signatures(df, id_col, text_col))
    heads = signed.where("set_digest is not null and id is not null").groupBy("set_digest").agg(F.min(F.struct("id", "t", "n_bytes", "first", "second")).alias("h"))
    heads = materialise(heads.select("set_digest", "h.*"))
    if heads.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        heads = heads.withColumn("node", F.col("id"))
    else:  # one id has texts of its own: nodes are numbers in the order of ids
        heads = in_written_order(heads.repartitionByRange("id", "set_digest").sortWithinPartitions("id", "set_digest"), "node")[0]
    clusters = connected_components(candidate_ties(heads.select("node", "first", "second")))
    texts = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    found = confirmed_components(texts, clusters, heads.select("node", "id", "t", "n_bytes"), percent)
    found = found.groupBy("node").agg(F.min("component").alias("component"))
    named = heads.select("set_digest", "node", "id").join(found, "node", "left").select("set_digest", "id", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    named = materialise(named)
    named = join_groups(named, least, ["component"], named.count()).select("set_digest", "component", "least")
    linked = [F.when(F.col("id").isNotNull(), F.col(c)) for c in ("least", "component")]
    return signed.join(named, "set_digest", "left").select("id", "t", "n_shingles", F.coalesce(linked[0], "id").alias("component_id"), linked[1].alias("component"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row; ``kept`` tells whether the id is the component's smallest."""
    judged, _ = kept_from(df.sparkSession, lambda: _judged(df, id_col, text_col, percent))
    return judged.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("id")).alias("kept"))


def unlike(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``df`` with one row of each component, one with its smallest id; rows without words and rows of a null id all stay."""
    judged, _ = kept_from(df.sparkSession, lambda: _judged(df, id_col, text_col, percent))
    # Of a component that has its smallest id with several texts, the one with the least hash stays.
    chosen = judged.where("component is not null and id = component_id").groupBy("component").agg(F.min("t").alias("t"), F.count("*").alias("n"))
    first = judged.where("component is not null and id = component_id").select("id", "t", "component").distinct()
    first = first.join(chosen.drop("n"), ["component", "t"]).select("id", "t")
    gone = judged.where("component is not null").select("id", "t").distinct().join(first, ["id", "t"], "left_anti")
    own = df.columns
    keyed = df.select(*[F.col(f"`{c}`").alias(f"own_{k}") for k, c in enumerate(own)], F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"))
    repeated = judged.where("component is not null").groupBy("id", "t").agg(F.count("*").alias("n")).where("n > 1").select("id", "t")
    out = keyed.join(gone, ["id", "t"], "left_anti")
    if not repeated.isEmpty():
        twice = out.join(repeated, ["id", "t"], "left_semi").dropDuplicates(["id", "t"])
        out = out.join(repeated, ["id", "t"], "left_anti").unionByName(twice)
    return out.select(*[F.col(f"own_{k}").alias(c) for k, c in enumerate(own)])
