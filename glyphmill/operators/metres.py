"""Lists of metres, and which of them a verse has.

A metre's pattern has long (``+``) and short (``-``) syllables, free ones
(``=``: either) and ``2``: two short or one long; pauses and ends of lines
don't count.  All patterns make one trie; a verse's syllables walk it along
every branch that they fit, and of the metres they reach that with the fewest
free places is the verse's, then the one first by name.

Lists of metres are reference data and are broadcast while they have at most
BROADCAST_METRES patterns; beyond that, patterns are dealt by hash and every
part's best is compared at the end.  Each different pattern of a verse is
walked once.

Defined results: a verse that no metre fits has none; null and empty patterns
fit nothing; equal patterns of two metres count for the name first in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.prosody import render_pattern
from glyphmill.operators.nodes import texts
from glyphmill.operators.trees import attribute

BROADCAST_METRES = 100_000
#: Fixed value: signs that tell nothing of syllables.
PAUSES = "|/।॥ "
NO_DATA = "no data available"


def syllables(pattern: Column) -> Column:
    return F.translate(pattern, PAUSES, "")


class Trie:
    """Metres by their signs; a node is a dict of signs to nodes, its metres under the empty sign."""

    def __init__(self, metres: list[tuple[str, str]]):
        self.root: dict = {}
        for name, pattern in metres:
            node = self.root
            for sign in pattern:
                node = node.setdefault(sign, {})
            free = sum(sign in "=2" for sign in pattern)
            if pattern and ("" not in node or (free, name) < node[""]):
                node[""] = free, name

    def best(self, verse: str) -> tuple[int, str] | None:
        """(free places, name) of the most specific metre; every node is reached once a place."""
        level = [{} for _ in range(len(verse) + 1)]
        level[0][id(self.root)] = self.root
        for at, sign in enumerate(verse):
            for node in list(level[at].values()):
                for taken, wanted in ((1, sign), (1, "="), (1, "2" if sign == "+" else None), (2, "2" if verse[at : at + 2] == "--" else None)):
                    if wanted in node:
                        level[at + taken][id(node[wanted])] = node[wanted]
        return min((n[""] for n in level[len(verse)].values() if "" in n), default=None) if verse else None


def metre_of(verses: DataFrame, metres: DataFrame, key: str, pattern: str) -> DataFrame:
    """(key, metre, free) of the verses that have a metre; ``metres`` has (name, pattern)."""
    listed = metres.select("name", syllables(F.col("pattern")).alias("p")).where("name is not null and p rlike '^[-+=2]+$'").distinct()
    asked = verses.select(key, syllables(F.col(pattern)).alias("p")).where("p rlike '^[-+]+$'")
    n = listed.count()
    parts = max(1, -(-n // BROADCAST_METRES))
    best = None
    for part in range(parts):
        mine = listed if parts == 1 else listed.where(F.pmod(F.xxhash64("p"), F.lit(parts)) == part)
        rows = [(r["name"], r["p"]) for r in mine.collect()]  # at most about BROADCAST_METRES patterns

        def run(batches: Iterator[pa.RecordBatch], rows=rows) -> Iterator[pa.RecordBatch]:
            trie = Trie(rows)
            for batch in batches:
                found = [(p, *hit[::-1]) for p in batch.column("p").to_pylist() if (hit := trie.best(p))]
                if found:
                    yield pa.RecordBatch.from_pydict(dict(zip(("p", "metre", "free"), map(list, zip(*found, strict=True)), strict=True)), pa.schema([("p", pa.string()), ("metre", pa.string()), ("free", pa.int64())]))

        some = asked.select("p").distinct().mapInArrow(run, "p string, metre string, free long")
        best = some if best is None else best.unionByName(some)
    first = best.groupBy("p").agg(F.min(F.struct("free", "metre")).alias("m")).select("p", "m.metre", "m.free")
    return asked.join(first, "p").select(key, "metre", "free")


def metre_lists(nodes: DataFrame) -> DataFrame:
    """(doc_id, item, syllables, class, names, xml, prosody, gana, pattern) of the items of lists of metres.

    ``pattern`` is what is shown: the prosody with its signs, else the plain
    notation, else the ganas.
    """
    tags = nodes.where("kind = 'tag'").select("doc_id", "pre", "parent_pre", "name", "attrs").join(texts(nodes), ["doc_id", "pre"])
    items = tags.where("name = 'item'").select("doc_id", F.col("pre").alias("item"))
    said = F.nullif(F.nullif(F.trim("text"), F.lit("")), F.lit(NO_DATA))
    parts = tags.where("name in ('measure', 'label', 'name', 'seg')").select("doc_id", F.col("parent_pre").alias("item"), "pre", "name", attribute("type").alias("type"), said.alias("said"))
    seg = lambda t: F.min_by(F.when((F.col("name") == "seg") & (F.col("type") == t), F.col("said")), F.when((F.col("name") == "seg") & (F.col("type") == t), F.col("pre")))
    grouped = items.join(parts, ["doc_id", "item"], "left").groupBy("doc_id", "item").agg(
        F.max(F.when(F.col("name") == "measure", F.col("said"))).alias("syllables"), F.max(F.when((F.col("name") == "label") & (F.col("type") == "generic"), F.col("said"))).alias("class"),
        F.sort_array(F.collect_list(F.when((F.col("name") == "name") & F.col("said").isNotNull(), F.struct("pre", "said"))))["said"].alias("names"),
        seg("xml").alias("xml"), seg("prosody").alias("prosody"), seg("gana").alias("gana"),
    )
    return grouped.withColumn("pattern", F.coalesce(render_pattern(F.col("prosody")), "xml", "gana"))


def metre_names(lists: DataFrame) -> DataFrame:
    """(name, pattern, doc_id, item), a row for each name of each item."""
    return lists.select(F.explode("names").alias("name"), "pattern", "doc_id", "item")
