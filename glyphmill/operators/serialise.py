"""trees as text again, from the numbers of their nodes.

A node's start stands at ``pre``, its end at ``post + level``, which is the
number of the last node in it; where ends meet, the innermost comes first.  So
all starts, ends, texts, comments and instructions of a tree are put in order
by one sort of its events, and no tree is built.

Defined results: a tree's root has no tags of its own; attributes keep their
order; elements without contents have a start and an end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.text import quote_xml


def _start() -> Column:
    attrs = F.transform(F.map_entries("attrs"), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), quote_xml(e["value"]), F.lit('"')))
    return F.concat(F.lit("<"), "name", F.coalesce(F.array_join(attrs, ""), F.lit("")), F.lit(">"))


def serialise(nodes: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(doc_id, xml) of whole trees, or (doc_id, pre, xml) of the subtrees whose ``roots`` (doc_id, pre, post, level) are given."""
    rows = nodes.where("kind is not null")
    keys = ["doc_id"]
    if roots is not None:
        asked = roots.select("doc_id", F.col("pre").alias("root"), (F.col("post") + F.col("level")).alias("last"))
        rows = rows.join(asked, "doc_id").where((F.col("pre") >= F.col("root")) & (F.col("pre") <= F.col("last")))
        keys = ["doc_id", "root"]
    kind = F.col("kind")
    event = lambda at, end, order, text: F.struct(at.alias("at"), F.lit(end).alias("end"), order.alias("order"), text.alias("text"))
    said = F.when(kind == "string", quote_xml(F.col("data"))).when(kind == "comment", F.concat(F.lit("<!--"), "data", F.lit("-->"))).when(kind == "pi", F.concat(F.lit("<?"), "data", F.lit("?>"))).when(kind == "tag", _start()).otherwise("")
    ends = F.when(kind == "tag", event(F.col("post") + F.col("level"), 1, -F.col("pre"), F.concat(F.lit("</"), "name", F.lit(">"))))
    events = rows.select(*keys, F.explode(F.array_compact(F.array(event(F.col("pre"), 0, F.lit(0), said), ends))).alias("e"))
    out = events.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list("e"))["text"], "").alias("xml"))
    return out if roots is None else out.withColumnRenamed("root", "pre")
