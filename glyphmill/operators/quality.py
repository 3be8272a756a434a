"""Quality of documents: a ladder of severities, listings, and rules over text and trees.

V1 ladder, V2 reports, V4 rules on nodes, V5 odd letters, V7 listing by owner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.text import char_names, graphemes, is_valid_cluster, nfc, quote_html
from glyphmill.operators.nodes import XPath
from glyphmill.operators.trees import nearest_above

#: Severities, worst last.
OK, WARNING, ERROR, FATAL = range(4)


def ladder(*rungs: tuple[Column, int]) -> Column:
    """V1: the worst severity whose condition holds, OK if none does."""
    out = F.lit(OK)
    for condition, severity in sorted(rungs, key=lambda r: r[1]):
        out = F.when(condition, severity).otherwise(out)
    return out


def report(messages: DataFrame) -> DataFrame:
    """V2: messages in the order of their places."""
    return messages.orderBy("doc_id", F.col("line").asc_nulls_last(), F.col("col").asc_nulls_last(), "message")


#: What a cluster of several characters has one of (marks, joiners and other format characters, jamo, flags, skin tones, letters that go before others), or a Cyrillic letter.
SUSPICIOUS = (
    r"[\p{M}\p{Cf}\x{1100}-\x{11FF}\x{A960}-\x{A97F}\x{D7B0}-\x{D7FF}\x{FF9E}\x{FF9F}\x{1F1E6}-\x{1F1FF}\x{1F3FB}-\x{1F3FF}\x{0D4E}\x{110BD}\x{110CD}\x{111C2}\x{111C3}\x{1193F}\x{11941}"
    r"\x{11A3A}\x{11A84}-\x{11A89}\x{11D46}\x{11F02}\p{InCyrillic}\x{0500}-\x{052F}\x{1C80}-\x{1C8F}\x{1D2B}\x{1D78}\x{2DE0}-\x{2DFF}\x{A640}-\x{A69F}\x{1E030}-\x{1E08F}]"
)


def cluster_problems(df: DataFrame, key: str, text: str) -> DataFrame:
    """V5: (key, line_no, at, cluster, names, highlighted_line) of the clusters that no script here has; ``at`` counts them within the line.

    Lines end at carriage returns and line feeds only, each for itself.  Lines
    of single letters, none of them Cyrillic, have no problems and are left out
    before anything is normalised.
    """
    lines = df.select(F.col(key).alias("k"), F.posexplode(F.split(text, r"[\r\n]", -1)).alias("n", "raw")).where(F.col("raw").rlike(SUSPICIOUS))
    clusters = lines.select("k", "n", graphemes(nfc(F.col("raw"))).alias("gs"))
    found = clusters.select("k", "n", "gs", F.posexplode("gs").alias("at", "cluster")).where(~is_valid_cluster(F.col("cluster")))
    part = lambda start, size: quote_html(F.array_join(F.slice("gs", start, size), ""))
    marked = F.concat(part(F.lit(1), F.col("at")), F.lit("<mark>"), quote_html(F.col("cluster")), F.lit("</mark>"), part(F.col("at") + 2, F.size("gs")))
    return found.select(F.col("k").alias(key), (F.col("n") + 1).cast("long").alias("line_no"), F.col("at").cast("long").alias("at"), "cluster", char_names(F.col("cluster")).alias("names"), marked.alias("highlighted_line"))


def odd_clusters(df: DataFrame, key: str, text: str) -> DataFrame:
    """V5: (key, line_no, n): how many problems a line has."""
    return cluster_problems(df, key, text).groupBy(key, "line_no").agg(F.count("*").alias("n"))


def unique_attribute(nodes: DataFrame, attribute: str, rule: str) -> DataFrame:
    """V4: (doc_id, pre, rule) of tags whose attribute's value another tag of the document has."""
    valued = nodes.where("kind = 'tag'").select("doc_id", "pre", F.try_element_at("attrs", F.lit(attribute)).alias("v")).where("v is not null")
    twice = valued.groupBy("doc_id", "v").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "v")
    return valued.join(twice, ["doc_id", "v"], "left_semi").select("doc_id", "pre", F.lit(rule).alias("rule"))


def forbidden(nodes: DataFrame, path: str, rule: str) -> DataFrame:
    """V4: (doc_id, pre, rule) of nodes that a path finds and that must not be there."""
    return XPath(nodes).find(path).select("doc_id", "pre", F.lit(rule).alias("rule"))


def inherited(nodes: DataFrame, attribute: str, default: str) -> DataFrame:
    """(doc_id, pre, value): each tag's own value of an attribute, else its nearest ancestor's, else the default."""
    tags = nodes.where("kind in ('tag', 'tree')").select("doc_id", "pre", "parent_pre", "level", "kind", F.try_element_at("attrs", F.lit(attribute)).alias("own"))
    held = nearest_above(tags, F.col("own"))
    return held.where("kind = 'tag'").select("doc_id", "pre", F.coalesce("value", F.lit(default)).alias("value"))
