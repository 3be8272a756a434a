"""V4: keys, references and closed vocabularies, checked rule by rule from tables of rules.

Attributes of all trees are split into their tokens once, (doc_id, pre, name,
attr, token).  References meet keys by document and token, or by token alone
where the keys are those of the whole collection; that is one join for all
rules.  Lists of rules and vocabularies are small tables and are broadcast.

Defined results: a reference is a token that begins with ``#`` (or another
prefix); tokens that don't, are no reference; repeated keys resolve a reference
once; what has no document (null) breaks no rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIQUE, RESOLVES, FOLLOWS, PRECEDES, VOCABULARY = "unique", "resolves", "follows", "precedes", "vocabulary"


@dataclass(frozen=True)
class Rule:
    """What an attribute (of elements of a name, or ``*``) must be, perhaps only where another attribute has a value.

    ``unique``: its tokens stand once in a document; ``resolves``: what they
    refer to is there; ``follows``, ``precedes``: and stands behind or before
    (not around) the element; ``vocabulary``: they are in the list ``of``.
    """

    title: str
    kind: str
    attr: str
    name: str = "*"
    of: str = "document"
    prefix: str = "#"
    where: tuple[str, str] | None = None


def tokens(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, post, name, attrs, attr, token) of all attributes of all tags."""
    tags = nodes.where("kind = 'tag'").select("doc_id", "pre", "post", "name", "attrs", F.explode(F.map_entries("attrs")).alias("a"))
    return tags.select("doc_id", "pre", "post", "name", "attrs", F.col("a.key").alias("attr"), F.explode(F.split(F.trim("a.value"), r"(?U)\s+")).alias("token"))


def _holds(rule: Rule) -> Column:
    own = F.col("attr") == rule.attr
    if rule.name != "*":
        own = own & (F.col("name") == rule.name)
    if rule.where:
        own = own & F.try_element_at("attrs", F.lit(rule.where[0])).eqNullSafe(rule.where[1])
    return own


def violations(nodes: DataFrame, rules: list[Rule], vocabularies: DataFrame | None = None, collection_keys: DataFrame | None = None, key_attr: str = "xml:id") -> DataFrame:
    """(doc_id, pre, rule, token) of every token that breaks a rule.

    ``vocabularies`` has (list, value); ``collection_keys`` has (of, key), the
    keys outside documents that rules with that ``of`` refer to.
    """
    spark = nodes.sparkSession
    found = tokens(nodes)
    applied = F.array_compact(F.array(*[F.when(_holds(r), F.lit(i)) for i, r in enumerate(rules)]))
    asked = found.select("*", F.explode(applied).alias("i"))
    table = spark.createDataFrame([(i, r.title, r.kind, r.of, r.prefix) for i, r in enumerate(rules)], "i int, rule string, test string, of string, prefix string")
    asked = asked.join(F.broadcast(table), "i")  # a row for each rule
    # Tokens that aren't alone.
    often = asked.where(F.col("test") == UNIQUE)
    again = often.groupBy("doc_id", "i", "token").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "i", "token")
    repeated = often.join(again, ["doc_id", "i", "token"], "left_semi")
    # Values that a list doesn't have.
    lists = vocabularies if vocabularies is not None else spark.createDataFrame([], "list string, value string")
    unlisted = asked.where(F.col("test") == VOCABULARY).join(F.broadcast(lists.select(F.col("list").alias("of"), F.col("value").alias("token")).distinct()), ["of", "token"], "left_anti")
    # References: with the places of the keys of their document, or to keys of the collection.
    refers = asked.where(F.col("test").isin(RESOLVES, FOLLOWS, PRECEDES) & F.expr("startswith(token, prefix)")).withColumn("key", F.expr("substr(token, length(prefix) + 1)"))
    inside = refers.where("of = 'document'")
    keys = found.where(F.col("attr") == key_attr).groupBy("doc_id", F.col("token").alias("key")).agg(F.collect_set(F.struct("pre", "post")).alias("at"))
    met = inside.join(keys, ["doc_id", "key"], "left")
    behind = F.exists("at", lambda k: (k["pre"] > F.col("pre")) & (k["post"] > F.col("post")))
    before = F.exists("at", lambda k: (k["pre"] < F.col("pre")) & (k["post"] < F.col("post")))
    fine = F.when(F.col("at").isNull(), False).when(F.col("test") == FOLLOWS, behind).when(F.col("test") == PRECEDES, before).otherwise(True)
    astray = met.where(~fine)
    outside = collection_keys if collection_keys is not None else spark.createDataFrame([], "of string, key string")
    unknown = refers.where("of <> 'document'").join(outside.select("of", "key").distinct(), ["of", "key"], "left_anti")
    parts = [df.select("doc_id", "pre", "rule", "token") for df in (repeated, unlisted, astray, unknown)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).distinct()


# Closed lists of the names of months and fortnights.
MONTHS = ("caitra", "vaisakha", "jyaistha", "asadha", "sravana", "bhadrapada", "asvina", "karttika", "margasira", "pausa", "magha", "phalguna")
FORTNIGHTS = ("dark", "bright")
VOCABULARIES = [*(("month", m) for m in MONTHS), *(("fortnight", f) for f in FORTNIGHTS)]
EDITION_KEYS = [
    Rule("an identifier stands once", UNIQUE, "xml:id"),
    Rule("the element indicated by spanTo must follow", FOLLOWS, "spanTo"),
    Rule("the element indicated by target must be there", RESOLVES, "target", "ref"),
    Rule("the element that is copied must precede", PRECEDES, "copyOf"),
    Rule("a month has one of the twelve names", VOCABULARY, "key", "rs", "month", where=("type", "month")),
    Rule("a fortnight is dark or bright", VOCABULARY, "subtype", "rs", "fortnight", where=("type", "fortnight")),
    Rule("a source must be in the bibliography", RESOLVES, "source", of="bibliography", prefix="bib:"),
]
