"""V4, V6: structural rules as conditions on the rows of trees.

A rule is a condition on a tag, its parent, its siblings and its path, so one
pass with one window over siblings checks all rules of all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.operators.trees import attribute, nearest_above

def schema_of(name: Column, schemas: dict[str, str]) -> Column:
    """V6: which rules a file has, by the start of its name (``schemas``: start to rules); null if none."""
    out = F.lit(None).cast("string")
    for start, schema in schemas.items():
        out = F.when(name.startswith(start), schema).otherwise(out)
    return out


def _has(*names: str) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | attribute(n).isNotNull()
    return out


def _within(*names: str) -> Column:
    """The tag has an ancestor of one of these names."""
    return F.col("path").rlike(rf"/({'|'.join(names)})\[\d+\]/")


def _under(*names: str) -> Column:
    return F.col("parent_name").isin(*names)



def inscription_rules() -> dict[str, Column]:
    """Rule by rule: when a tag breaks it.  Columns: name, attrs, path, parent_name, parent_attrs, before and after (names of sibling tags), children (their names), division, blank."""
    name = F.col("name")
    is_ = lambda *names: name.isin(*names)
    value = lambda a: F.coalesce(attribute(a), F.lit(""))
    child = lambda c: F.array_contains("children", c)
    up = lambda a: F.coalesce(F.try_element_at("parent_attrs", F.lit(a)), F.lit(""))
    division = F.coalesce("division", F.lit(""))
    count = lambda c: F.size(F.filter("children", lambda x: x == c))
    lemma_holds = {f"a lemma may not contain {c}": is_("lem") & child(c) for c in ("p", "ab", "lg")}
    reading_holds = {f"a reading may not contain {c}": is_("rdg") & child(c) for c in ("p", "ab", "lg", "l")}
    return {
        "when excludes other dates": _has("when") & _has("notBefore", "notAfter", "from", "to"),
        "from excludes notBefore": _has("from") & _has("notBefore"),
        "to excludes notAfter": _has("to") & _has("notAfter"),
        "a calendar needs text": _has("calendar") & F.col("blank"),
        "unitRef makes unit unnecessary": _has("unitRef") & _has("unit"),
        "subtype requires type": _has("subtype") & ~_has("type"),
        "targetLang requires target": _has("targetLang") & ~_has("target"),
        "schemeVersion requires a scheme": _has("schemeVersion") & (~_has("scheme") | (value("scheme") == "free")),
        "stanzas only in editions and translations": is_("p", "ab") & (value("rend") == "stanza") & ~division.isin("edition", "translation", "textpart"),
        "corresp only with a stanza in a translation": is_("p") & _has("corresp") & ~((value("rend") == "stanza") & (division == "translation")),
        "value excludes a range": is_("num") & _has("value") & _has("atLeast", "atMost"),
        "atMost needs atLeast": is_("num") & _has("atMost") & ~_has("atLeast"),
        "atLeast needs atMost": is_("num") & _has("atLeast") & ~_has("atMost"),
        "a gloss list needs labels": is_("list") & (value("type") == "gloss") & ~child("label"),
        "notes cannot nest": is_("note") & _within("note"),
        "no note in a paragraph of the apparatus": is_("note") & (division == "apparatus") & _under("p"),
        "no note in a reading or lemma": is_("note") & _under("lem", "rdg"),
        "a note is last in a bibliography item": is_("note") & _under("bibl") & _within("listBibl") & F.col("after").isNotNull() & (F.col("after") != "note"),
        "an apparatus note is last": is_("note") & _under("app") & F.col("after").isNotNull() & (F.col("after") != "note"),
        "citedRange holds no note": is_("citedRange") & _within("listBibl") & child("note"),
        "a line is in a verse or stanza": is_("l") & ~(_under("lg") | (_under("p", "ab") & (up("rend") == "stanza")) | _under("lem", "rdg")),
        "lines of a mixed stanza need a metre": is_("l") & _under("lg") & (up("met") == "mixed") & ~_has("real", "met"),
        "fw follows a page or another fw": is_("fw") & ~F.coalesce(F.col("before").isin("pb", "fw"), F.lit(False)),
        "certainty of a metre needs a verse": is_("certainty") & (value("match") == "../@met") & ~_under("lg"),
        "certainty of a name needs a gap": is_("certainty") & (value("match") == "..") & ~_under("gap"),
        "certainty of a metre is of its value": is_("certainty") & (value("match") == "../@met") & (value("locus") != "value"),
        "certainty of a gap is of its name": is_("certainty") & (value("match") == "..") & (value("locus") != "name"),
        "a segment's subtype needs type component": is_("seg") & _has("subtype") & (value("type") != "component"),
        "uncertain segments only in translations": is_("seg") & (value("cert") == "low") & (division != "translation"),
        "puns only in translations": is_("seg") & (value("rend") == "pun") & (division != "translation"),
        "a lemma alone needs a source": is_("lem") & _under("app") & ~_has("source") & F.col("after").isNull() & F.col("before").isNull(),
        "app is in a listApp": is_("app") & ~_under("listApp"),
        "a lemma has no single line": is_("lem") & (count("l") == 1),
        **lemma_holds, **reading_holds,
    }


def violations(nodes: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(doc_id, pre, line, rule) of every tag and rule that it breaks."""
    tags = nodes.where("kind in ('tag', 'tree')").select("doc_id", "pre", "parent_pre", "level", "name", "attrs", "path", "line", "sib", (F.col("chars_end") == F.col("chars")).alias("blank"))
    held = nearest_above(tags, F.when(F.col("name") == "div", F.coalesce(attribute("type"), F.lit(""))), "division")
    siblings = Window.partitionBy("doc_id", "parent_pre").orderBy("sib")
    held = held.withColumn("before", F.lag("name").over(siblings)).withColumn("after", F.lead("name").over(siblings))
    parents = tags.select("doc_id", F.col("pre").alias("parent_pre"), F.col("name").alias("parent_name"), F.col("attrs").alias("parent_attrs"))
    children = tags.where("parent_pre is not null").groupBy("doc_id", F.col("parent_pre").alias("pre")).agg(F.collect_list("name").alias("children"))
    rows = held.join(parents, ["doc_id", "parent_pre"], "left").join(children, ["doc_id", "pre"], "left").withColumn("children", F.coalesce("children", F.array().cast("array<string>")))
    rows = rows.where("name is not null").withColumn("path", F.coalesce("path", F.lit(""))).withColumn("parent_name", F.coalesce("parent_name", F.lit("")))
    broken = F.array_compact(F.array(*[F.when(F.coalesce(condition, F.lit(False)), F.lit(rule)) for rule, condition in rules.items()]))
    return rows.select("doc_id", "pre", "line", F.explode(broken).alias("rule"))


def letters_in_order(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, rule) of verses in which two lines have one ``n``."""
    lines = nodes.where("kind = 'tag' and name = 'l'").select("doc_id", F.col("parent_pre").alias("pre"), attribute("n").alias("n")).where("n is not null")
    verses = nodes.where("kind = 'tag' and name = 'lg'").select("doc_id", "pre")
    twice = lines.groupBy("doc_id", "pre", "n").agg(F.count("*").alias("k")).where("k > 1").select("doc_id", "pre").distinct()
    return verses.join(twice, ["doc_id", "pre"], "left_semi").withColumn("rule", F.lit("lines of a verse have numbers of their own"))
