"""What editions hold, as joins and windows over the rows of their trees: verses, apparatus, notes, languages.

Every function takes ``nodes`` rows of any number of documents.  What a node
has from its ancestors or its children comes from one pass in document order
with a stack of the open nodes, never from nodes met with all of their document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.text import clean_passage, normalize_space
from glyphmill.operators.nodes import texts
from glyphmill.operators.tours import Open, carried_down, down_and_up

#: Elements of a verse line whose text is none of the line's.
NO_TEXT = ("rdg", "note", "milestone", "pb", "lb", "gap", "del", "label")
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def nearest_above(tags: DataFrame, own: Column, name: str = "value") -> DataFrame:
    """``tags`` (doc_id, pre, level, ...) with ``own`` where it isn't null, else that of the nearest ancestor that has one."""
    return carried_down(tags.withColumn(name, own), name, lambda above, value: above if value is None else value)


def joined_above(tags: DataFrame, own: Column, separator: str, name: str = "value") -> DataFrame:
    """``tags`` with ``own`` of all ancestors from the root down and of the tag itself, those that are null or empty left out; empty if there is none."""
    return carried_down(tags.withColumn(name, own), name, lambda above, value: separator.join(x for x in (above, value) if x))


def attribute(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def _tags(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind in ('tag', 'tree')").select("doc_id", "pre", "post", "parent_pre", "level", "name", "attrs")


# ---- verses

def verse_numbers(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, number) of each ``lg``: the numbers of the divisions around it and its own (``?`` if it has none), with dots between."""
    numbered = joined_above(_tags(nodes), F.when(F.col("name") == "div", attribute("n")), ".", "above")
    return numbered.where("name = 'lg'").select("doc_id", "pre", F.concat_ws(".", F.nullif("above", F.lit("")), F.coalesce(attribute("n"), F.lit("?"))).alias("number"))


def verse_lines(nodes: DataFrame) -> DataFrame:
    """PP1, PP2: (doc_id, verse, number, at, text): the lines of verses in order, clean.

    A verse whose lines aren't lettered a, b, c and so on, or that has no
    letter in its text, is left out.  Text within some elements isn't the
    line's; a space is a blank; a line that runs on from the one before begins
    with a hyphen.
    """
    tags = _tags(nodes)
    verses = tags.where("name = 'lg'").select("doc_id", F.col("pre").alias("verse"))
    lines = tags.where("name = 'l'").select("doc_id", F.col("pre").alias("line"), F.col("parent_pre").alias("verse"), F.coalesce(attribute("n"), F.lit("X")).alias("n"), F.coalesce(attribute("enjamb"), F.lit("")).alias("enjamb")).join(verses, ["doc_id", "verse"], "left_semi")
    letters = lines.groupBy("doc_id", "verse").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "n"))), lambda x: x["n"]), "").alias("letters"))
    fit = letters.where((F.col("letters") == F.substr(F.lit(LETTERS), F.lit(1), F.length("letters")))).select("doc_id", "verse")
    # The nearest of a line and of the elements without text around a piece of text decides what it is.
    around = F.when(F.col("name") == "l", F.struct(F.col("pre").alias("line"), F.lit(True).alias("shown"))).when(F.col("name").isin(*NO_TEXT, "space"), F.struct(F.col("pre").alias("line"), F.lit(False).alias("shown")))
    held = nearest_above(tags, around, "held").select("doc_id", F.col("pre").alias("parent_pre"), "held")
    strings = nodes.where("kind = 'string'").select("doc_id", "pre", "parent_pre", "data")
    spaces = nodes.where("kind = 'tag' and name = 'space'").select("doc_id", "pre", "parent_pre", F.lit(" ").alias("data"))
    pieces = strings.unionByName(spaces).join(held, ["doc_id", "parent_pre"]).where("held.shown").select("doc_id", F.col("held.line").alias("line"), "pre", "data")
    raw = pieces.groupBy("doc_id", "line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pre", "data"))), lambda x: x["data"]), "").alias("raw"))
    clean = lines.join(fit, ["doc_id", "verse"], "left_semi").join(raw, ["doc_id", "line"], "left").withColumn("text", clean_passage(F.coalesce("raw", F.lit(""))))
    clean = clean.withColumn("text", F.when((F.col("enjamb") == "yes") & ~F.col("text").startswith("-"), F.concat(F.lit("-"), "text")).otherwise(F.col("text")))
    spoken = clean.where(F.col("text").rlike(r"\p{L}")).select("doc_id", "verse").distinct()
    at = (F.row_number().over(Window.partitionBy("doc_id", "verse").orderBy("line")) - 1).cast("long")
    numbers = verse_numbers(nodes).withColumnRenamed("pre", "verse")
    return clean.join(spoken, ["doc_id", "verse"], "left_semi").join(numbers, ["doc_id", "verse"]).select("doc_id", "verse", "number", at.alias("at"), "text")


# ---- apparatus and notes

def sigla(nodes: DataFrame) -> DataFrame:
    """(doc_id, ref, siglum) of the bibliographies in editions: items with a short name of their own, the first of those that point to one work."""
    tags = _tags(nodes)
    items = tags.where("name = 'bibl'").select("doc_id", F.col("pre").alias("item"), attribute("n").alias("siglum")).where("siglum is not null")
    works = tags.where("name = 'ptr'").select("doc_id", F.col("parent_pre").alias("item"), "pre", F.regexp_replace(attribute("target"), "^bib:", "").alias("ref")).where("ref is not null")
    return works.join(items, ["doc_id", "item"]).groupBy("doc_id", "ref").agg(F.min_by("siglum", "pre").alias("siglum"))


def _resolved(parts: DataFrame, nodes: DataFrame, works: DataFrame | None) -> DataFrame:
    """``parts`` (doc_id, pre, sources) with each source by its siglum, else as the bibliography ``works`` (ref, shown) shows it, else as it is."""
    told = parts.select("doc_id", "pre", F.posexplode("sources").alias("at", "ref")).join(sigla(nodes), ["doc_id", "ref"], "left")
    shown = F.coalesce("siglum", "ref")
    if works is not None:
        told, shown = told.join(works.select("ref", F.col("shown").alias("_work")), "ref", "left"), F.coalesce("siglum", "_work", "ref")
    named = told.groupBy("doc_id", "pre").agg(F.sort_array(F.collect_list(F.struct("at", shown.alias("shown"))))["shown"].alias("named"))
    return parts.join(named, ["doc_id", "pre"], "left").withColumn("sources", F.coalesce("named", F.array().cast("array<string>"))).drop("named")


def apparatus(nodes: DataFrame, works: DataFrame | None = None) -> DataFrame:
    """(doc_id, list_pre, paragraph, text): the entries of each ``listApp`` that have a lemma with text.

    Consecutive entries of one place share a paragraph (W4).  An entry is its
    place, first lemma, readings and notes, lemma and readings with their
    sources: the siglum that the edition's bibliography gives, else the form
    that ``works`` (ref, shown; one row for each ref) has, else the reference.
    """
    words = texts(nodes).withColumn("text", normalize_space(F.col("text")))
    tags = _tags(nodes)
    sources = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(attribute("source"), F.lit("")), r"\s+"), lambda x: F.regexp_replace(x, "^bib:", "")), lambda x: x != ""))
    parts = tags.where("name in ('lem', 'rdg', 'note')").select("doc_id", "pre", F.col("parent_pre").alias("app"), "name", sources.alias("sources")).join(words, ["doc_id", "pre"])
    parts = _resolved(parts, nodes, works)
    shown = F.concat_ws(" ", F.nullif("text", F.lit("")), F.when(F.col("name") != "note", F.nullif(F.array_join("sources", " "), F.lit(""))))
    listed = F.sort_array(F.collect_list(F.struct("pre", "name", shown.alias("shown"), "text")))
    grouped = parts.groupBy("doc_id", "app").agg(listed.alias("parts"))
    of = lambda name: F.filter("parts", lambda x: x["name"] == name)
    joined = lambda name, by: F.array_join(F.transform(of(name), lambda x: x["shown"]), by)
    lists = tags.where("name = 'listApp'").select("doc_id", F.col("pre").alias("list_pre"))
    apps = tags.where("name = 'app'").select("doc_id", F.col("pre").alias("app"), F.col("parent_pre").alias("list_pre"), F.coalesce(attribute("loc"), F.lit("")).alias("loc")).join(lists, ["doc_id", "list_pre"], "left_semi")
    readings, notes = F.size(of("rdg")) > 0, F.size(of("note")) > 0
    entry = F.concat(
        F.when(F.col("loc") != "", F.concat(F.lit("⟨"), "loc", F.lit("⟩ "))).otherwise(""), F.get(of("lem"), F.lit(0))["shown"],
        F.when(readings, F.concat(F.lit(" ◇ "), joined("rdg", "; "), F.when(notes, "").otherwise("."))).otherwise(""),
        F.when(notes, F.concat(F.lit(" • "), joined("note", " • "))).otherwise(""),
    )
    filled = apps.join(grouped, ["doc_id", "app"]).where(F.exists(of("lem"), lambda x: x["text"] != "")).withColumn("entry", entry)
    w = Window.partitionBy("doc_id", "list_pre").orderBy("app")
    begins = (~F.lag("loc").over(w).eqNullSafe(F.col("loc"))).cast("int")
    marked = filled.withColumn("_new", begins).withColumn("paragraph", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lines = marked.groupBy("doc_id", "list_pre", "paragraph").agg(F.sort_array(F.collect_list(F.struct("app", "entry"))).alias("e"))
    return lines.select("doc_id", "list_pre", "paragraph", F.array_join(F.transform("e", lambda x: x["entry"]), " — ").alias("text"))


def numbered_notes(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, n, text) of notes outside the apparatus, numbered from 1 in document order."""
    tags = _tags(nodes)
    inside = nearest_above(tags, F.when(F.col("name").isin("app", "div"), F.col("name")), "within").where("name = 'note' and (within is null or within <> 'app')")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("pre")).cast("long")
    return inside.join(texts(nodes), ["doc_id", "pre"]).select("doc_id", "pre", n.alias("n"), normalize_space(F.col("text")).alias("text"))


def gap_forms(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, logical, physical, search, tip) of every gap."""
    from glyphmill.operators.editions import GAP_MARK

    tags = _tags(nodes)
    unsure = tags.where("name = 'certainty'").where((attribute("match") == "..") & (attribute("locus") == "name")).select("doc_id", F.col("parent_pre").alias("pre"), F.lit(True).alias("unsure")).distinct()
    gaps = tags.where("name = 'gap'").join(unsure, ["doc_id", "pre"], "left")
    word = lambda a, default: F.coalesce(attribute(a), F.lit(default))
    gaps = gaps.select("doc_id", "pre", word("reason", "undefined").alias("reason"), word("unit", "character").alias("unit"), word("quantity", "").alias("q"), (word("precision", "") == "low").alias("low"), "unsure")
    why = F.concat(F.when(F.col("unsure"), "possibly ").otherwise(""), F.when(F.col("reason") == "undefined", "lost or illegible").otherwise(F.col("reason")))
    named = F.when(F.col("unit") == "component", "character component").otherwise(F.col("unit"))
    gaps = gaps.withColumn("why", why).withColumn("named", named).withColumn("n", F.when(F.col("q").rlike("^[0-9]+$"), F.col("q").cast("int")))
    about = F.when(F.col("low"), "ca. ").otherwise("")
    what = F.concat_ws(" ", "why", F.concat("named", F.when(F.col("n") == 1, "").otherwise("s")))
    sized = F.concat_ws(" ", F.col("n"), what)
    sign = F.when(F.col("why") == "lost", "+").when(F.col("why") == "illegible", "×").otherwise("*")
    dots, stars = F.repeat(F.lit(GAP_MARK), F.col("n")), F.repeat(F.lit("*"), F.col("n"))
    character, component, known = F.col("unit") == "character", F.col("unit") == "component", F.col("n").isNotNull()
    unknown = F.when(character, "[…]").otherwise(F.concat(F.lit("[unknown number of "), "why", F.lit(" "), "named", F.lit("s]")))
    body = F.when(character, F.concat(about, "n", sign)).when(component, F.concat(about, dots)).otherwise(F.concat(about, sized))
    logical = F.when(known, F.concat(F.lit("["), body, F.lit("]"))).otherwise(unknown)
    physical = F.when(known & character, F.concat(F.lit("["), stars, F.lit("]"))).otherwise(logical)
    search = F.when(known & character, dots).when(known & component, GAP_MARK).otherwise(5 * GAP_MARK)
    tip = F.when(known, F.concat(F.when(F.col("low"), "About ").otherwise(""), sized)).otherwise(F.concat(F.lit("Unknown number of "), "why", F.lit(" "), "named", F.lit("s")))
    untold = F.col("reason") == "ellipsis"
    shown = lambda c: F.when(untold, "…").otherwise(c)
    return gaps.select("doc_id", "pre", shown(logical).alias("logical"), shown(physical).alias("physical"), shown(search).alias("search"), F.when(untold, "").otherwise(tip).alias("tip"))


# ---- languages

#: Names of what is in some source language, and of the script of translations.
SOURCE_LANGUAGE, SOURCE_SCRIPT, STUDY_SCRIPT = "source_other", "source_other", "latin"
FORCED = ("foreign", "lem", "rdg")
#: Elements whose ``xml:lang`` counts; a heading tells nothing of what it stands in.
SENSITIVE = ("div", "note", "p", "ab", "lg", "q", "head", "quote", "label", "foreign", "seg", "lem", "rdg", "ex")
HEADING = "head"

_SPOKEN = ["doc_id", "level", "pre", "kind", "name", "forced", "language", "is_source", "script", "script_is_source"]


def _spoken_text() -> Column:
    return (F.col("kind") == "string") & F.col("data").rlike(r"(?U)\S")


def assigned_languages(nodes: DataFrame, languages: DataFrame, scripts: DataFrame, default: tuple[str, str] = ("eng", STUDY_SCRIPT)) -> DataFrame:
    """(doc_id, pre, language, script, is_source) of every tag.

    ``languages`` (code, language, is_source) and ``scripts`` (code, script,
    script_is_source) say what ``xml:lang`` (up to its hyphen) and the last
    class in ``rendition`` mean.  On the way down a tag has what it says itself,
    if it is one whose ``xml:lang`` counts, else its parent's.  Foreign words,
    lemmas, readings and editions are always in a source language and script.
    Where the language alone changes between source and study, the script
    starts anew.  On the way up a tag takes the language of its children, tags
    but headings and texts that aren't blank, if all have the same one.
    """
    code = F.substring_index(attribute("xml:lang"), "-", 1)
    classes = F.filter(F.split(F.trim(attribute("rendition")), r"\s+"), lambda x: x.startswith("class:"))
    # A class given without the word before it counts too.
    scode = F.coalesce(F.nullif(F.replace(F.try_element_at(classes, F.lit(-1)), F.lit("class:"), F.lit("")), F.lit("undetermined")), F.when(~attribute("rendition").contains("class:"), attribute("rendition")))
    told = nodes.where(F.col("kind").isin("tag", "tree") | _spoken_text()).withColumn("code", code).withColumn("scode", scode)
    told = told.join(F.broadcast(languages), "code", "left").join(F.broadcast(scripts.withColumnRenamed("code", "scode")), "scode", "left")  # lists of languages and scripts
    forced = F.coalesce(F.col("name").isin(*FORCED) | ((F.col("name") == "div") & (attribute("type") == "edition")), F.lit(False))
    first = (*default, False)

    def down(parent: Open | None, row: tuple) -> tuple:
        _, _, _, kind, name, forced, language, is_source, script, script_is_source = row
        above = parent.value if parent else first
        if kind != "tag" or not forced and name not in SENSITIVE:
            return above
        if forced:
            return language if is_source else SOURCE_LANGUAGE, script if script_is_source else SOURCE_SCRIPT, True
        if language is None and script is None:
            return above
        source = above[2] if language is None else bool(is_source)
        if script is None:
            script = above[1] if source == above[2] else SOURCE_SCRIPT if source else STUDY_SCRIPT
        return above[0] if language is None else language, script, source

    def up(node: Open) -> tuple:
        doc, _, pre, kind, name, *_ = node.row
        if kind == "string":
            return node.value, None
        value = node.value
        if kind == "tag" and len({v[:2] for v in node.given}) == 1:
            value = min(node.given)
        return (None if name == HEADING else value), (doc, pre, *value) if kind == "tag" else None

    rows = told.withColumn("forced", forced)
    return down_and_up(rows, _SPOKEN, f"doc_id {dict(nodes.dtypes)['doc_id']}, pre long, language string, script string, is_source boolean", down, up)


#: Layout that is no language, and the text in it that is one; what has no language; the language of pages.
LAYOUT, IN_LAYOUT, NO_LANGUAGE, PAGE_LANGUAGE = ("npage", "nline", "ncell"), ("span", "fw-contents"), "zxx latin", "eng latin"


def completed_languages(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, lang) of the tags of internal documents that have a text of their own.

    A tag has its own ``lang``, else its parent's, at last that of pages.  Page,
    line and cell marks and all in them are no language, but for the running
    text in them, which has the language around the mark.
    """
    tags = _tags(nodes)
    own = F.struct(F.col("name"), attribute("lang").alias("lang"), attribute("class").alias("class"), F.lit(False).alias("mark"))

    def step(above, row):
        lang, mark = (above["lang"], above["mark"]) if above else (PAGE_LANGUAGE, False)
        if mark and (row["name"], row["class"]) != IN_LAYOUT:
            return {**row, "lang": lang, "mark": True}
        if row["name"] in LAYOUT:
            return {**row, "lang": lang, "mark": True}
        return {**row, "lang": row["lang"] or lang, "mark": False}

    spoken = carried_down(tags.withColumn("spoken", own), "spoken", step).where("name is not null")
    with_text = nodes.where(_spoken_text()).select("doc_id", F.col("parent_pre").alias("pre")).distinct()
    lang = F.when(F.col("spoken.mark"), NO_LANGUAGE).otherwise(F.col("spoken.lang"))
    return spoken.join(with_text, ["doc_id", "pre"], "left_semi").select("doc_id", "pre", lang.alias("lang"))
