"""Bibliography records: JSON in, admission, sort keys, names and short references.

B1 incremental sync by version, B2 admission, B3 creators and tags, B7 forms of
reference, F25-F28 parts of entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.relational import latest

#: Kinds of items that have an entry, and creators that come first in one.
ITEM_TYPES = ("book", "journalArticle", "conferencePaper", "report", "bookSection", "thesis", "webpage", "document", "newspaperArticle", "dataset", "blogPost")
SORTED_CREATORS = ("author", "editor", "translator", "contributor")

MORE_FIELDS = ("publicationTitle", "journalAbbreviation", "bookTitle", "proceedingsTitle", "websiteTitle", "blogTitle", "volume", "issue", "edition", "series", "seriesNumber", "place", "publisher", "institution", "university", "thesisType", "reportType", "repository", "numberOfVolumes")

RECORD = "struct<key:string,version:bigint,data:struct<itemType:string,shortTitle:string,title:string,date:string,extra:string,pages:string,DOI:string,url:string,deleted:int,creators:array<struct<creatorType:string,firstName:string,lastName:string,name:string>>,tags:array<struct<tag:string>>," + ",".join(f"{n}:string" for n in MORE_FIELDS) + ">>"


def read_jsonl(spark, path: str) -> DataFrame:
    """One record per line; damaged lines give null records, which are dropped."""
    return spark.read.text(path).select(F.from_json("value", RECORD).alias("r"), F.col("value").alias("json")).where("r.key is not null").select("r.key", "r.version", "r.data", "json")


def sync(stored: DataFrame, modified: DataFrame, deleted: DataFrame, since: int = 1) -> DataFrame:
    """B1: the newest version of each key, without the deleted keys; all have (key, version, data).

    ``modified`` is what changed after version ``since``; from version 0 that is all, and what was stored goes.
    """
    if since <= 0:
        stored = stored.limit(0)
    newest = latest(stored.unionByName(modified), "key", "version", "data")
    return newest.join(deleted.select("key"), "key", "left_anti")


def short_title(data: Column) -> Column:
    return F.nullif(F.trim(data["shortTitle"]), F.lit(""))


def name_last_first(c: Column) -> Column:
    """F26."""
    return F.coalesce(F.nullif(c["name"], F.lit("")), F.concat_ws(", ", F.nullif(c["lastName"], F.lit("")), F.nullif(c["firstName"], F.lit(""))))


def name_first_last(c: Column) -> Column:
    return F.coalesce(F.nullif(c["name"], F.lit("")), F.concat_ws(" ", F.nullif(c["firstName"], F.lit("")), F.nullif(c["lastName"], F.lit(""))))


def creators_reference(creators: Column) -> Column:
    """Last names: one, two with ``and``, or the first and ``et al.``"""
    names = F.transform(creators, lambda c: F.coalesce(F.nullif(c["lastName"], F.lit("")), c["name"]))
    two = F.concat(F.get(names, 0), F.lit(" and "), F.get(names, 1))
    return F.when(F.size(names) <= 1, F.get(names, 0)).when(F.size(names) == 2, two).otherwise(F.concat(F.get(names, 0), F.lit(" et al.")))


def extra_fields(extra: Column) -> Column:
    """``key: value`` or ``key = value`` lines as a map, keys in lower case without spaces; the last of equal keys counts."""
    lines = F.filter(F.split(F.coalesce(extra, F.lit("")), r"\r?\n"), lambda x: x.rlike("[:=]"))
    clean = lambda x, k: F.trim(F.regexp_replace(F.split(x, "[:=]", 2)[k], r"\s+", " "))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.replace(clean(x, 0), F.lit(" "), F.lit(""))).alias("k"), clean(x, 1).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def clean_blank(c: Column) -> Column:
    """``n.d.`` and ``n.pub.`` are no values; long dashes become hyphens."""
    return F.when(c.rlike(r"(?i)\A\s*(?:n\.?\s*(?:d|pub)\.?)?\s*\z"), None).otherwise(F.replace(c, F.lit("–"), F.lit("-")))


def clean_doi(c: Column) -> Column:
    """a DOI without the address of its resolver."""
    return F.nullif(F.regexp_replace(F.trim(c), r"(?i)^(https?://(dx\.)?doi\.org/|doi:\s*)", ""), F.lit(""))


def is_page_range(c: Column) -> Column:
    """whether pages are several."""
    return c.rlike("[-–—,]")


def sort_key(key: Column, data: Column) -> Column:
    """shorthand, else the first creator of a sorted kind and the date; then the key.  Null for other kinds of items."""
    shorthand = F.try_element_at(extra_fields(data["extra"]), F.lit("shorthand"))
    first = F.get(F.filter(data["creators"], lambda c: c["creatorType"].isin(*SORTED_CREATORS)), 0)
    by_name = F.concat_ws(" ", name_last_first(first), clean_blank(data["date"]))
    return F.when(data["itemType"].isin(*ITEM_TYPES), F.concat_ws(" ", F.coalesce(shorthand, by_name), key))


def admitted(records: DataFrame) -> DataFrame:
    """B2: (short_title, key, version, sort_key, data): not deleted, with a short title and a sort key; of equal short titles the highest version."""
    data = F.col("data")
    keyed = records.select("key", "version", "data", short_title(data).alias("short_title"), sort_key(F.col("key"), data).alias("sort_key"))
    fit = keyed.where("short_title is not null and sort_key is not null").where(F.coalesce(data["deleted"], F.lit(0)) == 0)
    return latest(fit, "short_title", "version", "key", "sort_key", "data")


def by_tag(records: DataFrame) -> DataFrame:
    """B3."""
    return records.select(F.explode("data.tags").alias("t"), "key").select("t.tag", "key")


def by_creator(records: DataFrame) -> DataFrame:
    """B3."""
    return records.select(F.explode("data.creators").alias("c"), "key").select(name_first_last(F.col("c")).alias("creator"), F.col("c.creatorType").alias("kind"), "key")


# ---- entries

#: Fixed value: who has no name.
ANONYMOUS = "No name"


def _given(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _stopped(text: Column, shown: Column | None = None) -> Column:
    """A sentence: a full stop follows, unless the text has a stop with no letter or digit after it; null stays null."""
    shown = text if shown is None else shown
    return F.when(text.rlike(r"[.?!][^\p{L}\p{Nd}.?!]*\z"), shown).otherwise(F.concat(shown, F.lit(".")))


def _full_name(c: Column, last_first: bool) -> Column:
    """with what is missing of first and last name anonymous; one name if there is only that."""
    first, last = _given(c["firstName"]), _given(c["lastName"])
    both = F.concat_ws(", ", F.coalesce(last, F.lit(ANONYMOUS)), first) if last_first else F.concat_ws(" ", first, F.coalesce(last, F.lit(ANONYMOUS)))
    return F.when(first.isNotNull(), both).otherwise(F.coalesce(last, _given(c["name"]), F.lit(ANONYMOUS)))


def _people(data: Column, kinds: tuple[str, ...], last_first: bool) -> Column:
    """Creators of some kinds in their order, ``and`` before the last of several; null if there are none."""
    own = F.filter(data["creators"], lambda c: c["creatorType"].isin(*kinds))
    shown = F.transform(own, lambda c, i: F.when((i == 0) & F.lit(last_first), _full_name(c, True)).otherwise(_full_name(c, False)))
    several = F.concat(F.array_join(F.slice(shown, F.lit(1), F.size(shown) - 1), ", "), F.lit(" and "), F.element_at(shown, -1))
    return F.when(F.size(own) == 1, F.get(shown, F.lit(0))).when(F.size(own) > 1, several)


def ordinal_edition(c: Column) -> Column:
    """``2`` as ``2nd edition``; words stay."""
    n = F.regexp_extract(c, r"^\s*(\d+)\s*$", 1)
    suffix = F.when(n.rlike("1[123]$"), "th").when(n.endswith("1"), "st").when(n.endswith("2"), "nd").when(n.endswith("3"), "rd").otherwise("th")
    return F.when(n != "", F.concat(n, suffix, F.lit(" edition"))).otherwise(_given(c))


def _italic(c: Column) -> Column:
    return F.concat(F.lit("<i>"), c, F.lit("</i>"))


def shorthand(data: Column) -> Column:
    return _given(F.try_element_at(extra_fields(data["extra"]), F.lit("shorthand")))


def entry(data: Column) -> Column:
    """An entry as markup, with the parts that its kind has (ENTRY_PARTS); null for kinds without one."""
    short, when = shorthand(data), clean_blank(data["date"])
    original = F.try_element_at(extra_fields(data["extra"]), F.lit("originaldate"))
    dated = F.concat(F.coalesce(F.concat(F.lit("["), F.translate(original, "-", "–"), F.lit("] ")), F.lit("")), F.coalesce(F.translate(when, "-", "–"), F.lit("N.d.")))
    known_date = F.when(short.isNotNull() & when.isNotNull(), dated)  # with a shorthand in front, the date comes later
    front = lambda *kinds: F.when(short.isNotNull(), _stopped(short)).otherwise(F.concat_ws(" ", _stopped(F.coalesce(_people(data, kinds, True), F.lit(ANONYMOUS))), _stopped(dated)))
    by = lambda word, *kinds: _stopped(F.concat(F.lit(f"{word} "), _people(data, kinds, False)))
    late = lambda c: F.when(short.isNotNull(), c)
    field = lambda n: _given(data[n])
    title = field("title")
    numbers = F.translate(clean_blank(data["pages"]), "-", "–")
    pages = F.concat(F.when(is_page_range(data["pages"]), ", pp. ").otherwise(", p. "), numbers)
    quoted = F.concat(F.lit("“"), _stopped(title), F.lit("”"))
    journal = F.coalesce(field("journalAbbreviation"), field("publicationTitle"))
    issue = F.concat_ws(" ", _italic(journal), field("volume"), F.concat(F.lit("("), field("issue"), F.lit(")")), F.concat(F.lit("("), known_date, F.lit(")")))
    place = F.concat(F.coalesce(field("place"), F.lit("No place")), F.coalesce(F.concat(F.lit(": "), clean_blank(_given(data["publisher"]))), F.lit("")), F.coalesce(F.concat(F.lit(", "), known_date), F.lit("")), F.coalesce(pages, F.lit("")))
    doi = F.nullif(F.regexp_extract(F.coalesce(data["DOI"], F.lit("")), r"(?:^|/|:\s*)(10\..*?)/*\s*$", 1), F.lit(""))
    urls = F.filter(F.transform(F.split(F.coalesce(data["url"], F.lit("")), r"\s+"), lambda u: F.regexp_replace(u, ";+$", "")), lambda u: u != "")
    links = F.array_join(F.transform(urls, lambda u: F.concat(F.lit('<link href="'), u, F.lit('">[URL]</link>'))), " ")
    parts = {
        "front": front("author", "editor", "bookAuthor"), "front without editors": front("author"),
        "quoted": F.coalesce(quoted, F.lit("Untitled.")), "quoted if given": quoted, "italics": F.coalesce(_stopped(title, _italic(title)), F.lit("Untitled.")),
        "authors": late(by("By", "author")), "all authors": late(F.concat_ws(" ", by("By", "author", "bookAuthor"), by("Edited by", "editor"))), "editors": F.nullif(F.concat_ws(" ", by("By", "bookAuthor"), by("Edited by", "editor")), F.lit("")),
        "journal": F.when(journal.isNotNull(), _stopped(F.concat(issue, F.coalesce(pages, F.lit(""))))), "proceedings": F.concat(F.lit("In: "), _stopped(field("proceedingsTitle"), _italic(field("proceedingsTitle")))),
        "in book": F.concat_ws(" ", F.concat(F.lit("In: "), _stopped(field("bookTitle"), _italic(field("bookTitle")))), F.when(field("bookTitle").isNotNull(), _stopped(ordinal_edition(data["edition"])))),
        "newspaper": F.coalesce(_stopped(field("publicationTitle"), _italic(field("publicationTitle"))), F.lit("Untitled.")), "edition": _stopped(ordinal_edition(data["edition"])),
        "volume and series": F.concat_ws(" ", _stopped(F.concat(F.lit("Vol. "), field("volume"))), F.when(field("series").isNotNull(), _stopped(F.concat_ws(" ", field("series"), field("seriesNumber")))), F.concat(field("numberOfVolumes"), F.lit(" vols."))),
        "thesis": _stopped(F.concat_ws(", ", F.coalesce(field("thesisType"), F.lit("Thesis")), field("university"))), "place": _stopped(place), "date": _stopped(known_date),
        "website": _stopped(field("websiteTitle")), "blog": F.concat(_italic(field("blogTitle")), F.lit(" (blog).")), "repository": _stopped(field("repository")),
        "idents": F.concat_ws(" ", F.concat(F.lit("DOI: "), F.concat(F.lit('<link href="https://doi.org/'), doi, F.lit('">'), doi, F.lit("</link>."))), F.when(F.size(urls) > 0, F.concat(links, F.lit(".")))),
    }
    # Each part is made once, under its name; the kind's list of names puts them together.
    named = F.create_map(*[x for n, part in parts.items() for x in (F.lit(n), F.nullif(part, F.lit("")))])
    order = F.try_element_at(F.create_map(*[x for kind, names in ENTRY_PARTS.items() for x in (F.lit(kind), F.array(*map(F.lit, names)))]), data["itemType"])
    whole = F.transform(F.array(named), lambda made: F.concat_ws(" ", F.transform(order, lambda n: F.try_element_at(made, n))))[0]
    return F.when(data["itemType"].isin(*ENTRY_PARTS), whole)


#: The parts of an entry by kind of item, in order.
ENTRY_PARTS = {
    "book": ("front", "italics", "all authors", "edition", "volume and series", "place", "idents"),
    "journalArticle": ("front", "quoted", "authors", "journal", "idents"),
    "conferencePaper": ("front without editors", "quoted", "authors", "proceedings", "editors", "volume and series", "place", "idents"),
    "report": ("front", "quoted", "authors", "place", "idents"),
    "bookSection": ("front without editors", "quoted", "authors", "in book", "editors", "volume and series", "place", "idents"),
    "thesis": ("front", "quoted", "authors", "thesis", "place", "idents"),
    "webpage": ("front", "quoted if given", "authors", "date", "website", "idents"),
    "document": ("front", "quoted if given", "authors", "date", "idents"),
    "newspaperArticle": ("front", "quoted", "authors", "newspaper", "edition", "place", "idents"),
    "dataset": ("front", "quoted", "authors", "repository", "date", "idents"),
    "blogPost": ("front", "quoted", "authors", "date", "blog", "idents"),
}


# Tags of titles and the classes that stand for them.
RICH_TEXT = {"em": "italics", "i": "italics", "b": "bold", "sub": "sub", "sup": "sup"}


def rich_text(c: Column) -> Column:
    """The tags that titles may have as spans and links, spans with their two classes; all other tags go, their contents stay; single spaces."""
    uncased, capitals = r"""(?=[^>]*\bclass\s*=\s*["']nocase["'])""", r"""(?=[^>]*\bstyle\s*=\s*["']\s*font-variant\s*:\s*small-caps\s*;?\s*["'])"""
    for looks, made in ((uncased + capitals, ' class="nocase smallcaps"'), (capitals, ' class="smallcaps"'), (uncased, ' class="nocase"'), (r'(?! class="(?:nocase smallcaps|smallcaps|nocase)">)', "")):
        c = F.regexp_replace(c, rf"(?i)<span\b{looks}[^>]*>", f"<span{made}>")
    for tag, name in RICH_TEXT.items():
        c = F.regexp_replace(F.regexp_replace(c, f"(?i)<{tag}>", f'<span class="{name}">'), f"(?i)</{tag}>", "</span>")
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)<a\b([^>]*)>", "<link$1>"), r"(?i)</a>", "</link>")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?i)<(?!/?(?:span|link)\b)[^>]*>", ""), r"\s+", " "))


# Units of cited ranges, with what stands for one and for several, and the words for several.
CITED_UNITS = {
    "volume": ("vol.", "vols.", "volumes"), "appendix": ("appendix", "appendices", "appendices"), "book": ("book", "books", "books"), "section": ("§", "§§", "sections"), "page": ("p.", "pp.", "pages"),
    "item": ("№", "№", "items"), "figure": ("fig.", "figs.", "figures"), "plate": ("plate", "plates", "plates"), "table": ("table", "tables", "tables"), "note": ("n.", "nn.", "notes"),
    "part": ("part", "parts", "parts"), "entry": ("s.v.", "s.vv.", "entries"), "line": ("l.", "ll.", "lines"),
}


def _ranges(location: Column, words: bool) -> Column:
    def shown(x: Column) -> Column:
        value = F.when(x["unit"] == "page", F.replace(x["value"], F.lit("-"), F.lit("–"))).otherwise(x["value"])
        unit = F.lit(None).cast("string")
        for name, (one, several, spelled) in CITED_UNITS.items():
            unit = F.when(x["unit"] == name, F.when(is_page_range(value), spelled if words else several).otherwise(name if words else one)).otherwise(unit)
        return F.concat_ws(" " if words else "\u00a0", unit, value)  # mixed ones have no unit

    return F.array_join(F.transform(location, shown), ", ")


def cited(data: Column, form: str = "default", location: Column | None = None, siglum: Column | None = None) -> Column:
    """A reference with the ranges cited: shorthand or name and date, only shorthand or date (``omitname``), ``ibid.``, or the siglum (``siglum``; as default if it is null)."""
    short = shorthand(data)
    whole = F.coalesce(short, reference(data))
    head = {"default": whole, "omitname": F.coalesce(short, reference(data, "omitname")), "ibid": reference(data, "ibid"), "siglum": F.coalesce(siglum if siglum is not None else F.lit(None).cast("string"), whole)}[form]
    return head if location is None else F.concat(head, F.when(F.size(location) > 0, F.concat(F.lit(", "), _ranges(location, False))).otherwise(""))


def listed_entry(data: Column, location: Column | None = None, siglum: Column | None = None) -> Column:
    """An entry with its siglum before it and the ranges cited, in words, after it."""
    out = entry(data)
    if siglum is not None:
        out = F.concat(F.when(siglum.isNotNull(), F.concat(F.lit("<b>["), siglum, F.lit("]</b> "))).otherwise(""), out)
    if location is None:
        return out
    # Through an array, so that the ranges' expression stands in the plan once.
    said = F.transform(F.array(_ranges(location, True)), lambda r: F.concat(F.lit(" "), F.upper(F.substring(r, 1, 1)), F.substr(r, F.lit(2)), F.lit(".")))
    return F.concat(out, F.when(F.size(location) > 0, F.get(said, F.lit(0))).otherwise(""))


def reference(data: Column, form: str = "default") -> Column:
    """``Name date``, only the date (``omitname``), or ``ibid.``"""
    date = F.coalesce(clean_blank(data["date"]), F.lit("n.d."))
    if form == "omitname":
        return date
    if form == "ibid":
        return F.lit("ibid.")
    return F.concat_ws(" ", creators_reference(data["creators"]), date)
