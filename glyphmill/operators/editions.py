"""Editions in XML into their displays: logical, physical, full and searchable text, notes and metadata.

A document's elements are taken depth first.  What an element adds to each
view is in small tables, one for each group of elements; an element that no
table has gives its contents and a message.  All of a document is handled in
one place, as edits within it depend on each other; documents are independent.

Views: ``logical`` has the text as read, ``physical`` as written (uncorrected,
by page and line), ``full`` everything with its brackets, ``search`` plain text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.nodes import parse_xml

VIEWS = ("logical", "physical", "full", "search")

# Fixed values (as are SPACES, FRACTIONS, AROUND and SKIPPED): brackets by element and by the value of its attribute ("" for any other).
BRACKETS = {
    "supplied": ("reason", {"lost": "[]", "omitted": "⟨⟩", "subaudible": "⟨⟩", "explanation": "()", "undefined": "[]", "": "[]"}),
    "unclear": ("", {"": "()"}),
    "surplus": ("", {"": "{}"}),
    "add": ("", {"": ("⟨⟨", "⟩⟩")}),
    "del": ("", {"": "⟦⟧"}),
    "sic": ("", {"": "¿?"}),
    "corr": ("", {"": "⟨⟩"}),
    "orig": ("", {"": "¡!"}),
    "reg": ("", {"": "⟨⟩"}),
    "ex": ("", {"": "()"}),
}
#: Which of a choice's parts each view takes.
CHOICES = {("sic", "corr"): {"logical": "corr", "physical": "sic", "search": "corr"}, ("orig", "reg"): {"logical": "reg", "physical": "orig", "search": "reg"}, ("abbr", "expan"): {"logical": "expan", "physical": "abbr", "search": "expan"}}
# What stands for a space of each type; the types that are as wide as their quantity.
SPACES = {"semantic": "_", "binding-hole": "◯", "descender": "⊔", "ascender": "⊓", "defect": "□", "feature": "_", "vacat": "_", "unclassified": "_"}
WIDE_SPACES = frozenset(("semantic", "vacat", "unclassified"))
# Fractions that are characters.
FRACTIONS = {
    (0, 3): "↉", (1, 2): "½", (1, 3): "⅓", (1, 4): "¼", (1, 5): "⅕", (1, 6): "⅙", (1, 7): "⅐", (1, 8): "⅛", (1, 9): "⅑",
    (2, 3): "⅔", (2, 5): "⅖", (3, 4): "¾", (3, 5): "⅗", (3, 8): "⅜", (4, 5): "⅘", (5, 6): "⅚", (5, 8): "⅝", (7, 8): "⅞",
}
TRANSPARENT = frozenset("TEI text body roleName measure date placeName persName term gloss foreign hi seg num title q quote cit abbr expan am subst rdg lem w".split())
IGNORED = frozenset("teiHeader editionStmt facsimile handShift publicationStmt encodingDesc revisionDesc certainty listBibl listApp fw".split())
BLOCKS = frozenset("p ab lg l div list item head".split())
GAP_MARK = "."


def plural(unit: str, n: int) -> str:
    """The regular plural."""
    return unit if n == 1 else f"{unit}s"


def space_view(kind: str = "", quantity: str = "") -> str:
    """What stands for a space in the views that show it; unknown types are semantic."""
    kind = kind if kind in SPACES else "semantic"
    return SPACES[kind] * (max(1, int(quantity)) if kind in WIDE_SPACES and quantity.isdigit() else 1)


#: How a gap of a known size is shown by its unit: logical, physical and searchable form.  {a} is "ca. " or nothing, {n} the
#: quantity, {s} its sign, {dots} and {stars} that many characters, {what} the reason and the unit.
GAP_FORMS = {
    "character": ("[{a}{n}{s}]", "[{stars}]", "{dots}"),
    "component": ("[{a}{dots}]", "[{a}{dots}]", GAP_MARK),
    "": ("[{a}{n} {what}]", "[{a}{n} {what}]", 5 * GAP_MARK),
}


def gap_views(reason: str = "", quantity: str = "", unit: str = "", precision: str = "", uncertain: bool = False) -> dict[str, str]:
    """what stands for a gap in each view, and its tooltip."""
    if reason == "ellipsis":
        return dict.fromkeys(VIEWS, "…") | {"tip": ""}
    unit = unit or "character"
    why = ("possibly " if uncertain else "") + ("lost or illegible" if reason in ("", "undefined") else reason)
    named = "character component" if unit == "component" else unit
    if not quantity.isdigit():
        text = "[…]" if unit == "character" else f"[unknown number of {why} {plural(named, 2)}]"
        return {"logical": text, "physical": text, "full": text, "search": 5 * GAP_MARK, "tip": f"Unknown number of {why} {plural(named, 2)}"}
    n, what, low = int(quantity), f"{why} {plural(named, int(quantity))}", precision == "low"
    parts = {"a": "ca. " if low else "", "n": n, "s": {"lost": "+", "illegible": "×"}.get(why, "*"), "dots": n * GAP_MARK, "stars": n * "*", "what": what}
    logical, physical, search = (form.format(**parts) for form in GAP_FORMS.get(unit, GAP_FORMS[""]))
    return {"logical": logical, "physical": physical, "full": logical, "search": search, "tip": f"{'About ' if low else ''}{n} {what}"}


_FRACTION = re.compile(r"(\d+)[/⁄](\d+)", re.ASCII)


def fraction(text: str) -> str:
    """a precomposed character, else raised and lowered digits; a text that begins with no fraction stays."""
    found = _FRACTION.match(text)
    if not found:
        return text
    above, below = int(found[1]), int(found[2])
    raised = str(above).translate(str.maketrans("0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")) + "⁄" + str(below).translate(str.maketrans("0123456789", "₀₁₂₃₄₅₆₇₈₉"))
    return FRACTIONS.get((above, below), raised)


@dataclass
class Element:
    name: str | None
    attrs: dict
    text: str
    children: list[Element] = field(default_factory=list)

    def all(self, name: str) -> Iterator[Element]:
        for c in self.children:
            if c.name == name:
                yield c
            yield from c.all(name)

    def words(self) -> str:
        return self.text if self.name is None else "".join(c.words() for c in self.children)


def tree_of(rows: list[dict]) -> Element:
    """The elements and texts of a document's node rows; comments and instructions are left out."""
    by_pre: dict[int, Element] = {}
    for r in rows:
        element = Element(r["name"] or ("" if r["kind"] in ("tree", "tag") else None), r["attrs"] or {}, r["data"] or "")
        if r["kind"] in ("tree", "tag", "string"):
            by_pre[r["pre"]] = element
            if r["parent_pre"] is not None:
                by_pre[r["parent_pre"]].children.append(element)
    return by_pre[0]


@dataclass
class Edition:
    """The views of one edition as they grow."""

    symbols: dict[str, tuple[str, str]] = field(default_factory=dict)
    parts: dict[str, list[str]] = field(default_factory=lambda: {v: [] for v in VIEWS})
    notes: list[str] = field(default_factory=list)
    unknown: set[str] = field(default_factory=set)
    langs: set[str] = field(default_factory=set)
    lines: int = 0

    def put(self, text: str, *views: str) -> None:
        for v in views or VIEWS:
            self.parts[v].append(text)

    def walk(self, e: Element, views: tuple[str, ...] = VIEWS) -> None:
        for c in e.children:
            self.take(c, views)

    def take(self, e: Element, views: tuple[str, ...]) -> None:
        if e.name is None:
            self.put(e.text.replace("'", "’").replace("\n", " "), *views)
            return
        if lang := e.attrs.get("xml:lang"):
            self.langs.add(lang)
        shown = tuple(v for v in views if v != "search")
        if e.name in IGNORED:
            return
        if e.name in BRACKETS:
            self.bracketed(e, views, shown)
        elif e.name == "choice":
            self.choice(e, views)
        elif e.name == "gap":
            unsure = any(c.name == "certainty" and c.attrs.get("match") == ".." and c.attrs.get("locus") == "name" for c in e.children)
            for v, text in gap_views(*(e.attrs.get(k, "") for k in ("reason", "quantity", "unit", "precision")), unsure).items():
                if v in views:
                    self.put(text, v)
        elif e.name in ("pb", "lb", "milestone"):
            self.milestone(e, views)
        elif e.name == "space":
            self.put(space_view(e.attrs.get("type", ""), e.attrs.get("quantity", "")), *shown)
            self.put(" ", *(v for v in views if v == "search"))
        elif e.name == "g":
            text, search = self.symbol(e)
            self.put(text, *shown)
            self.put(search, *(v for v in views if v == "search"))
        elif e.name == "note":
            self.notes.append(" ".join(e.words().split()))
            self.put(f"[{len(self.notes)}]", *(v for v in views if v == "full"))
        elif e.name == "app":
            for lem in (c for c in e.children if c.name == "lem"):
                self.walk(lem, views)
        elif e.name in BLOCKS:
            flowing = tuple(v for v in views if v != "physical")
            self.put("\n", *flowing)
            self.walk(e, views)
            self.put(" " if e.name == "l" and e.attrs.get("enjamb") != "yes" else "", *(v for v in views if v == "physical"))
            self.put("\n", *flowing)
        else:
            if e.name not in TRANSPARENT:
                self.unknown.add(e.name)
            self.walk(e, views)

    def bracketed(self, e: Element, views: tuple[str, ...], shown: tuple[str, ...]) -> None:
        attribute, pairs = BRACKETS[e.name]
        left, right = pairs.get(e.attrs.get(attribute, ""), pairs[""])
        if e.name in ("corr", "reg", "ex", "supplied"):
            # What editors add is not on the object.
            shown, views = (tuple(v for v in x if v != "physical") if e.name != "supplied" else x for x in (shown, views))
        elif e.name in ("sic", "orig"):
            pass
        elif e.name == "del":
            views = tuple(v for v in views if v not in ("search", "logical"))
            shown = views
        self.put(left, *shown)
        self.walk(e, views)
        self.put(("?" if e.attrs.get("cert") == "low" and e.name == "supplied" else "") + right, *shown)

    def choice(self, e: Element, views: tuple[str, ...]) -> None:
        found = {c.name: c for c in e.children if c.name}
        for names, taken in CHOICES.items():
            if set(names) <= set(found):
                for v in views:
                    if v in taken:
                        self.walk(found[taken[v]], (v,))
                    else:
                        for n in names:
                            self.take(found[n], (v,))
                return
        unclear = [c for c in e.children if c.name == "unclear"]
        if unclear:
            self.walk(unclear[0], tuple(v for v in views if v == "search"))
            for v in (v for v in views if v != "search"):
                for k, c in enumerate(unclear):
                    self.put("(" if k == 0 else "/", v)
                    self.walk(c, (v,))
                self.put(")", v)
            return
        self.walk(e, views)

    def milestone(self, e: Element, views: tuple[str, ...]) -> None:
        joined = e.attrs.get("break") == "no"
        n = e.attrs.get("n", "")
        physical = tuple(v for v in views if v == "physical")
        if e.name == "lb":
            self.lines += 1
            self.put(("-" if joined else "") + f"\n({n}) " if n else "\n", *physical)
        elif e.name == "pb":
            self.put(("-" if joined else "") + f"\n⎘ {n}".rstrip(), *physical)
        else:
            self.put(f"⟨{e.attrs.get('unit', 'column')} {n}⟩", *physical)
        self.put(f"({n})" if n else "|", *(v for v in views if v == "full"))
        if not joined:
            self.put(" ", *(v for v in views if v != "physical"))

    def symbol(self, e: Element) -> tuple[str, str]:
        words = e.words().strip()
        if e.attrs.get("type") == "numeral":
            return fraction(words), words
        text, search = self.symbols.get(e.attrs.get("type", ""), (words or "�", words))
        return words or text, search

    def texts(self) -> dict[str, str]:
        return {v: "\n".join(x for x in (" ".join(line.split()) for line in "".join(p).split("\n")) if x) for v, p in self.parts.items()}


def header(root: Element) -> dict:
    """Title, authors, editors and summary; a person counts once."""
    statement = next(root.all("titleStmt"), None)
    of = lambda name: list(dict.fromkeys(t for e in (statement.all(name) if statement else ()) if (t := " ".join(e.words().split()))))
    summary = next(root.all("summary"), None)
    return {"title": "; ".join(of("title")) or None, "authors": of("author"), "editors": of("persName"), "summary": " ".join(summary.words().split()) or None if summary else None}


#: What goes before and after an element of the internal form in its searchable text; elements in SKIPPED have none.
AROUND = {**dict.fromkeys(("para", "verse", "quote", "elist", "dlist"), ("", "\n")), **dict.fromkeys(("item", "key", "value"), (" ", ""))}
SKIPPED = frozenset("note head display npage nline ncell".split())


def searchable_text(e: Element) -> str:
    """Q14: the text of an internal document that a search sees; of a split, its search branch; a space where a verse line breaks."""
    if e.name is None:
        return e.text
    if e.name in SKIPPED:
        return ""
    if e.name == "split":
        return "".join(searchable_text(c) for c in e.children if c.name == "search")
    before, after = AROUND.get(e.name, ("", ""))
    if e.name == "verse-line" and e.attrs.get("break") in ("true", "yes", "on", "1"):
        before = " "
    return before + "".join(map(searchable_text, e.children)) + after


SCHEMA = "doc_id long, title string, authors array<string>, editors array<string>, summary string, langs array<string>, logical string, physical string, full string, search string, notes array<string>, lines int, unknown array<string>, error string"


def render(doc_id: int, data: str | bytes, symbols: dict[str, tuple[str, str]]) -> dict:
    rows = parse_xml(doc_id, data)
    if rows[0].get("error"):
        return {"doc_id": doc_id, "error": f"{rows[0]['line']}:{rows[0]['col']}: {rows[0]['error']}", "authors": [], "editors": [], "langs": ["und"], "notes": [], "unknown": []}
    root = tree_of(rows)
    edition = Edition(symbols)
    for div in [d for d in root.all("div") if d.attrs.get("type") == "edition"] or [root]:
        if lang := div.attrs.get("xml:lang"):
            edition.langs.add(lang)
        edition.walk(div)
    return {"doc_id": doc_id, **header(root), "langs": sorted(edition.langs) or ["und"], **edition.texts(), "notes": edition.notes, "lines": edition.lines, "unknown": sorted(edition.unknown), "error": None}


def displays(df: DataFrame, key: str, content: str, symbols: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """A row per document: metadata, the four views, notes, and elements that no rule has; ``symbols`` maps names to shown and searched text."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    known = dict(symbols or {})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 200):
                part = frame.iloc[at : at + 200]
                out = pd.DataFrame([render(int(i), c or "", known) for i, c in zip(part["k"], part["c"], strict=True)], columns=names, dtype=object)
                out["lines"] = out["lines"].astype("Int32")
                yield out

    return df.select(F.col(key).cast("long").alias("k"), F.col(content).alias("c")).where("k is not null").mapInPandas(run, SCHEMA)
