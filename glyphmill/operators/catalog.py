"""Catalogue search: queries are parsed on the driver and become one Column over the folded index.

Q1-Q9 the catalogue's language of ``field:value`` clauses, all of which must
hold; Q10, Q11 the boolean language with or, and, not and parentheses.
"""

from __future__ import annotations

import itertools
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from glyphmill.functions.collate import sort_columns
from glyphmill.functions.text import fold, fold_text
from glyphmill.operators.relational import page

#: The searchable columns, the shortest term that matches anything, the size of a page.
FIELDS = ("ident", "repo", "title", "author", "editor", "editor_id", "lang", "script", "summary")
LEAST_TERM, PER_PAGE = 3, 50


class InvalidQuery(ValueError):
    pass


@dataclass(frozen=True)
class Term:
    text: str
    field: str | None = None


@dataclass(frozen=True)
class Exact:
    """Any of some whole values of an array column."""

    values: tuple[str, ...]
    field: str


@dataclass(frozen=True)
class Op:
    kind: str  # and, or, not
    parts: tuple


# ---- the catalogue's language

def tokens(query: str) -> list[tuple[str, bool]]:
    """Q2: (text, is a word); words run to a colon or space, quoted ones to their quote; a backslash keeps the next character."""
    out: list[tuple[str, bool]] = []
    at = iter(range(len(query)))
    text, quoted, started = "", False, False

    def end() -> None:
        nonlocal text, started
        if started:
            out.append((text, True))
        text, started = "", False

    for i in at:
        c = query[i]
        if c == "\\" and (quoted or started):
            j = next(at, None)
            if j is None:
                raise InvalidQuery("nothing follows the last backslash")
            text += query[j]
        elif quoted:
            if c == '"':
                quoted = False
                end()
            else:
                text += c
        elif c == '"' and not started:
            quoted = started = True
        elif c == ":":
            end()
            out.append((c, False))
        elif c.isspace():
            end()
        else:
            text, started = text + c, True
    if quoted:
        raise InvalidQuery("a quotation mark is missing")
    end()
    return out


def parse(query: str) -> list[Term]:
    """Q1, Q3: the clauses of a query, folded; bare AND, OR and NOT don't count."""
    words = tokens(" ".join(fold_text(w) for w in query.split() if w not in ("AND", "OR", "NOT")))
    clauses, i = [], 0
    while i < len(words):
        text, is_word = words[i]
        if not is_word:
            raise InvalidQuery("a colon without a field")
        if i + 1 < len(words) and not words[i + 1][1]:
            if i + 2 < len(words) and words[i + 2][1]:
                if text not in FIELDS:
                    raise InvalidQuery(f"no field {text!r}")
                clauses.append(Term(words[i + 2][0], text))
            i += 3
        else:
            clauses.append(Term(text))
            i += 1
    return clauses


def resolve_languages(clauses: list[Term], codes: dict[str, str], names: dict[str, list[str]]) -> list[Term | Exact]:
    """Q4: ``lang:`` of up to three characters is a code; a longer one is part of a name.

    ``codes`` maps codes to ids, ``names`` ids to folded names; both are dimension tables of a bounded size.
    """
    out: list[Term | Exact] = []
    for c in clauses:
        if c.field != "lang":
            out.append(c)
        elif len(c.text) <= 3:
            out.append(Exact((codes[c.text],) if c.text in codes else (), "lang"))
        else:
            out.append(Exact(tuple(sorted(i for i, own in names.items() if any(c.text in n for n in own))), "lang"))
    return out


def condition(node, index: dict[str, Column]) -> Column:
    """Q5-Q7: what a row of the index must fulfil; ``index`` has a folded column for each field."""
    if isinstance(node, Op):
        parts = [condition(p, index) for p in node.parts]
        return ~parts[0] if node.kind == "not" else reduce(Column.__and__ if node.kind == "and" else Column.__or__, parts)
    if isinstance(node, Exact):
        return reduce(Column.__or__, [index[node.field].eqNullSafe(v) for v in node.values], F.lit(False))
    if len(node.text) < LEAST_TERM:
        return F.lit(False)
    if node.field is not None and node.field not in index:
        raise InvalidQuery(f"no field {node.field!r}")
    columns = [index[node.field]] if node.field else list(index.values())
    return reduce(Column.__or__, [F.coalesce(c.contains(node.text), F.lit(False)) for c in columns])


def folded_index(df: DataFrame, fields: dict[str, Column], key: str) -> DataFrame:
    """Q8: the key and each field folded; arrays are joined by a vertical bar.  Write it once, then search it."""
    texts = {n: F.array_join(c, "|") if dict(df.select(c.alias("x")).dtypes)["x"].startswith("array") else c for n, c in fields.items()}
    return df.select(key, *[fold(F.coalesce(c.cast("string"), F.lit(""))).alias(n) for n, c in texts.items()])


def search(index: DataFrame, query: str, fields: list[str], codes: dict[str, str] | None = None, names: dict[str, list[str]] | None = None) -> DataFrame:
    """The rows of the index that a query selects; an empty query selects all."""
    clauses = resolve_languages(parse(query), codes or {}, names or {})
    own = {f: F.col(f) for f in fields}
    return index.where(condition(Op("and", tuple(clauses)), own)) if clauses else index


def search_page(found: DataFrame, sort: str, key: str, number: int = 1, size: int = PER_PAGE) -> DataFrame:
    """A page in dictionary order of ``sort``, ties by key, with ``total``."""
    return page(found, sort_columns(F.col(sort), F.col(key), markup=sort == "title"), number, size)


# ---- the boolean language

def boolean_tokens(query: str) -> list[tuple[str, bool]]:
    """Q11: (text, can be a keyword); quoted strings have no escapes and are never keywords."""
    out, i = [], 0
    while i < len(query):
        c = query[i]
        if c in "():=":
            out.append((":" if c == "=" else c, True))
            i += 1
        elif c == '"':
            end = query.find('"', i + 1)
            if end < 0:
                raise InvalidQuery("a quotation mark is missing")
            out.append((query[i + 1 : end], False))
            i = end + 1
        elif c.isspace():
            i += 1
        else:
            end = next((k for k in range(i, len(query)) if query[k] in '():="' or query[k].isspace()), len(query))
            out.append((query[i:end], True))
            i = end
    return out


class _Boolean:
    """Q10: or < and (also by juxtaposition) < not < field:expression; the innermost field counts."""

    def __init__(self, query: str):
        self.words, self.at = boolean_tokens(query), 0

    def peek(self, *keywords: str) -> bool:
        if self.at >= len(self.words):
            return False
        text, free = self.words[self.at]
        return free and text in keywords

    def take(self, *keywords: str) -> bool:
        found = self.peek(*keywords)
        self.at += found
        return found

    def disjunction(self, field: str | None):
        parts = [self.conjunction(field)]
        while self.take("or", "OR"):
            parts.append(self.conjunction(field))
        return parts[0] if len(parts) == 1 else Op("or", tuple(parts))

    def conjunction(self, field: str | None):
        parts = [self.negation(field)]
        while self.at < len(self.words) and not self.peek("or", "OR", ")"):
            self.take("and", "AND")
            parts.append(self.negation(field))
        return parts[0] if len(parts) == 1 else Op("and", tuple(parts))

    def negation(self, field: str | None):
        if self.take("not", "NOT"):
            return Op("not", (self.negation(field),))
        return self.primary(field)

    def primary(self, field: str | None):
        if self.take("("):
            inner = self.disjunction(field)
            if not self.take(")"):
                raise InvalidQuery("a parenthesis is missing")
            return inner
        if self.at >= len(self.words) or self.peek(")", ":", "and", "AND", "or", "OR"):
            raise InvalidQuery("a term is missing")
        text, _ = self.words[self.at]
        self.at += 1
        if self.take(":"):
            return self.primary(text)
        return Term(fold_text(text), field)


def parse_boolean(query: str):
    parser = _Boolean(query)
    node = parser.disjunction(None)
    if parser.at < len(parser.words):
        raise InvalidQuery("more follows the end of the query")
    return node


def search_boolean(index: DataFrame, query: str, fields: list[str]) -> DataFrame:
    return index.where(condition(parse_boolean(query), {f: F.col(f) for f in fields}))


# ---- matches within a text

def occurrences(df: DataFrame, key: str, text: Column, term: str) -> DataFrame:
    """Q12: (key, start, length) of a term's occurrences from the left that don't overlap; starts from 0, in characters of the folded text.

    Only the lengths of the parts between them leave a row; one running sum over these gives all starts.
    """
    parts = F.split(text, r"\Q" + term.replace(r"\E", r"\E\\E\Q") + r"\E", -1)
    ends = df.where(text.contains(term)).select(F.col(key), F.monotonically_increasing_id().alias("row"), F.transform(parts, lambda p: F.length(p) + len(term)).alias("lengths"))
    listed = ends.select(key, "row", F.posexplode(F.slice("lengths", F.lit(1), F.size("lengths") - 1)).alias("at", "n"))
    start = F.sum("n").over(Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)) - len(term)
    return listed.select(key, start.cast("long").alias("start"), F.lit(len(term)).cast("long").alias("length"))


def display_matches(df: DataFrame, key: str, text: str, term: str) -> DataFrame:
    """Q13: (key, start, length) of a term's occurrences, as places in the text as it is displayed.

    The text is compared folded; a character that folding spells out is covered
    whole, and no match reaches back into what the one before it covers: what
    is left of it counts, if anything is.
    """
    wanted = "".join(map(fold_expansion, term))

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([covered(t or "", wanted) for t in texts])

    found = pandas_udf(run, "array<struct<start:bigint,length:bigint>>")(F.col(text))
    return df.select(F.col(key), F.explode(found).alias("m")).select(key, "m.start", "m.length")


def covered(display: str, term: str) -> list[dict]:
    """The places in ``display`` of a folded term's occurrences from the left."""
    whole, out, done = fold_expansion(display), [], 0  # characters of ``display`` before ``done`` are covered
    at = whole.find(term) if term else -1
    if len(whole) == len(display):  # every character stands for one
        while at >= 0:
            out.append({"start": at, "length": len(term)})
            at = whole.find(term, at + len(term))
        return out
    ends = list(itertools.accumulate(len(fold_expansion(c)) for c in display)) if at >= 0 else []
    while at >= 0:
        first = max(bisect_right(ends, at), done)
        after = bisect_left(ends, at + len(term)) + 1
        if after > first:
            out.append({"start": first, "length": after - first})
            done = after
        at = whole.find(term, at + len(term))
    return out


def fold_expansion(text: str) -> str:
    """The folded form of each character, marks kept; none depends on its neighbours."""
    return text.casefold().replace("œ", "oe").replace("æ", "ae").replace("đ", "d")
