"""Addresses, files and dates: F3, F6, F22, F29, F32, F33."""

from __future__ import annotations

from urllib.parse import urljoin

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions.text import Batched

#: What the form encoding writes otherwise than an address's path does.
PATH_SPELLINGS = (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/"), ("%3A", ":"))


def format_url(template: str, *args: Column) -> Column:
    """``printf`` with the arguments, then percent signs for all but letters, digits, ``-._~``, ``/`` and ``:``."""
    out = F.url_encode(F.printf(F.lit(template), *args) if args else F.lit(template))
    for form, path in PATH_SPELLINGS:
        out = F.replace(out, F.lit(form), F.lit(path))
    return out


def count_of(n: Column, unit: str) -> Column:
    """``1 line``, ``2 lines``; regular plurals."""
    irregular = unit[:-1] + "ies" if unit.endswith("y") and unit[-2:-1] not in "aeiou" else unit + ("es" if unit.endswith(("s", "x", "ch", "sh")) else "s")
    return F.concat_ws(" ", n, F.when(n == 1, unit).otherwise(irregular))


def format_date(seconds: Column, pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    """seconds since 1970 in the session's zone."""
    return F.date_format(F.timestamp_seconds(seconds), pattern)


def format_commit(commit: Column) -> Column:
    """F22."""
    return F.substring(commit, 1, 7)


def page_of(url: Column) -> Column:
    """the number in ``page=``; null if there is none or it is too long for a bigint."""
    return F.regexp_extract(url, r"[?&]page=(\d+)", 1).try_cast("bigint")


def dictionary_of(url: Column) -> Column:
    """the folder below ``dictionaries``."""
    return F.nullif(F.regexp_extract(url, r"/dictionaries/([^/?#]+)", 1), F.lit(""))


def base_name(path: Column) -> Column:
    """a file's name without folders (of either kind) and its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def absolute_links(base: str):
    """F32: a Column function that resolves ``href`` and ``src`` against an address."""
    import re

    attribute = re.compile(r"""(\b(?:href|src)\s*=\s*)(["'])(.*?)\2""", re.I | re.S)
    return Batched(lambda s: None if s is None else attribute.sub(lambda m: f"{m[1]}{m[2]}{urljoin(base, m[3])}{m[2]}", s))
