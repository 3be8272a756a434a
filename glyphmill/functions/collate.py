"""O1, O2: order of names as in a dictionary, punctuation ignored, nulls and empty lists last."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sort_columns(c: Column, *ties: Column, markup: bool = False) -> list[Column]:
    """Sort by text under Unicode's collation without punctuation and space; then by the text itself and ``ties``."""
    text = F.regexp_replace(c, "<[^>]*>", "") if markup else c
    empty = c.isNull() | (c == "[]")
    key = F.collate(F.regexp_replace(text, r"[\p{P}\s]", ""), "UNICODE")
    return [empty.asc(), F.when(~empty, key).asc(), text.asc(), *(t.asc() for t in ties)]
