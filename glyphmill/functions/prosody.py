"""metrical patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs of patterns and how they are shown.
SIGNS, SHOWN = "-+=2", "⏑–⏓⏖"
DANDA, DOUBLE_DANDA = "।", "॥"


def is_pattern(c: Column) -> Column:
    return c.rlike(r"^[-+=0-9|/।॥]+$")


def render_pattern(c: Column) -> Column:
    """The pattern with its signs; numbers of several digits stay as they are."""
    parts = F.regexp_extract_all(c, F.lit(r"(\|\||[0-9]{2,}|(?s:.))"), F.lit(1))
    shown = F.transform(parts, lambda p: F.when(F.length(p) > 1, p).otherwise(F.replace(F.replace(F.translate(p, SIGNS, SHOWN), F.lit(DOUBLE_DANDA), F.lit("||")), F.lit(DANDA), F.lit("|"))))
    return F.array_join(shown, "")
