"""I8: pages, lines and cells as places: every text of an edition is in exactly one of each.

Marks are points in a text.  Those of the edition itself count, not those in
notes, headings and running titles.  A page starts a line and a cell, a line
starts a cell; where a mark isn't followed by the one it needs before any text,
a phantom one starts there, and so do phantoms before all texts if an edition
doesn't begin with a page, a line and a cell.  One pass tells what is in the
edition; all else is running counts in document order, so levels reset each
other by where they start.

Defined results: blank texts separate no marks, and those that stand between
marks, or before the first, belong to the place that the last of these starts;
a mark without text before the next has an empty place; an edition without
texts and marks has no places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.operators.tours import carried_down
from glyphmill.operators.trees import attribute

#: Elements that mark places, by unit; a mark of columns or of pages; elements whose marks and texts aren't the edition's.
PAGE, LINE, CELL = "page", "line", "cell"
OUTSIDE = ("note", "head", "fw", "label")
UNITS = (PAGE, LINE, CELL)


def _unit() -> Column:
    page_like = (F.col("name") == "milestone") & (attribute("type") == "pagelike")
    return F.when((F.col("name") == "pb") | page_like, PAGE).when(F.col("name") == "lb", LINE).when(F.col("name") == "milestone", CELL)


def events(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, unit, n, data): marks (unit, n) and texts (data) of editions."""
    begins = (F.col("name") == "div") & (attribute("type") == "edition")
    place = F.when(F.col("name").isin(*OUTSIDE), "out").when(begins, "in")
    rows = nodes.where("kind in ('tag', 'tree', 'string')").select("doc_id", "pre", "level", "kind", "data", _unit().alias("unit"), attribute("n").alias("n"), place.alias("place"))
    step = lambda above, own: "out" if above == "out" else own or above
    return carried_down(rows, "place", step).where("place = 'in' and (unit is not null or kind = 'string')").select("doc_id", "pre", "unit", "n", "data")


def _together(found: DataFrame) -> DataFrame:
    """``found`` with ``texts``, the number of texts so far that aren't blank: rows of one number are marks that no text separates, and what is around them."""
    spoken = F.coalesce(F.col("data").rlike(r"(?U)\S"), F.lit(False)).cast("int")
    return found.withColumn("texts", F.sum(spoken).over(Window.partitionBy("doc_id").orderBy("pre")))


def starts(found: DataFrame) -> DataFrame:
    """(doc_id, pre, sub, unit, n, phantom) of all places, in order of pre and sub."""
    marks = _together(found).where("unit is not null")
    together = Window.partitionBy("doc_id", "texts").orderBy("pre")  # marks that no text separates
    marks = marks.withColumn("next", F.lead("unit").over(together))
    at = lambda sub, unit, n, phantom: F.struct(F.lit(sub).alias("sub"), F.lit(unit).alias("unit"), n.cast("string").alias("n"), F.lit(phantom).alias("phantom"))
    none = F.lit(None)
    needed = lambda unit: ~F.col("next").eqNullSafe(unit)
    own = F.struct(F.lit(0).alias("sub"), F.col("unit").alias("unit"), F.col("n").cast("string").alias("n"), F.lit(False).alias("phantom"))
    line = F.when((F.col("unit") == PAGE) & needed(LINE), at(1, LINE, none, True))
    cell = F.when((F.col("unit") == LINE) & needed(CELL) | (F.col("unit") == PAGE) & needed(LINE) & needed(CELL), at(2, CELL, none, True))
    given = marks.select("doc_id", "pre", F.explode(F.array_compact(F.array(own, line, cell))).alias("s"))
    # What an edition begins with, before any text.
    first = found.groupBy("doc_id").agg(F.lit(1).alias("one")).join(marks.where("texts = 0").groupBy("doc_id").agg(F.min_by("unit", "pre").alias("first")), "doc_id", "left")
    lacking = F.array_compact(F.array(
        F.when(~F.col("first").eqNullSafe(PAGE), at(0, PAGE, none, True)),
        F.when(F.col("first").isNull() | (F.col("first") == CELL), at(1, LINE, none, True)),
        F.when(F.col("first").isNull(), at(2, CELL, none, True)),
    ))
    phantoms = first.select("doc_id", F.lit(-1).alias("pre"), F.explode(lacking).alias("s"))
    return given.unionByName(phantoms).select("doc_id", "pre", "s.*")


def placed(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, page, line, cell, page_n, line_n, cell_n, start, data): each text with the numbers of its places, counted from 1 in its edition, their labels, and where it starts in the edition's text."""
    found = events(nodes)
    none = lambda kind: F.lit(None).cast(kind)
    points = starts(found).withColumn("data", none("string"))
    group = Window.partitionBy("doc_id", "texts")
    marked = _together(found).withColumn("marks", F.count("unit").over(group.orderBy("pre"))).withColumn("last", F.max(F.when(F.col("unit").isNotNull(), F.col("pre"))).over(group))
    after = ~F.col("data").rlike(r"(?U)\S") & ((F.col("marks") > 0) | (F.col("texts") == 0))
    at = F.when(after, F.coalesce("last", "pre")).otherwise(F.col("pre"))
    texts = marked.where("unit is null").select("doc_id", "pre", at.alias("at"), F.lit(3).alias("sub"), none("string").alias("unit"), none("string").alias("n"), F.lit(False).alias("phantom"), "data")
    so_far = Window.partitionBy("doc_id").orderBy("at", "sub", "pre")
    rows = points.withColumn("at", F.col("pre")).unionByName(texts)
    for unit in UNITS:
        own = F.col("unit") == unit
        rows = rows.withColumn(unit, F.sum(F.coalesce(own, F.lit(False)).cast("long")).over(so_far)).withColumn(f"{unit}_n", F.last(F.when(own, F.coalesce("n", F.lit(""))), ignorenulls=True).over(so_far))
    start = F.sum(F.coalesce(F.length("data"), F.lit(0))).over(so_far) - F.coalesce(F.length("data"), F.lit(0))
    return rows.withColumn("start", start)


def text_places(nodes: DataFrame) -> DataFrame:
    """The rows of ``placed`` that are texts; labels are empty where a place has none."""
    return placed(nodes).where("unit is null").drop("at", "sub", "unit", "n", "phantom")


def cells(nodes: DataFrame) -> DataFrame:
    """(doc_id, page, line, cell, page_n, line_n, cell_n, phantom, start, stop, text): every cell with its interval of the edition's text."""
    rows = placed(nodes)
    # A cell's page and line are those at its start; its rows go on to the marks that start the next one.
    at_start = lambda c: F.max(F.when(F.col("unit") == CELL, F.col(c)))
    pieces = F.sort_array(F.collect_list(F.when(F.col("data").isNotNull(), F.struct("pre", "data"))))
    grouped = rows.where("cell > 0").groupBy("doc_id", "cell").agg(
        *[at_start(c).alias(c) for c in ("page", "line", "phantom", *(f"{u}_n" for u in UNITS))],
        F.min(F.when(F.col("unit") == CELL, F.col("start"))).alias("start"), F.array_join(pieces["data"], "").alias("text"),
    )
    return grouped.withColumn("stop", F.col("start") + F.length("text"))
