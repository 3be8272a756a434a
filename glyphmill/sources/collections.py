"""Readers of collected material: S21 and S22 dictionaries, S23 reports, S24 cards of spreadsheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions.text import glob, normalize_space
from glyphmill.operators.nodes import texts


def dictionary_pages(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(dictionary, page, html) of lines with three cells, by a GLOB of the dictionary, in page order; other lines are an error."""
    cells = F.split("value", "\t", -1)
    three = F.when(F.size(cells) == 3, cells).otherwise(F.raise_error(F.concat(F.lit("not three cells: "), F.left("value", F.lit(80)))))
    rows = spark.read.text(path).where("value <> ''").select(three.alias("c")).select(F.get("c", F.lit(0)).alias("dictionary"), F.get("c", F.lit(1)).cast("int").alias("page"), F.get("c", F.lit(2)).alias("html"))
    return rows.where(glob(F.col("dictionary"), pattern)).orderBy("dictionary", "page")


def dictionary_entries(pages: DataFrame, mark: str = "hw") -> DataFrame:
    """(dictionary, page, n, head, entry): a page cut where an element for a head word begins."""
    parts = pages.select("dictionary", "page", F.posexplode(F.split("html", f"(?i)(?=<{mark}[ >])")).alias("n", "entry")).where(F.col("entry").rlike(f"(?i)^<{mark}[ >]"))
    head = normalize_space(F.regexp_replace(F.regexp_extract("entry", f"(?is)^<{mark}[^>]*>(.*?)</{mark}>", 1), "<[^>]*>", ""))
    return parts.select("dictionary", "page", "n", head.alias("head"), "entry")


def report_entries(nodes: DataFrame, item: str = "INSCRIPTION") -> DataFrame:
    """(doc_id, pre, ref, n, heading, page, text): items with what last stood before them: report, heading and page."""
    order = Window.partitionBy("doc_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    carry = lambda name, value: F.last(F.when(F.col("name") == name, value), ignorenulls=True).over(order)
    attribute = lambda n: F.try_element_at("attrs", F.lit(n))
    text = texts(nodes)
    tags = nodes.where("kind = 'tag'").join(text, ["doc_id", "pre"])
    carried = tags.select("doc_id", "pre", "name", "text", carry("arie", attribute("ref")).alias("ref"), carry("arie", attribute("n")).alias("n"), carry("H2", normalize_space(F.col("text"))).alias("heading"), carry("pb", attribute("n")).alias("page"))
    return carried.where(F.col("name") == item).select("doc_id", "pre", "ref", "n", "heading", "page", normalize_space(F.col("text")).alias("text"))


def spreadsheet_rows(nodes: DataFrame) -> DataFrame:
    """(doc_id, sheet, row, cells): the rows of a flat spreadsheet; a cell repeats as often as its attribute says; empty ones at a row's end go."""
    text = texts(nodes)
    tags = nodes.where("name in ('table', 'table-row', 'table-cell')").join(text, ["doc_id", "pre"])
    order = Window.partitionBy("doc_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda name: F.last(F.when(F.col("name") == name, F.col("pre")), ignorenulls=True).over(order)
    placed = tags.select("doc_id", "pre", "name", "attrs", "text", last("table").alias("sheet"), last("table-row").alias("row"))
    times = F.coalesce(F.try_element_at("attrs", F.lit("number-columns-repeated")).cast("int"), F.lit(1))
    cells = placed.where("name = 'table-cell'").select("doc_id", "sheet", "row", "pre", normalize_space(F.col("text")).alias("t"), times.alias("times"))
    listed = cells.groupBy("doc_id", "sheet", "row").agg(F.sort_array(F.collect_list(F.struct("pre", "t", "times"))).alias("l"))
    # Sheets say that thousands of empty cells follow the last filled one.
    listed = listed.withColumn("l", F.filter("l", lambda x, i: F.exists(F.slice("l", i + 1, F.size("l")), lambda y: y["t"] != "")))
    return listed.select("doc_id", "sheet", "row", F.flatten(F.transform("l", lambda x: F.array_repeat(x["t"], x["times"]))).alias("cells"))


def spreadsheet_cards(rows: DataFrame) -> DataFrame:
    """(doc_id, row, html): each row below a sheet's first as a card of the first row's names and its own values."""
    from glyphmill.functions.text import quote_xml

    header = rows.groupBy("doc_id", "sheet").agg(F.min(F.struct("row", "cells")).alias("h"))
    body = rows.join(header, ["doc_id", "sheet"]).where(F.col("row") > F.col("h.row"))
    pairs = F.filter(F.arrays_zip(F.col("h.cells").alias("k"), F.col("cells").alias("v")), lambda p: F.coalesce(p["v"], F.lit("")) != "")
    lines = F.transform(pairs, lambda p: F.concat(F.lit("<dt>"), quote_xml(F.coalesce(p["k"], F.lit(""))), F.lit("</dt><dd>"), quote_xml(p["v"]), F.lit("</dd>")))
    return body.select("doc_id", "row", F.concat(F.lit("<dl>"), F.array_join(lines, ""), F.lit("</dl>")).alias("html"))
