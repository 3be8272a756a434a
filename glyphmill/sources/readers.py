"""Readers for the formats of an edition's repository.

S1-S3 edition files, S4-S7 tables with tabs, S10 members, S11 scripts, S26
ranges of Unicode data.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def edition_files(spark: SparkSession, root: str, prefixes: tuple[str, ...]) -> DataFrame:
    """(path, name, modificationTime, length, content) of XML files below a folder whose names begin with a prefix; hidden ones and templates don't count."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[xX][mM][lL]").load(root)
    name = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    shown = ~F.col("path").rlike(r"/\.[^/]") & ~F.lower(name).contains("template") & name.rlike("^(" + "|".join(prefixes) + ")")
    return files.withColumn("name", name).where(shown)


def decoded(df: DataFrame, content: str = "content") -> DataFrame:
    """``text``, in NFC; null if the bytes are no UTF-8."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(text=[_decode(x) for x in frame[content]])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{kinds}, text string")


def _decode(data: bytes | None) -> str | None:
    try:
        return None if data is None else unicodedata.normalize("NFC", bytes(data).decode("utf-8-sig"))
    except UnicodeDecodeError:
        return None


def tab_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows under a header line; cells are trimmed and short rows filled up; a long row is an error."""
    cells = F.split("value", "\t", -1)
    lines = spark.read.text(path, lineSep="\n").where("trim(value) <> ''").withColumn("value", F.rtrim(F.regexp_replace("value", "\r$", "")))
    checked = F.when(F.size(cells) > len(columns), F.raise_error(F.concat(F.lit("too many cells: "), "value"))).otherwise(cells)
    rows = lines.select(checked.alias("c")).select(*[F.trim(F.coalesce(F.get("c", F.lit(k)), F.lit(""))).alias(n) for k, n in enumerate(columns)])
    header = F.lit(True)
    for n in columns:
        header = header & (F.col(n) == n)
    return rows.where(~header)


def unique(df: DataFrame, *keys: str) -> DataFrame:
    """The rows; an error if two have one key."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    doubled = n.select(F.concat_ws(", ", *keys).alias("k")).limit(3).collect()
    if doubled:
        raise ValueError("duplicate keys: " + "; ".join(r["k"] for r in doubled))
    return df


def repositories(spark: SparkSession, path: str) -> DataFrame:
    """S5."""
    rows = tab_table(spark, path, ["name", "textual", "title"])
    textual = F.when(F.col("textual").isin("true", "false"), F.col("textual") == "true").otherwise(F.raise_error(F.concat(F.lit("neither true nor false: "), "textual")))
    return unique(rows.select("name", textual.cast("boolean").alias("textual"), "title"), "name")


def git_names(spark: SparkSession, path: str) -> DataFrame:
    """S6."""
    return unique(tab_table(spark, path, ["git_name", "dh_id"]), "git_name")


def symbols(spark: SparkSession, path: str) -> DataFrame:
    """A row for each name; an empty text is null, and is searched as itself where nothing else is given."""
    rows = tab_table(spark, path, ["names", "text", "description", "search"])
    text = F.nullif("text", F.lit(""))
    each = rows.select(F.explode(F.array_distinct(F.split(F.trim("names"), r"\s+"))).alias("name"), text.alias("text"), F.coalesce(F.nullif("description", F.lit("")), F.lit("symbol")).alias("description"), F.coalesce(F.nullif("search", F.lit("")), text).alias("search"))
    return unique(each, "name")


# Registers that members have numbers in.
REGISTERS = ("idhal", "idref", "orcid", "viaf", "wikidata")


def members(nodes: DataFrame) -> DataFrame:
    """(id, name array, affiliation, a column for each of REGISTERS, print_name, inverted_name) from the nodes of a list of members; numbers are the last parts of addresses."""
    from glyphmill.operators.nodes import texts
    from glyphmill.operators.trees import nearest_above

    part = F.when(F.col("name") == "idno", F.lower(F.try_element_at("attrs", F.lit("type")))).otherwise(F.col("name"))
    tags = nodes.where("kind in ('tag', 'tree')").select("doc_id", "pre", "level", "name", part.alias("part"), F.when(F.col("name") == "person", F.try_element_at("attrs", F.lit("xml:id"))).alias("own"))
    within = nearest_above(tags, F.col("own"), "id")
    parts = within.where("name in ('name', 'forename', 'surname', 'affiliation', 'idno') and id is not null").select("doc_id", "pre", "id", "part")
    inside = parts.join(texts(nodes), ["doc_id", "pre"]).withColumnRenamed("pre", "p")
    named = inside.groupBy("id").agg(F.sort_array(F.collect_list(F.when(F.col("part").isin("name", "forename", "surname"), F.struct("p", F.trim("text").alias("t"))))).alias("n"), F.max(F.when(F.col("part") == "affiliation", F.trim("text"))).alias("affiliation"), *[F.max(F.when(F.col("part") == r, F.element_at(F.split(F.trim("text"), "/"), -1))).alias(r) for r in REGISTERS])
    return named.select(F.element_at(F.split("id", "/"), -1).alias("id"), F.transform("n", lambda x: x["t"]).alias("name"), "affiliation", *REGISTERS).withColumns(names("name"))


def names(column: str) -> dict:
    """A name of one or two parts as it is printed and sorted."""
    first, last = F.get(column, F.lit(0)), F.get(column, F.lit(1))
    return {"print_name": F.concat_ws(" ", first, last), "inverted_name": F.when(last.isNull(), first).otherwise(F.concat_ws(", ", last, first))}


def unicode_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(first, last, name) of ``start..end; name`` lines."""
    row = r"^([0-9A-Fa-f]+)\.\.([0-9A-Fa-f]+)\s*;\s*([^#]*?)\s*(?:#.*)?$"
    lines = spark.read.text(path).where(F.col("value").rlike(row))
    code = lambda k: F.conv(F.regexp_extract("value", row, k), 16, 10).cast("int")
    return lines.select(code(1).alias("first"), code(2).alias("last"), F.regexp_extract("value", row, 3).alias("name"))
