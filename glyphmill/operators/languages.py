"""Tables of languages and scripts, each a hierarchy.

S8 languages merged from two standards and a project's own list, S11 scripts
with a leaf for what is in no narrower script.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.operators.nodes import texts

#: The top of the hierarchy (id, name, parent).
ROOTS = [("lang", "Any Language", None), ("source", "Source Language", "lang"), ("study", "Study Language", "lang"), ("source_other", "Source Language (other)", "source"), ("study_other", "Study Language (other)", "study")]


def languages(iso3: DataFrame, names: DataFrame, iso5: DataFrame, project: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rid, id, name, inverted_name, iso, custom, project, parent) and (code, id).

    ``project`` renames languages, adds its own and chooses their branch; a
    language is custom if the project named it.  Roots come first, then both
    standards, then additions, each in the order of ids.
    """
    spark = iso3.sparkSession
    given = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    roots = spark.createDataFrame([(0, i, n, n, None, p) for i, n, p in ROOTS], "rank int, id string, name string, inverted_name string, iso int, branch string")
    inverted = names.join(iso3.select("Id", F.col("Ref_Name").alias("Print_Name")), ["Id", "Print_Name"]).groupBy("Id").agg(F.min("Inverted_Name").alias("inv"))
    third = iso3.join(inverted, "Id", "left").select(F.lit(1).alias("rank"), F.col("Id").alias("id"), F.col("Ref_Name").alias("name"), F.coalesce("inv", "Ref_Name").alias("inverted_name"), F.lit(3).alias("iso"), F.lit("source").alias("branch"))
    code, label = iso5.columns[:2]
    fifth = iso5.select(F.lit(2).alias("rank"), F.col(code).alias("id"), F.col(label).alias("name"), F.col(label).alias("inverted_name"), F.lit(5).alias("iso"), F.lit("source").alias("branch"))
    standard = roots.unionByName(third).unionByName(fifth)
    own = project.select(F.col("Id").alias("id"), given("Print_Name").alias("p_name"), given("Inverted_Name").alias("p_inverted"), F.coalesce(given("type"), F.lit("source")).alias("p_branch"), F.lit(True).alias("p"))
    merged = standard.join(own, "id", "full_outer")
    renamed = (F.col("p_name") != F.col("name")) | (F.col("p_inverted") != F.col("inverted_name"))
    rows = merged.select(
        F.coalesce("rank", F.lit(3)).alias("rank"), "id", F.coalesce("p_name", "name").alias("name"), F.coalesce("p_inverted", "inverted_name", "p_name").alias("inverted_name"), "iso",
        (F.col("rank").isNull() | (F.col("rank") == 0) | F.coalesce(renamed, F.lit(False))).alias("custom"), (F.col("p").isNotNull() | (F.coalesce("rank", F.lit(3)) == 0)).alias("project"), F.coalesce("p_branch", "branch").alias("branch"),
    )
    # The table is a dimension of some ten thousand rows, numbered in one place.
    order = F.when(F.col("rank") == 0, F.array_position(F.array(*[F.lit(i) for i, _, _ in ROOTS]), F.col("id"))).otherwise(0)
    numbered = rows.withColumn("rid", F.row_number().over(Window.orderBy("rank", order, "id")))
    above = numbered.select(F.col("id").alias("branch"), F.col("rid").alias("parent"))
    listed = numbered.join(above, "branch", "left").select("rid", "id", "name", "inverted_name", "iso", "custom", "project", "parent")
    other = iso3.select(F.explode(F.array("Id", "Part2b", "Part2t", "Part1")).alias("code"), F.col("Id").alias("id")).where("code <> ''")
    codes = other.unionByName(listed.select(F.col("id").alias("code"), "id")).distinct()
    return listed, codes


def scripts(nodes: DataFrame) -> DataFrame:
    """(rid, id, ids, name, inverted_name, parent) from the nodes of a nested list of scripts, numbered from the top down."""
    tags = nodes.where("kind = 'tag'")
    own = tags.where("name = 'script'").select("doc_id", "pre", "post", "level", "parent_pre")
    text = texts(nodes)
    parts = tags.where("name in ('id', 'name', 'inverted_name')").join(text, ["doc_id", "pre"]).where("trim(text) <> ''").select("doc_id", F.col("parent_pre").alias("pre"), F.col("name").alias("part"), F.col("pre").alias("at"), F.trim("text").alias("t"))
    first = lambda part: F.min(F.when(F.col("part") == part, F.struct("at", "t")))["t"]
    ids = F.transform(F.sort_array(F.collect_list(F.when(F.col("part") == "id", F.struct("at", "t")))), lambda x: x["t"])
    named = parts.groupBy("doc_id", "pre").agg(F.array_distinct(ids).alias("ids"), first("name").alias("name"), first("inverted_name").alias("inverted_name"))
    full = own.join(named, ["doc_id", "pre"]).withColumn("id", F.get("ids", F.lit(0))).withColumn("name", F.coalesce("name", "id")).withColumn("inverted_name", F.coalesce("inverted_name", "name"))
    last = own.alias("a").join(own.alias("b"), (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("b.pre") > F.col("a.pre")) & (F.col("b.post") < F.col("a.post"))).groupBy(F.col("a.doc_id").alias("doc_id"), F.col("a.pre").alias("pre")).agg(F.max("b.pre").alias("last"))
    rest = full.join(last, ["doc_id", "pre"]).select("doc_id", F.col("last").alias("at"), F.lit(1).alias("after"), F.col("level"), F.col("pre").alias("up"), F.transform("ids", lambda x: F.concat(x, F.lit("_other"))).alias("ids"), F.concat("name", F.lit(" (other)")).alias("name"), F.concat("inverted_name", F.lit(" (other)")).alias("inverted_name"), F.lit(None).cast("int").alias("pre"))
    every = full.select("doc_id", F.col("pre").alias("at"), F.lit(0).alias("after"), "level", F.col("parent_pre").alias("up"), "ids", "name", "inverted_name", "pre").unionByName(rest)
    numbered = every.withColumn("rid", F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "after", F.desc("level"))))
    above = numbered.where("pre is not null").select("doc_id", F.col("pre").alias("up"), F.col("rid").alias("parent"))
    return numbered.join(above, ["doc_id", "up"], "left").select("rid", F.get("ids", F.lit(0)).alias("id"), "ids", "name", "inverted_name", "parent")
