"""What the catalogue knows of its holdings: who owns and edits what, in which languages, and statistics of these.

Names of the roles: a *document* lies in a *repository*; a *file* has *owners*,
who are known by git names; a *member* may have git names; a document has
arrays of languages, scripts and editors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- joins


def listed(df: DataFrame, *arrays: str) -> DataFrame:
    """A row for each combination of the arrays' elements; a row with an empty array goes."""
    for name in arrays:
        df = df.withColumn(name, F.explode(name))
    return df


def with_names(df: DataFrame, code: str, codes: DataFrame, names: DataFrame) -> DataFrame:
    """``df`` with id and name of its code, null where ``codes`` (code, id) or ``names`` (id, name) has none; both are lists of languages."""
    return df.join(codes.withColumnRenamed("code", code), code, "left").join(names, "id", "left")


def owned(documents: DataFrame, owners: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct (name, repo, ident): documents with what their owners are called: a member's id, else ``!`` and the git name.

    ``documents`` (name, repo), ``owners`` (name, git_name), ``members`` (git_name, member).
    """
    ident = F.coalesce(F.col("member").cast("string"), F.concat(F.lit("!"), "git_name"))
    return documents.join(owners, "name").join(members, "git_name", "left").select("name", "repo", ident.alias("ident")).distinct()


def owned_by(found: DataFrame, ident: str) -> DataFrame:
    """P10: the rows of ``owned`` that belong to one owner: ``!`` and a git name, or a member's id."""
    return found.where(F.col("ident") == ident)


# ---- statistics

def counted_list(df: DataFrame, key: str, item: str, name: str) -> DataFrame:
    """A2, A3: (key, name): ``item:n`` of each key, most frequent first, ties by item; each row counts once for its item."""
    counts = df.groupBy(key, item).agg(F.count("*").alias("n"))
    order = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(item).cast("string").alias("item"))))
    return counts.groupBy(key).agg(F.array_join(F.transform(order, lambda x: F.concat_ws(":", x["item"], -x["n"])), ",").alias(name))


def with_statistics(df: DataFrame, key: str, *statistics: DataFrame) -> DataFrame:
    """Every row of ``df`` with each statistic of its key, null where it has none; statistics are one row a key."""
    for s in statistics:
        df = df.join(s, key, "left")
    return df


def both_ways(df: DataFrame, a: str, b: str) -> DataFrame:
    """A10: (side, key, others): for each value of either column those of the other that occur with it, in order."""
    pairs = df.select(F.col(a).alias("x"), F.col(b).alias("y")).distinct()
    side = lambda name, key, other: pairs.groupBy(F.lit(name).alias("side"), F.col(key).alias("key")).agg(F.array_join(F.array_sort(F.collect_list(other)), ",").alias("others"))
    return side(a, "x", "y").unionByName(side(b, "y", "x"))


def last_commits(commits: DataFrame, file: str, at: str, commit: str, author: str) -> DataFrame:
    """(file, authors, last_commit, last_modified): authors in order of name, the newest commit; ties by its name."""
    newest = F.max(F.struct(F.col(at).alias("last_modified"), F.col(commit).alias("last_commit"))).alias("l")
    grouped = commits.groupBy(file).agg(F.array_join(F.array_sort(F.collect_set(author)), ",").alias("authors"), newest)
    return grouped.select(file, "authors", "l.last_commit", "l.last_modified")


# ---- changes of stored rows

def insert_new(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """K3, K6: ``old`` and the rows of ``new`` whose key it doesn't have; of rows of one key in ``new`` the first by all columns."""
    first = Window.partitionBy(*key).orderBy(*new.columns)
    fresh = new.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    return old.unionByName(fresh.join(old.select(*key), list(key), "left_anti").select(*old.columns))


def update_columns(old: DataFrame, new: DataFrame, key: str, *columns: str) -> DataFrame:
    """K4: ``old`` with ``columns`` taken from ``new`` where it has the key (its other columns stay), and the keys that only ``new`` has, whose other columns are null."""
    fresh = new.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_new"))
    joined = old.join(fresh, key, "full_outer")
    return joined.select(*[F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])


def backup(df: DataFrame, key: str, folder: str) -> None:
    """K9: the rows as lines of JSON in the order of their key, over the files of ``folder`` in turn."""
    lines = df.select(key, F.to_json(F.struct(*df.columns)).alias("value"))
    lines.repartitionByRange(key).sortWithinPartitions(key).select("value").write.mode("overwrite").text(folder)


# ---- values

def page_bounds(number: Column, total: Column, size: int) -> Column:
    """L3: (page, pages, first, last) of a page asked for: at least 1, at most the last; entries count from 1, none if there are none."""
    pages = F.greatest(F.ceil(total / size), F.lit(1)).cast("long")
    page = F.least(F.greatest(number.cast("long"), F.lit(1)), pages)
    return F.struct(page.alias("page"), pages.alias("pages"), F.least((page - 1) * size + 1, total).cast("long").alias("first"), F.least(page * size, total).cast("long").alias("last"))


def json_text(pairs: Column) -> Column:
    """a map as compact JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(pairs))))


def without(a: Column, b: Column) -> Column:
    """U4: what is in one array and not in the other, in order."""
    return F.array_sort(F.array_except(a, b))


def defaulted(array: Column, default: str) -> Column:
    """Q9: an array that is null or empty gets a default element."""
    return F.when(F.coalesce(F.size(array), F.lit(0)) > 0, array).otherwise(F.array(F.lit(default)))


#: Fixed value: what is done with a repository's files, in order.
STEPS = ("delete", "insert", "update")


def processing_order(changes: DataFrame, repo: str = "repo", action: str = "action", name: str = "name") -> DataFrame:
    """(repo, position, action, name): a repository's files as they are dealt with, deletions first, then new and changed ones, each by name; what is kept has no place."""
    step = F.array_position(F.array(*[F.lit(s) for s in STEPS]), F.col(action))
    position = F.row_number().over(Window.partitionBy(repo).orderBy(step, name)).cast("long")
    return changes.where(F.col(action).isin(*STEPS)).select(repo, position.alias("position"), action, name)
