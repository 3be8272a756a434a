"""Relational operators that Spark has no single name for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def production(df: DataFrame, *keys: str | Column, name: str = "prod") -> DataFrame:
    """A1, A2: how many rows each key has."""
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def ordered_counts(df: DataFrame, key: str, item: str, n: str, name: str) -> DataFrame:
    """A3: ``item:n`` of each key, most frequent first, joined by commas; ties by item."""
    listed = F.sort_array(F.collect_list(F.struct((-F.col(n)).alias("n"), F.col(item).alias("item"))))
    return df.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["item"], -x["n"])), ",").alias(name))


def closure(df: DataFrame, node: str = "rid", parent: str = "parent", guard: int = 90) -> DataFrame:
    """(rid, root, depth) of every node and each of its ancestors, then of a null root past the top.

    Recursive SQL; ``guard`` bounds its depth, so a cycle ends the query with an error.
    """
    named = df.select(F.col(node).alias("rid"), F.col(parent).alias("parent"))
    return df.sparkSession.sql(
        f"""
        with recursive up(rid, root, depth) max recursion level {guard} as (
          select rid, rid, 0 from {{nodes}}
          union all
          select up.rid, n.parent, up.depth + 1 from up join {{nodes}} n on up.root = n.rid)
        select rid, root, depth from up""",
        nodes=named,
    )


def below(df: DataFrame, closed: DataFrame, root: Column | int, node: str = "rid") -> DataFrame:
    """The rows whose node lies in a root's subtree."""
    return df.join(closed.where(F.col("root") == root).select(F.col("rid").alias(node)), node, "left_semi")


def first_match(keys: DataFrame, key: str, table: DataFrame, by: list[str], value: str) -> DataFrame:
    """For each key the value of the row that has it in the first of the columns ``by``, smallest value first."""
    ranked = [table.select(F.col(c).cast("string").alias(key), F.lit(k).alias("rank"), F.col(value).alias("value")) for k, c in enumerate(by)]
    every = ranked[0]
    for more in ranked[1:]:
        every = every.unionByName(more)
    best = every.groupBy(key).agg(F.min(F.struct("rank", "value"))["value"].alias(value))
    return keys.join(best, key, "left")


def positions(df: DataFrame, bucket: Column, order: list[str], name: str = "pos") -> DataFrame:
    """Every row's place from 0 in a total order, without bringing all rows to one task.

    ``bucket`` must not fall as the order rises; rows are ranked within their
    bucket, and a running sum over the bucket sizes gives each bucket's base.
    """
    keyed = df.withColumn("_bucket", bucket)
    sizes = keyed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    running = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_bucket", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return keyed.withColumn("_rank", rank).join(bases, "_bucket").withColumn(name, F.col("_base") + F.col("_rank") - 1).drop("_bucket", "_rank", "_base")


def range_bucket(df: DataFrame, column: str, rows: int = 1_000_000) -> Column:
    """A bucket for ``positions``: numbers in the order of a numeric column, about ``rows`` rows each; equal values share one."""
    parts = -(-df.count() // rows)
    if parts <= 1:
        return F.lit(0)
    steps = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    bounds = df.agg(F.percentile_approx(column, steps, 10 * parts)).first()[0] or []  # a value for each bucket
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(column)))


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """L1, L2: a page of rows in a total order, each with the number of all rows as ``total``."""
    total = df.agg(F.count("*").alias("total"))  # one row
    return df.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))


def runs(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """(group, segment, value, n) of runs of equal values in order."""
    w = Window.partitionBy(group).orderBy(order)
    changed = (~F.lag(value).over(w).eqNullSafe(F.col(value))).cast("int")
    marked = df.select(group, order, value, F.coalesce(F.when(F.row_number().over(w) == 1, 1).otherwise(changed), F.lit(1)).alias("_new"))
    segmented = marked.withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return segmented.groupBy(group, "segment", value).agg(F.count("*").alias("n"))


def carried(df: DataFrame, group: str, order: str, value: Column, name: str) -> DataFrame:
    """The last value that isn't null, up to each row."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


# ---- changes

def change_classes(before: DataFrame, now: DataFrame, key: str, stamp: str) -> DataFrame:
    """(key, action): insert, delete, update (a later stamp) or keep."""
    a, b = before.select(F.col(key), F.col(stamp).alias("_old")), now.select(F.col(key), F.col(stamp).alias("_new"))
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(F.col("_new") > F.col("_old"), "update").otherwise("keep")
    return a.join(b, key, "full_outer").select(key, action.alias("action"))


def latest(df: DataFrame, key: str, version: str, *columns: str) -> DataFrame:
    """B1, B2: of each key the row with the highest version."""
    return df.groupBy(key).agg(F.max(F.struct(version, *columns)).alias("_r")).select(key, "_r.*")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """K1: the old rows whose key has no new row, and the new ones."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


# ---- constraints

def violations(rules: dict[str, DataFrame]) -> DataFrame:
    """(rule, violations) with a row for each rule."""
    counted = [df.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations") for rule, df in rules.items()]
    out = counted[0]
    for more in counted[1:]:
        out = out.unionByName(more)
    return out


def type_rules(df: DataFrame, **checks: str) -> dict[str, DataFrame]:
    """Rows that break the checks of a table with loosely typed columns (strings), by ``column check``.

    Checks: ``integer``, ``boolean`` (0 or 1), ``json``, ``json array`` or
    ``json object``, ``length N``, ``length M N``, ``one of a b c``.  Nulls break none.
    """
    out = {}
    for column, check in checks.items():
        c, (kind, *args) = F.col(column).cast("string"), check.split()
        variant = F.expr(f"try_parse_json(cast(`{column}` as string))")
        fit = {
            "integer": lambda: c.rlike(r"\A[+-]?[0-9]+\z"), "boolean": lambda: c.isin("0", "1"), "json": lambda: F.schema_of_variant(variant).like({"array": "ARRAY<%", "object": "OBJECT<%"}.get(args[0] if args else "", "%")),
            "length": lambda: F.length(c).between(int(args[0]), int(args[-1])), "one": lambda: c.isin(*args[1:]),
        }[kind]()
        out[f"{column} {check}"] = df.where(c.isNotNull() & ~F.coalesce(fit, F.lit(False)))
    return out


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that several rows have, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).join(parent, df[key] == parent[parent_key], "left_anti")
