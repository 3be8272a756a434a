"""Connected components by alternating stars, without collecting links anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import join_groups, kept_from, map_arrow, materialise

#: Links that a task makes a forest of, about.
FOREST_LINKS = 1 << 16
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node in ``links`` (a, b); a component is named by its smallest node.

    Each round makes stars of what each task reads, then points every node's
    smaller neighbours (in every other round its larger ones) to its smallest
    neighbour, until all links together are stars.  Minima are aggregated before the shuffle, and
    the links of nodes with very many meet the minimum where they are, so no node
    makes a large group.  Links from a node to itself and null nodes are
    ignored.  The rounds' folders are deleted at the end.
    """
    return kept_from(links.sparkSession, lambda: _stars(links))[0]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes, each node with the smallest it hangs together with."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))  # a and b are roots
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def _forests(links: DataFrame, count: int) -> DataFrame:
    """Fewer links that join the same nodes: a forest for each FOREST_LINKS of ``count``, which few tasks read where there are few."""
    most = FOREST_LINKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def grown() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in forest(table["a"].to_numpy(), table["b"].to_numpy())], schema=_LINKS)

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= most:
                yield grown()
                held, size = [], 0
        if size:
            yield grown()

    return map_arrow(links.select("a", "b").coalesce(max(1, -(-count // most))), run, "a long, b long")


def _stars(links: DataFrame) -> DataFrame:
    links = materialise(links.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct())
    count, upwards = links.count(), True
    while True:
        links = materialise(_forests(links, count))
        ends = links.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        state = ends.agg(F.sum("up").alias("n"), F.max(F.col("up") + F.least("down", F.lit(1))).alias("kinds"), F.max("up").alias("up"), F.max(F.col("up") + F.col("down")).alias("most")).first()
        if (state["kinds"] or 0) < 2:  # every node has one link to a smaller one, or only links from larger ones
            roots = links.groupBy("b").agg(F.lit(1)).select(F.col("b").alias("node"), F.col("b").alias("component"))
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
        count = state["n"]
        if upwards:  # a node's smaller neighbours, and at the smallest the node itself
            least = links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
            moved = join_groups(links, least, ["a"], count, most=state["up"]).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        else:  # its larger neighbours
            both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
            moved = join_groups(both.where("b > a"), least, ["a"], 2 * count, most=state["most"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        links, upwards = materialise(moved), not upwards
