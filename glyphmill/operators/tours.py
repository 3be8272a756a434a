"""Passes over trees in document order with a stack of what is open.

Rows are dealt by document and put in order of ``pre``; a pass holds the open
nodes of one document, as many as the tree is deep, so neither a large document
nor a deep one needs more rounds or memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def in_order(rows: DataFrame) -> DataFrame:
    """``rows`` with each document whole and in order within one part."""
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "pre")


def carried_down(rows: DataFrame, name: str, step: Callable[[object, object], object], shown: Callable[[object], object] | None = None, kind: str | None = None) -> DataFrame:
    """``rows`` (doc_id, pre, level, ...) in which the column ``name`` becomes step(the parent's new value, its own); a root's parent has None.

    ``shown`` of a value, of the type ``kind`` (DDL), goes into the column, if values are not of its own type.
    """
    kinds = StructType([StructField(f.name, rows.sparkSession.createDataFrame([], f"x {kind}").schema[0].dataType) if kind and f.name == name else f for f in rows.schema])
    made = rows.sparkSession.createDataFrame([], kinds).limit(0).toArrow().schema.field(name) if kind else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_levels: list[tuple[int, object]] = []
        doc = None
        for batch in batches:
            out = []
            for d, level, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "level", name)), strict=True):
                if d != doc:
                    doc, open_levels = d, []
                while open_levels and open_levels[-1][0] >= level:
                    open_levels.pop()
                value = step(open_levels[-1][1] if open_levels else None, own)
                open_levels.append((level, value))
                out.append(shown(value) if shown else value)
            at = batch.schema.get_field_index(name)
            field = made or batch.schema.field(at)
            yield batch.set_column(at, field, pa.array(out, field.type))

    return in_order(rows).mapInArrow(run, kinds)


class Open:
    """A node between its start and its end: its row, what came down to it, and what its children gave so far."""

    __slots__ = ("given", "row", "value")

    def __init__(self, row: tuple, value):
        self.row, self.value, self.given = row, value, set()


def down_and_up(rows: DataFrame, columns: list[str], kinds: str, down: Callable[[Open | None, tuple], object], up: Callable[[Open], tuple]) -> DataFrame:
    """Rows of ``kinds`` (DDL) that ``up`` makes of each node at its end; the first two of ``columns`` are doc_id and level.

    ``down`` gives a node's value at its start, from its parent and its row;
    ``up`` sees a node whose children have put into its ``given``, and returns
    what goes to its parent's ``given`` (None: nothing) and its row in the result
    (None: none).
    """
    schema = rows.sparkSession.createDataFrame([], kinds).limit(0).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[Open] = []
        out: list[tuple] = []

        def end() -> None:
            node = stack.pop()
            given, row = up(node)
            if given is not None and stack:
                stack[-1].given.add(given)
            if row is not None:
                out.append(row)

        doc = None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                while stack and (row[0] != doc or stack[-1].row[1] >= row[1]):
                    end()
                doc = row[0]
                stack.append(Open(row, down(stack[-1] if stack else None, row)))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)
                out.clear()
        while stack:
            end()
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)

    return in_order(rows.select(*columns, *([] if "pre" in columns else [F.col("pre")]))).mapInArrow(run, kinds)
