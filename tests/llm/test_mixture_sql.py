"""The mixture against its SQL where sources differ in size."""

import duckdb
import pytest

from glyphmill.llm import pfair


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_mixture_of_unequal_sources_equals_sql(spark, monkeypatch, broadcast):
    """One source has most rows; others, and rows without a source, are of many sizes."""
    monkeypatch.setattr(pfair, "BROADCAST_SLOTS", broadcast)
    sizes = {"hot": 3000, "a": 165, "b": 100, "c": 130, "d": 111, "e": 150, "f": 139, None: 5, "one": 1}
    rows = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    con = duckdb.connect()
    documents = df.toArrow()
    con.register("documents", documents)
    got, want = pfair.mix(df), con.sql(pfair.ORACLE)
    assert sorted(map(repr, map(tuple, got.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))
