"""The index's segments stay in the shared folder: Spark's rows only list them, and tasks read one at a time, of it what they need."""

from glyphmill.llm import lexical


def test_rows_only_list_segments(spark):
    docs = spark.createDataFrame([(k, f"one two{k % 7} three{k % 3} one") for k in range(60)], "doc_id long, text string").repartition(4)
    index = lexical.build(docs)
    assert dict(index.dtypes) == {"file": "string", "number": "bigint", "n_docs": "bigint", "n_terms": "bigint"}
    assert index.count() == 4 and tuple(index.agg({"n_docs": "sum", "n_terms": "sum"}).first()) in ((60, 240), (240, 60))
    read = [s for batch in index.toArrow().to_batches() for s in lexical._stored([batch], ("terms", "counts"))]
    assert all(s.schema.names == ["terms", "counts"] and s.num_rows == 1 for s in read)
    held = [(t, n) for s in read for t, n in zip(*(s.column(c)[0].as_py() for c in ("terms", "counts")), strict=True)]
    assert sum(n for t, n in held if t == b"one") == 60
