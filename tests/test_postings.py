"""The postings index: what a search reads, and its results against plain searches of all texts."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import catalog, postings


def rows_of(rng, n, vocabulary):
    return [(k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 12))), rng.choice(["one", "two", None])) for k in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return rows_of(rng, 400, [f"{a}{b}{c}" for a in "abc" for b in "xy" for c in ("", "z", "zz")] + ["rare"]) + [(7, None, "one"), (8, "", None)]


def index_of(spark, rows, tmp_path, grams, parts=6):
    df = spark.createDataFrame(rows, "doc long, text string, kind string").repartition(parts)
    return postings.build(df, "doc", ["text", "kind"], f"file://{tmp_path}/{grams.__name__}", grams)


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_BITS", 3)
    monkeypatch.setattr(postings, "FIRST_BLOCKS", 2)


QUERIES = ["axz", "text:axz", "kind:one", "text:axz and kind:two", "text:bxz or text:rare", "not text:bxz", "kind:one and not (text:axz or text:cyz)", '"xz b"', "ax", "qqqq", "text:qqqq or kind:two"]


def test_searches_equal_those_of_all_texts(spark, rows, small, tmp_path):
    index = index_of(spark, rows, tmp_path, postings.trigrams)
    plain = spark.createDataFrame([(k, t or "", x or "") for k, t, x in rows], "doc long, text string, kind string")
    for q in QUERIES:
        want = sorted(r.doc for r in catalog.search_boolean(plain, q, ["text", "kind"]).collect())
        assert sorted(r.doc for r in postings.search(index, catalog.parse_boolean(q)).collect()) == want, q
    assert postings.search(index, catalog.Op("and", (catalog.Exact(("one",), "kind"), catalog.Term("axz", "text")))).count() == sum(x == "one" and "axz" in (t or "") for _, t, x in rows)


def test_a_search_reads_its_grams_parts_only(spark, rows, small, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = index_of(spark, rows, tmp_path, postings.trigrams)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = {r.part: (r.first, r.last) for r in index.directory.collect()}
    assert len(parts) > 2
    lists = postings.lists_of(index, ["text:axz"])
    plan = lists._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    read = {int(x) for x in re.findall(r"\d+", re.search(r"PartitionFilters: \[(.*?)\]\n", plan).group(1).replace("#" , " #").split("IN")[-1])} if " IN " in plan else {int(re.search(r"part#\d+ = (\d+)", plan).group(1))}
    assert read == {p for p, (a, b) in parts.items() if a <= "text:axz" <= b} and len(read) < len(parts)
    assert "PushedFilters" in plan and "text:axz" in plan
    places = {r.block << 3 | p for r in lists.collect() for p in r.places}
    held = index.documents.where(F.col("text").contains("axz")).select("number").collect()
    assert places == {r.number for r in held}


def score(counts, df, n):
    return sum(math.floor(1000 * math.log(n / df[w])) * (1000 + math.floor(1000 * math.log(tf))) for w, tf in counts.items())


@pytest.mark.parametrize("size", [3, 20, 1000])
def test_ranking_equals_all_scores(spark, rows, small, tmp_path, size):
    index = index_of(spark, rows, tmp_path, postings.words)
    wanted = ["axz", "rare", "by", "none"]
    counts = [(k, collections.Counter(w for w in (t or "").split() if w in wanted)) for k, t, _ in rows]
    df = collections.Counter(w for _, c in counts for w in c)
    best = sorted((-score(c, df, len(rows)), k) for k, c in counts if c)[:size]
    got = sorted((r["rank"], r.doc, r.score) for r in postings.ranked(index, wanted, "text", size).collect())
    assert got == [(i, k, -s) for i, (s, k) in enumerate(best, 1) if s < 0]
    assert postings.ranked(index, ["none"], "text", size).count() == 0


def test_facets(spark, rows, tmp_path):
    index = index_of(spark, rows, tmp_path, postings.words)
    found = postings.holding(index, ["rare"], "text").withColumn("even", F.col("doc") % 2 == 0)
    own = [(k, x or "") for k, t, x in rows if "rare" in (t or "").split()]
    want = {("kind", v, n) for v, n in collections.Counter(x for _, x in own).items()} | {("even", str(v).lower(), n) for v, n in collections.Counter(k % 2 == 0 for k, _ in own).items()}
    assert {tuple(r) for r in postings.facets(found, ["kind", "even"]).collect()} == want


def test_snippets(spark):
    texts = [(1, "x one two\nfar far one, two; two far away from here one"), (2, "nothing here"), (3, None), (4, "two"), (5, "a-verylongword-b")]
    df = spark.createDataFrame(texts, "doc long, text string")
    got = {r.doc: (r.line, r.start, r.n_matches, r.snippet) for r in postings.snippets(df, "doc", "text", F.lower, {"one": 2, "two": 1, "verylongword": 1}, 15).collect()}
    assert got == {1: (1, 8, 3, "[...]one, two; two [...]"), 4: (0, 0, 1, "two"), 5: (0, 2, 1, "[...]verylongword-b")}


def test_empty_index(spark, tmp_path):
    for grams in (postings.trigrams, postings.words):
        index = index_of(spark, [], tmp_path, grams)
        assert postings.search(index, catalog.parse_boolean("text:abc")).count() == 0
        assert postings.ranked(index, ["abc"], "text", 5).count() == postings.holding(index, ["abc"], "text").count() == 0
