"""Ways that differ by size give equal results; whatever is left out early has no problems."""

import random

from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators import catalog, parallels, quality


def test_searches_in_rounds(spark, monkeypatch):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choices("abc d", k=n))
    queries = spark.createDataFrame([(k, text(20)) for k in range(25)] + [(90, None), (91, "a"), (92, text(500))], "q long, t string")
    rows = spark.createDataFrame([(k, text(30)) for k in range(120)], "k long, x string")
    find = lambda: sorted(map(tuple, parallels.nearest(queries, "q", F.col("t"), rows, "k", F.col("x"), 7).collect()))
    once = find()
    monkeypatch.setattr(parallels, "SENT_TRIGRAMS", 150)
    assert find() == once and len(once) > 150


def test_fresh_pairs(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([(k, "".join(rng.choices("ab", k=rng.randint(0, 12)))) for k in range(90)], "id long, x string").withColumn("fresh", F.col("id") % 4 == 0)
    every = {tuple(r) for r in parallels.similar_pairs(rows, "id", F.col("x"), block_rows=10).collect()}
    some = parallels.similar_pairs(rows, "id", F.col("x"), block_rows=10, fresh=F.col("fresh")).collect()
    assert {tuple(r) for r in some} == {r for r in every if r[0] % 4 == 0 or r[1] % 4 == 0} and len(some) == len({tuple(r) for r in some})
    changed = spark.createDataFrame([(0,), (4,), (200,)], "id long")
    stored = parallels.similar_pairs(rows.where("id < 80"), "id", F.col("x"))
    now = rows.where("id < 80 and id <> 4").withColumn("x", F.when(F.col("id") == 0, "abab").otherwise(F.col("x"))).unionByName(spark.createDataFrame([(200, "abba", True)], "id long, x string, fresh boolean"))
    updated = sorted(map(tuple, parallels.updated_pairs(stored, now, changed, "id", F.col("x")).collect()))
    assert updated == sorted(map(tuple, parallels.similar_pairs(now, "id", F.col("x")).collect()))


def test_lines_that_are_left_out_have_no_problems(spark):
    rng = random.Random(4)
    marks = [chr(c) for c in (0x301, 0x325, 0x304, 0x200D, 0x200C, 0x430, 0x4D9, 0x1100, 0x1161, 0xAC00, 0x11A8, 0x1F1E6, 0x1F3FB, 0x1F600, 0xFF9E, 0x0D4E, 0x903, 0x915, 0x94D, 0xE9, 0x61, 0x72, 0x1E5B, 0x600, 0xAD, 0xFE0F, 0x20E3, 0x1C80, 0xA640, 0x2DE0, 0x1D2B, 0x1F468, 0x0300, 0xC5)]
    lines = ["".join(rng.choices(marks, k=rng.randint(1, 4))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(lines)), "id long, t string")
    clusters = df.select("id", F.explode(T.graphemes(T.nfc(F.col("t")))).alias("c")).where(~T.is_valid_cluster(F.col("c")))
    want = {r.id: r.n for r in clusters.groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert {r.id: r.n for r in quality.odd_clusters(df, "id", "t").collect()} == want
    assert len(want) < 3000


def test_covered_places_do_not_depend_on_the_way():
    rng = random.Random(5)

    def slow(display, term):
        folded, out, done = [catalog.fold_expansion(c) for c in display], [], 0
        owner = [k for k, f in enumerate(folded) for _ in f]
        whole = "".join(folded)
        at = whole.find(term) if term else -1
        while at >= 0:
            first, last = max(owner[at], done), owner[at + len(term) - 1]
            if last >= first:
                out.append({"start": first, "length": last - first + 1})
                done = last + 1
            at = whole.find(term, at + len(term))
        return out

    for _ in range(3000):
        display = "".join(rng.choices("aSsßœOeÆđDİ" if rng.random() < 0.5 else "aSsOeDd", k=rng.randint(0, 12)))
        term = catalog.fold_expansion("".join(rng.choices("sSßoe d", k=rng.randint(1, 3))))
        assert catalog.covered(display, term) == slow(display, term)
