"""Blocks of like size meet from the shared folder: what is shuffled grows with the rows, not with the pairs of blocks."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from glyphmill.operators import parallels


def texts_of(n, seed=11):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcd", [6, 3, 2, 1], k=rng.randint(0, 40))) for _ in range(n)]


def brute(rows):
    sets = [(i, {t[k : k + 3] for k in range(len(t) - 2)}) for i, t in rows if i is not None and t is not None]
    both = lambda a, b: (min(a[0], b[0]), max(a[0], b[0]), len(a[1] & b[1]), len(a[1] | b[1]))
    return sorted(both(a, b) for a, b in itertools.combinations(sets, 2) if a[0] != b[0] and a[1] | b[1] and 10 * len(a[1] & b[1]) >= 3 * len(a[1] | b[1]))


def shuffled(spark, work):
    """Records that the stages of ``work`` write to shuffles, and its result."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in gateway.jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None))}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = stages()
    got = work()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(n for k, n in stages().items() if k not in before), got


def test_rows_are_shuffled_once(spark):
    rows = list(enumerate(texts_of(600)))
    df = spark.createDataFrame(rows, "id long, t string")
    sent, got = shuffled(spark, lambda: sorted(map(tuple, parallels.similar_pairs(df, "id", F.col("t"), block_rows=20).collect())))
    assert got == brute(rows)
    assert sent < 3 * len(rows)  # before, every row went to each block that its block met


def test_counts_send_no_pairs(spark):
    rows = list(enumerate(texts_of(500)))
    df = spark.createDataFrame(rows, "id long, t string")
    want = {}
    for a, b, *_ in brute(rows):
        want[a], want[b] = want.get(a, 0) + 1, want.get(b, 0) + 1
    sent, got = shuffled(spark, lambda: {r.id: r.parallels for r in parallels.similar_counts(df, "id", F.col("t"), block_rows=100).collect()})
    assert got == want and sum(want.values()) > 20 * len(rows)
    assert sent < 20 * len(rows)
    counted = parallels.parallel_counts(parallels.similar_counts(df, "id", F.col("t")), df, "id").collect()
    assert sorted((r.id, r.parallels) for r in counted) == [(i, want.get(i, 0)) for i, _ in rows]


def test_repeated_and_missing_keys_and_groups(spark):
    rows = [(None, "abcdef"), (1, "abcdef"), (1, "abcdef"), (2, "abcdef"), (3, None), (4, ""), (5, "abcdxx"), (6, "a\U00010400bcd\U00010400")]
    df = spark.createDataFrame(rows, "id long, t string")
    for size in (1, 2, 100):
        assert sorted(map(tuple, parallels.similar_pairs(df, "id", F.col("t"), block_rows=size).collect())) == brute(rows)
    rows = list(enumerate(texts_of(200, 5)))
    df = spark.createDataFrame(rows, "id long, t string")
    own = parallels.similar_pairs(df, "id", F.col("t"), group=F.col("id") % 3, block_rows=7)
    assert sorted(map(tuple, own.collect())) == [r for r in brute(rows) if r[0] % 3 == r[1] % 3]


def test_shared_trigrams_are_counted_both_ways(monkeypatch):
    block = lambda texts: parallels.Block(*(c.flatten().to_numpy() for c in parallels._batch_of(list(enumerate(texts))).columns))
    x, y = texts_of(75, 1), [*texts_of(58, 2), "", "zzz"]
    want = [[len(set(parallels.codes(a).tolist()) & set(parallels.codes(b).tolist())) for b in y] for a in x]
    for shared, columns, added in ((0, 4095, 100), (0, 7, 100), (2000, 7, 100), (2000, 7, 1 << 20), (30, 5, 9)):
        monkeypatch.setattr(parallels, "SHARED", shared)
        monkeypatch.setattr(parallels, "COLUMNS", columns)
        monkeypatch.setattr(parallels, "ADDED", added)
        assert np.array_equal(parallels._shared(block(x), block(y)), want)
    assert np.array_equal(parallels._shared(block(y), block(x)), np.transpose(want))


def test_long_sets_share_blocks_with_fewer_rows(spark, monkeypatch):
    monkeypatch.setattr(parallels, "BLOCK_TRIGRAMS", 200)
    rows = list(enumerate(texts_of(120, 9)))
    df = spark.createDataFrame(rows, "id long, t string")
    assert sorted(map(tuple, parallels.similar_pairs(df, "id", F.col("t"), block_rows=50).collect())) == brute(rows)


def test_mirrored_pairs_are_found_once(spark):
    rows = list(enumerate(texts_of(400, 13)))
    df = spark.createDataFrame(rows, "id long, t string")
    sent, got = shuffled(spark, lambda: sorted((r.id, r.id2) for r in parallels.mirrored(parallels.similar_pairs(df, "id", F.col("t"), block_rows=20)).collect()))
    assert got == sorted([(a, b) for a, b, *_ in brute(rows)] + [(b, a) for a, b, *_ in brute(rows)])
    assert sent < 3 * len(rows)


def test_stored_pairs_stay_where_they_are(spark):
    rows = list(enumerate(texts_of(500, 17)))
    df = spark.createDataFrame(rows, "id long, t string")
    stored = spark.createDataFrame(brute(rows), "id1 long, id2 long, inter long, total long")
    changed = spark.createDataFrame([(k,) for k in range(0, 500, 9)], "id long")
    now = df.where("id % 18 <> 0").withColumn("t", F.when(F.col("id") % 9 == 0, F.concat("t", "t")).otherwise(F.col("t")))
    with_threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent, got = shuffled(spark, lambda: sorted(map(tuple, parallels.updated_pairs(stored, now, changed, "id", F.col("t")).collect())))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_threshold)
    assert got == brute([(i, t + t if i % 9 == 0 else t) for i, t in rows if i % 18])
    assert sent < 10 * len(rows) < stored.count()


def test_counting_queries_send_no_pairs(spark, tmp_path):
    from glyphmill.plans import registry

    rows = [(k // 4 * 1000 + k % 4, t) for k, t in enumerate(texts_of(480, 19))]
    turns = spark.createDataFrame([(i // 1000, i % 1000, "user" if i % 2 else "assistant", t) for i, t in rows], "conv_id long, turn long, role string, text string")
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    found = brute(rows)
    want = {i: 0 for i, _ in rows}
    for a, b, *_ in found:
        want[a], want[b] = want[a] + 1, want[b] + 1
    sent, got = shuffled(spark, lambda: {r.id: r.parallels for r in registry.queries()["parallels_per_passage"](spark, str(tmp_path)).collect()})
    assert got == want and sent < 10 * len(rows) < len(found)
    sent, got = shuffled(spark, lambda: {r.conv_id: (r.users, r.assistants) for r in registry.queries()["parallels_by_source"](spark, str(tmp_path)).collect()})
    own = [i for i, n in want.items() if n]
    assert got == {c: (sum(i // 1000 == c and i % 2 == 1 for i in own), sum(i // 1000 == c and i % 2 == 0 for i in own)) for c in {i // 1000 for i in own}}
    assert sent < 10 * len(rows)


def test_counting_queries_make_no_pairs(spark):
    from glyphmill.plans import registry

    for name in ("parallels_per_passage", "parallels_by_source"):
        assert "id1#" not in registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "id1#" in registry.queries()["jaccard_selfjoin"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
