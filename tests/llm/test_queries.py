"""The registered queries: against SQL where there is some, and the pipeline against brute force."""

import hashlib
import itertools
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from glyphmill.llm import langmix, pfair, queries, tiff
from tests.llm.test_small import brute_components, brute_removal

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    df, want = queries.queries()[name](spark, DATA), con.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(map(repr, map(tuple, df.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_removal_and_near_duplicates_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = queries.op4_repeat_removal(spark, DATA).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_removal(rows)
    got = queries.op8_near_duplicates(spark, DATA).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def documents_of(spark):
    return sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()))


def test_languages_equal_all_sets_tried(spark):
    """Every document's language is the largest part of the best of all sets of languages by penalised likelihood, by plain EM."""
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langmix.learn(documents.where(~langmix.held_out()))
    got = {r.doc_id: r for r in queries.op1_language_mixture(spark, DATA).collect()}
    for i, text in documents_of(spark):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        if not langmix._LETTER.search(text):
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        counts = langmix.trigram_counts(text).astype(float)
        seen = np.flatnonzero(counts)
        counts, probs, best = counts[seen], model.probs[:, seen], None
        for size in range(1, len(model.names) + 1):
            for chosen in itertools.combinations(range(len(model.names)), size):
                share, p = np.full(size, 1 / size), probs[list(chosen)]
                for _ in range(60 if size > 1 else 0):
                    share = share * (p @ (counts / (share @ p))) / counts.sum()
                value = counts @ np.log(share @ p) - model.penalty * np.log(counts.sum()) * (size - 1)
                if best is None or value > best[0]:
                    best = (value, model.names[chosen[int(np.argmax(share))]], share.max())
        assert got[i].lang_pred == best[1] and abs(got[i].score - best[2]) < 0.05


def test_pictures_equal_their_payloads(spark):
    got = {r.doc_id: r for r in queries.op2_tiff_pages(spark, DATA).collect()}
    for i, text in documents_of(spark):
        raw = text.encode()
        payload = raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        image = np.frombuffer(payload, np.uint8).reshape(-1, 64).astype(int)
        bright = "".join("1" if 64 * c > image.sum() else "0" for c in image.sum(axis=0))
        feature = f"{-(-len(image) // 1024)}:{100 * image.sum() // image.size}:{int(bright, 2):016x}"
        stored = tiff.store(payload)
        assert tuple(got[i]) == (i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature)
        assert b"".join(image.tobytes() for _, image, _ in tiff.read_pages(stored)) == payload


def test_tokens_equal_the_libraries(spark):
    tokenizers, tiktoken = pytest.importorskip("tokenizers"), pytest.importorskip("tiktoken")
    words = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ranks = queries.bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    files = {r.doc_id: r for r in queries.op7_token_files(spark, DATA).collect()}
    bytes_ = {r.doc_id: r for r in queries.op10_byte_bpe(spark, DATA).collect()}
    start = 0
    for i, text in documents_of(spark):
        ids = [*words.encode(text, add_special_tokens=False).ids, 2]
        assert (files[i].start, files[i].n_tokens, files[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        ids = library.encode_ordinary(text)
        assert tuple(bytes_[i]) == (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert len(files) == len(bytes_) == 200


def test_pipeline(spark):
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        before, docs = {r.doc_id: r for r in docs.collect()}, stage(spark, docs, DATA)
        after = {r.doc_id: r for r in docs.collect()}
        if name == "language ID":
            assert set(after) <= set(before) and len(after) > 0.97 * len(before)
        if name == "MinHash near-dedup":
            want = brute_components([(i, r.text) for i, r in before.items()])
            assert set(after) == {i for i, (_, c) in want.items() if i == c}
        if name == "suffix-array dedup":
            want = brute_removal([(i, r.text) for i, r in before.items()])
            assert set(after) == set(before) and all(want[i][1] or r.text == before[i].text for i, r in after.items())
            assert all(hashlib.sha256(r.text.encode()).hexdigest() == want[i][3] or not r.text.isascii() for i, r in after.items())
        if name == "mixing":
            assert after == before
        if name == "byte-level BPE":
            assert all(r.decoded_sha256 == hashlib.sha256(before[i].text.encode()).hexdigest() for i, r in after.items()) and set(after) == set(before)
        else:
            assert docs.columns == documents.columns
            docs = spark.createDataFrame(docs.collect(), documents.schema)


def test_the_mixture_is_the_order_of_the_result(spark, monkeypatch):
    kept, keep = [], corpus_pipeline.kept_from
    monkeypatch.setattr(corpus_pipeline, "discard", lambda spark, folders: None)
    monkeypatch.setattr(corpus_pipeline, "kept_from", lambda spark, make: kept.append(keep(spark, make)) or kept[-1])
    monkeypatch.setattr(corpus_pipeline, "ORDERED_ROWS", 30)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = corpus_pipeline.run(spark, DATA).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    (unmixed, _), (mixed, _) = kept[-2:]
    assert len(mixed.inputFiles()) > 1
    want = [r.doc_id for r in pfair.mix(unmixed).orderBy("slot", "place").collect()]
    assert [r.doc_id for r in got] == want and [r.position for r in got] == list(range(len(want)))
    assert want != [r.doc_id for r in unmixed.collect()] and want != sorted(want)


def test_pipeline_on_odd_rows(spark):
    """Every stage keeps what it should of null, empty, repeated and clashing rows, whatever other columns there are."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, slot int, position int, component int"
    a, b = "the first of the texts has these words in it", "quite another text stands here under the same number"
    long = " ".join(f"word{k}" for k in range(20_000))
    rows = [(3, a, "en", "s"), (5, a, "en", "s"), (5, b, "en", "t"), (9, b, "en", None), (9, b, "en", None), (None, "no number but a few words", None, "t"), (None, None, None, None), (1, None, "en", "s"), (2, "", None, "s"), (4, long, "en", "t"), (6, "123 !!", "en", "s")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 0.5, 1, 2, 3) for r in rows], schema)
    texts = {
        "language ID": sorted([a, a, b, b, b, "no number but a few words", long]),
        "MinHash near-dedup": sorted([a, b, "no number but a few words", long]),
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, DATA).collect()
        if name in texts:
            assert sorted(r.text for r in got) == texts[name]
        docs = spark.createDataFrame([tuple(r) + (0.5, 1, 2, 3) for r in got], schema)
    done = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert sorted(r.decoded_sha256 for r in done) == sorted(hashlib.sha256(x.encode()).hexdigest() for x in texts["MinHash near-dedup"])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0
    whole = docs.unionByName(spark.createDataFrame([(None, None, None, None, None, None, None, None, None), (7, None, None, None, None, None, None, None, None)], schema))
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, whole, DATA).count() == whole.count()
