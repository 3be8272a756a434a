"""The operators on small cases: known results, brute force, exact round trips, odd rows."""

import collections
import gzip
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import bpe, components, langmix, licences, neardup, pfair, qualityforest, suffixes, tiff, tokenfiles, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `Extra col` int"
ODD = [(1, None, None, None, None, 1), (2, "", "en", "s", 0, 2), (None, "a text without an id, of more than five words", "en", "s", 3, 3), (4, "x " * 30_000, "en", "s", 60_000, 4), (5, "same words here as there, all of them", "en", "s", 9, 5), (5, "same words here as there, all of them", "en", "s", 9, 5), (6, "same words here as there, all of them", "fr", "t", 9, 6), (7, "123 !!", "en", "t", 6, 7), (8, "\x00\x1c　é\U0001f600", "en", "t", 5, 8)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---- byte-level BPE

@pytest.fixture(scope="module")
def codec():
    return bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def test_bitmap_is_a_set():
    random.seed(1)
    bitmap, members = bpe.RankBitmap(5000), set()
    for _ in range(3000):
        i = random.randrange(5000)
        (members.add if random.random() < 0.6 else members.discard)(i)
        (bitmap.add if i in members else bitmap.discard)(i)
        assert bitmap.first() == min(members, default=-1)


def test_bpe_equals_the_library(codec):
    tiktoken = pytest.importorskip("tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    random.seed(2)
    texts = ["", "a  b ", "  \n \n x", "aaaa" * 60, "x" * 3000, "日本語 テスト", "\x1c \x85　 a", *("".join(random.choices("ab \n\t'sé1²#!日　", k=random.randint(0, 60))) for _ in range(400))]
    for text, (n, ids_digest, bytes_digest) in zip(texts, codec.round_trip(texts), strict=True):
        ids = library.encode_ordinary(text)
        assert codec.encode(text) == ids and [i for p in codec.pattern.findall(text) for i in codec.encode_piece(p.encode())] == ids
        assert (n, ids_digest, bytes_digest) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_bpe_frames(spark, odd, empty, codec):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    got = bpe.round_trip(odd, path, public_tokenizers.PATTERN).collect()
    assert len(got) == len(ODD) and next(r for r in got if r.doc_id == 1).n_tokens == 0
    ids = bpe.encode(odd, path, public_tokenizers.PATTERN)
    assert sorted((bytes(r.bytes) for r in bpe.decode(ids, path, public_tokenizers.PATTERN).collect())) == sorted((r[1] or "").encode() for r in ODD)
    assert bpe.round_trip(empty, path, public_tokenizers.PATTERN).count() == 0


# ---- token files

def test_token_files(spark, odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = lambda: tokenfiles.word_tokenizer(path).encode
    library = tokenfiles.WordTokenizer(path).tokenizer
    got = tokenfiles.digest(tokenfiles.write(odd, encoder, 2)).orderBy("start").collect()
    rows = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for r, row in zip(got, rows, strict=True):
        ids = [*library.encode(row[1] or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (row[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokenfiles.digest(tokenfiles.write(empty, encoder, 2)).count() == 0


# ---- languages

def test_mixture_of_two_languages():
    random.seed(3)
    words = {"a": ["kata", "mika", "tikka"], "b": ["zorul", "ruzol", "lozur"], "c": ["pefi", "fepe"]}
    say = lambda lang, n: " ".join(random.choices(words[lang], k=n))
    model = langmix.Mixture(list(words), np.array([langmix.trigram_counts(say(x, 2000)) for x in words], float))
    assert list(model.infer(say("b", 50))) == ["b"]
    mixed = model.infer(say("a", 60) + " " + say("c", 30))
    assert list(mixed) == ["a", "c"] and 0.5 < mixed["a"] < 0.8
    assert model.infer("123 !!") == {} and langmix.Mixture([], np.zeros((0, 1 << langmix.BITS))).infer("abc") == {}


def test_language_frames(spark, odd, empty):
    got = {r.doc_id: r for r in langmix.identify(odd).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[7].lang_pred == "und" and got[1].score == 0
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.values() if r.doc_id is not None)
    assert langmix.identify(empty).count() == 0


def test_languages_held_out(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langmix.identify(documents).where("held_out").join(documents.select("doc_id", "lang"), "doc_id")
    assert got.where("lang = lang_pred").count() >= 0.98 * got.count()


# ---- quality

def test_statistics_equal_brute_force():
    random.seed(4)
    for text in ["", "a\n\na\nb\na", "#* x|<>", *(" ".join(random.choices("abc", k=random.randint(0, 40))) for _ in range(200)), "a\x1cb\x85 c\x0bd"]:
        words = [w for w in re.split(r"[\x20\x09-\x0d]+", text) if w]
        often = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {k for i in range(len(words) - 4) if often[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
        assert qualityforest.statistics(text)[0] == (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_forest_finds_what_stands_apart():
    rng = np.random.default_rng(5)
    good, bad = rng.exponential(0.01, (600, 6)), rng.exponential(0.01, (60, 6))
    bad[np.arange(60), rng.integers(0, 6, 60)] += rng.uniform(0.5, 3, 60)  # each breaks one rule by far
    rules = qualityforest.fit(np.concatenate([good, bad]), np.arange(660) < 600)
    assert (rules.scores(bad) >= rules.threshold).mean() > 0.8 and (rules.scores(good) >= rules.threshold).mean() < 0.02
    assert qualityforest.fit(np.zeros((0, 6)), np.zeros(0, bool)).threshold == np.inf


def test_scores_equal_a_plain_forest():
    """Every tree holds all rows: each leaf's length is its depth and what its rows would still take; scores follow from these."""
    rows = np.random.default_rng(18).exponential(1, (120, 3))
    forest = qualityforest.Forest(rows, trees=7, tree_rows=len(rows))
    harmonic = lambda n: sum(1 / k for k in range(1, n))

    def leaf(tree, x, node=0, depth=0):
        feature, value, child, _ = tree
        if feature[node] < 0:
            return node, depth
        return leaf(tree, x, int(child[node]) + int(x[feature[node]] >= value[node]), depth + 1)

    total = np.zeros(len(rows))
    for tree in forest.trees:
        at = [leaf(tree, x) for x in rows]
        sizes = collections.Counter(node for node, _ in at)
        for k, (node, depth) in enumerate(at):
            n = sizes[node]
            assert depth <= forest.depth and (n == 1 or depth == forest.depth)
            rest = 0 if n < 2 else 1 if n == 2 else 2 * harmonic(n) - 2 * (n - 1) / n
            assert abs(tree[3][node] - depth - rest) < 0.5  # the logarithm stands for the harmonic number
            total[k] += tree[3][node]
    assert np.allclose(forest.scores(rows), 2.0 ** (-total / 7 / qualityforest.Forest.average(120)))
    same = qualityforest.Forest(np.ones((50, 3)))
    assert len(set(same.scores(np.ones((5, 3))))) == 1


def test_limits_and_trees_see_only_their_half():
    rng = np.random.default_rng(19)
    features, good = rng.exponential(0.01, (400, 6)), np.arange(400) % 5 > 0
    other = features.copy()
    other[1::2] *= 3  # the half that calibrates
    a, b = qualityforest.fit(features, good), qualityforest.fit(other, good)
    assert (a.limits == b.limits).all() and all((x == y).all() for s, t in zip(a.forest.trees, b.forest.trees, strict=True) for x, y in zip(s, t, strict=True))


def test_labelled_documents_are_told_apart(spark):
    at = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    got = qualityforest.judge(documents, qualityforest.learn(documents, labels)).join(labels, "doc_id")
    kept = {r.quality: r.k for r in got.where("quality = 0 or not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("k")).collect()}
    assert kept[1] > 0.98 and kept[0] < 0.1


def test_quality_frames(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 1), (4, None, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in qualityforest.judge(odd, qualityforest.learn(odd, labels)).collect()}
    assert got[1].base_failed and not got[1].kept and got[4].n_words == 30_000 and got[4].base_failed
    assert qualityforest.judge(empty, qualityforest.learn(empty, labels.limit(0))).count() == 0


def test_no_row_is_lost(spark):
    """More rows in a partition than any operator takes at a time."""
    docs = spark.range(0, 5500, 1, 2).selectExpr("id as doc_id", "concat('w', id, ' a b c d e f') as text", "'en' as lang", "'s' as source")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    words = public_tokenizers.path("word_bpe_49k.json")
    results = [
        qualityforest.judge(docs, qualityforest.learn(docs, labels)), langmix.identify(docs), bpe.round_trip(docs, path, pattern), bpe.encode(docs, path, pattern), neardup.near_duplicates(docs), suffixes.remove_repeats(docs), pfair.mix(docs),
        licences.scan(docs, licences.known(spark)), tiff.features(tiff.pages(tiff.store_texts(docs), keep=("row", "doc_id", "n_bytes", "media_bytes", "media_sha256"))), tokenfiles.digest(tokenfiles.write(docs, lambda: tokenfiles.word_tokenizer(words).encode, 2)),
        warc.read_captures(warc.look_up(warc.CaptureIndex.build(warc.write_archives(docs.selectExpr("doc_id as page_id", "text as url", "text as html"))), docs, "text")),
    ]
    for df in results:
        assert df.count() == df.select(df.columns[0]).distinct().count() == 5500 or "slot" in df.columns and df.count() == 5500


# ---- TIFF

def test_coders_are_lossless():
    rng = np.random.default_rng(6)
    for data in [b"", b"a", b"ab" * 3000, bytes(70_000), *(rng.integers(0, k, n, dtype=np.uint8).tobytes() for k, n in itertools.product((2, 5, 256), (1, 250, 511, 4000, 20_000)))]:
        for coder in (tiff.LZW, tiff.DEFLATE, tiff.PACKBITS):
            assert tiff.DECODE[coder](tiff.ENCODE[coder](data)) == data


def test_pages_of_all_kinds():
    rng = np.random.default_rng(7)
    for (rows, cols), coder, predictor, tiled, order in itertools.product([(1, 64), (300, 100)], tiff.ENCODE, (1, 2), (False, True), "<>"):
        image = rng.integers(0, 9, (rows, cols), dtype=np.uint8)
        got = list(tiff.read_pages(tiff.write_tiff([image, image[:1]], coder, predictor, tiled, order)))
        assert [e for _, _, e in got] == [None, None] and (got[0][1][..., 0] == image).all() and (got[1][1][..., 0] == image[:1]).all()


def test_damaged_files_give_errors():
    whole = tiff.store(tiff.payload_of("some text " * 50))
    for data in (b"", b"II*\0", whole[:60], b"MM\0*" + b"\xff" * 50, b"no picture"):
        assert list(tiff.read_pages(data))[-1][2]


def test_tiff_frames(spark, odd, empty):
    run = lambda df: tiff.features(tiff.pages(tiff.store_texts(df), keep=("row", "doc_id", "n_bytes", "media_bytes", "media_sha256")))
    got = run(odd).collect()
    assert sorted((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted((len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for _, t, *_ in ODD for p in [tiff.payload_of(t or "")])
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id in (5, 6)}) == 1
    assert run(empty).count() == 0


# ---- licences

def test_licences(spark, odd, empty):
    mit = licences.LICENCES["MIT"]
    texts = ["Copyright (c) 2020 A B\nAll rights reserved.\n\n" + mit.upper(), "  " + mit.replace("\n", "\n * ").replace('"', "“"), mit + " x", mit.replace("sublicense", "sublicence"), None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.licence_id for r in licences.scan(df, licences.known(spark)).collect()}
    assert got == {0: "MIT", 1: "MIT", 2: None, 3: "MIT", 4: None, 5: None}
    assert licences.scan(odd, licences.known(spark)).count() == len(ODD) and licences.scan(empty, licences.known(spark)).count() == 0


def test_licences_of_a_folder(spark, tmp_path):
    long = "Example General License\nVersion 3\n\n" + "You may use the organisation's programme as you see fit. " * 900
    (tmp_path / "Example-3.0.txt").write_text(long)
    (tmp_path / "Again").write_text("The MIT License\n\n" + licences.LICENCES["MIT"])
    texts = ["Copyright 1999 X\n" + long.upper(), long.replace("organisation", "organization"), long[:-30], "ISC License\n\nCopyright (c) 2001 Y\n\n" + licences.LICENCES["ISC"], "The MIT License\n\n" + licences.LICENCES["MIT"], licences.LICENCES["Zlib"]] * 40
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.licence_id for r in licences.scan(df, licences.known_in(spark, f"file://{tmp_path}")).orderBy("doc_id").collect()]
    assert got == ["Example-3.0", "Example-3.0", None, "ISC (titled ISC License)", "Again", "Zlib"] * 40


# ---- mixing

def test_mixture_deviates_by_less_than_a_block(spark):
    sizes = {"a": 3000, "b": 400, "c": 90, "d": 1, None: 50}
    rows = [(i, s) for s, n in sizes.items() for i in range(n)]
    got = pfair.mix(spark.createDataFrame(rows, "doc_id long, source string"), block_docs=1).collect()
    assert len(got) == len(rows) and len({r.slot for r in got}) == len(rows)
    share = {k: int(n**0.5) for k, n in sizes.items()}
    cycle = sum(share.values())
    for source, part in share.items():
        slots = sorted(r.slot for r in got if r.source == source)
        for j, slot in enumerate(slots):
            assert j * cycle // part <= slot < -(-(j + 1) * cycle // part)  # between release and deadline


def test_mixture_meets_the_true_weights(spark):
    sizes = {"big": 9000, **{f"s{k}": 40 + 7 * k for k in range(25)}, None: 1}
    rows = [(i, s) for s, n in sizes.items() for i in range(n)]
    got = pfair.mix(spark.createDataFrame(rows, "doc_id long, source string"), block_docs=1).collect()
    weights = {k: int(n**0.5) for k, n in sizes.items()}
    total = sum(weights.values())
    slots = {k: sorted(r.slot for r in got if r.source == k) for k in sizes}
    assert len({r.slot for r in got}) == len(rows) and all(len(slots[k]) == n for k, n in sizes.items())
    for source, n in sizes.items():
        have = 0
        for prefix in range(1, slots[source][-1] + 2):  # as long as the source has blocks
            have += slots[source][have] == prefix - 1
            assert abs(have * total - prefix * weights[source]) < total


def test_mixture_of_many_sources(spark):
    counts = spark.createDataFrame([("=big", 5_000_000), *((f"={k}", 5000) for k in range(1999))], "key string, n long")
    shared = pfair.shares(counts, "floor(sqrt(n))").first()
    assert dict(zip(shared["keys"], shared["c"], strict=True))["=big"] == 2236 and shared["cycle"] == 2236 + 1999 * 70


def test_mixing_frames(spark, odd, empty):
    assert pfair.mix(odd).drop("block", "slot", "place").columns == odd.columns and pfair.mix(odd).count() == len(ODD)
    assert pfair.mix(empty).count() == 0


# ---- archives

def test_reversed_hosts():
    key = warc.reversed_host_key
    assert key("https://www.Example.com:443/A?b=1#c") == "com,example)/a?b=1" and key("http://u@x.org:81") == "org,x:81)/" and key(None) == key("") == "" and key("http://[bad") == "http://[bad"
    assert "\n" not in key("http://a.b/c\nd e") and "\t" not in key("x\ty")


def test_archives_and_index(spark):
    long, other = "<p>" + "x" * 200, "<p>" + "y" * 200
    rows = [(3, "http://a.b/1", long), (1, "http://a.b/1", long), (2, "http://www.a.b/1", other), (9, None, long), (None, "http://z", long), (5, "http://c\r\nX: y", "short"), (6, "http://c", "short"), (7, "http://q", None), (1, "http://other", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    captures = warc.write_archives(pages)
    for at in {r.file for r in captures.collect()}:
        assert gzip.open(at.removeprefix("file:")).read().startswith(b"WARC/1.1\r\n")
    for lines in (1, 2, 1000):
        index = warc.CaptureIndex.build(captures, block_lines=lines)
        got = collections.Counter(map(tuple, warc.read_captures(warc.look_up(index, pages)).collect()))
        want = collections.Counter((i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), *(("revisit", 1) if h == long and i != 1 else ("response", None))) for i, _, h in rows)
        assert got == want
    one = warc.look_up(index, spark.createDataFrame([("https://a.b/1",), ("http://none",)], "url string"))
    assert sorted(r.id for r in one.collect()) == [1, 2, 3]
    nothing = warc.CaptureIndex.build(warc.write_archives(pages.limit(0)))
    assert warc.look_up(nothing, pages).count() == 0


# ---- near-duplicates

def brute_components(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_rows():
    random.seed(8)
    word = lambda: "".join(random.choices("abcdefgh", k=4))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(150):  # a chain of edits, and copies near the threshold
        own = list(base)
        for _ in range(random.randint(0, 4)):
            own[random.randrange(len(own))] = word()
        rows.append((i, " ".join(own)))
        if i % 10 == 9:
            base[random.randrange(len(base))] = word()
    rows += [(200 + i, " ".join(word() for _ in range(random.randint(0, 30)))) for i in range(40)]
    return rows + [(300, "Few words"), (301, "few  WORDS"), (302, ""), (303, None), (304, rows[3][1])]


def test_common_payloads_meet_where_they_are(spark, monkeypatch):
    same, empty = "<p>" + "x" * 200, ""
    rows = [(k, f"http://a.b/{k}", same if k % 3 == 0 else empty if k % 3 == 1 else f"<p>{k}" + "y" * 100) for k in range(300)] + [(None, None, same)] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    monkeypatch.setattr(warc, "HOT_ROWS", 5)
    got = warc.read_captures(warc.look_up(warc.CaptureIndex.build(warc.write_archives(pages)), pages)).collect()
    want = [(i, len(h), hashlib.sha256(h.encode()).hexdigest(), *(("revisit", 0) if h == same and i != 0 else ("response", None))) for i, _, h in rows]
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)


@pytest.mark.parametrize("chunk", [5000, 4 << 20])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(neardup, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(neardup, "PIVOTS", 2)
    rows = near_rows()
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicate_frames(spark, odd, empty):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.doc_id in (5, 6)} == {5}
    assert neardup.near_duplicates(empty).count() == 0


def test_components(spark):
    random.seed(9)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(1000, i) for i in range(1001, 1100)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert dict(map(tuple, components.connected_components(spark.createDataFrame(links, "a long, b long")).collect())) == want


# ---- repeats

def brute_removal(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        cover, n = bytearray(len(raw)), suffixes.LENGTH
        for k in range(len(raw) - n + 1):
            if raw[k : k + n] in seen:
                cover[k : k + n] = b"\1" * n
            seen.add(raw[k : k + n])
        kept = bytes(b for b, c in zip(raw, cover, strict=True) if not c)
        out[i] = (len(raw), sum(cover), len(re.findall(b"\1+", cover)), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [4000, 5])
def test_repeats_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT_CONTEXTS", hot)
    random.seed(10)
    passages = ["".join(random.choices("ab \x00é", k=300)) for _ in range(5)]
    pieces = [lambda: random.choice(passages)[random.randint(0, 150) :][: random.randint(90, 220)], lambda: "".join(random.choices("abcd", k=random.randint(0, 120))), lambda: "x" * random.randint(0, 250), lambda: "ab" * random.randint(0, 130)]
    rows = [(i * 7 % 181, "".join(random.choice(pieces)() for _ in range(random.randint(0, 4)))) for i in range(180)]
    rows += [(1000, None), (1001, ""), (1002, "q" + "y" * 300_000), (1003, "y" * 100)]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_removal(rows)


def test_interval_tree():
    suffix = sorted("banana"[k:] for k in range(6))
    lcp = [suffixes._common(a.encode(), b.encode()) for a, b in itertools.pairwise(suffix)]
    assert set(suffixes.lcp_intervals(lcp, 1)) == {(1, 2, 3, 1), (0, 2, 1, 0), (4, 5, 2, 0)}


def test_maximal_repeats_have_all_occurrences():
    left, core = b"L" * 50, b"c" * 40
    contexts = [(left, core + b"r" * 60), (b"M" + left[1:], core + b"r" * 60), (left, core + b"s" * 60)]
    found = {(tuple(sorted(m)), a, b) for m, a, b in suffixes.maximal_repeats(contexts)}
    assert ((0, 1), 0, 0) in found and any(set(m) == {0, 1} and a <= 49 <= b for m, a, b in found)
    assert all(set(m) != {0, 2} or a >= 60 for m, a, b in found)


def test_repeat_frames(spark, odd, empty):
    got = suffixes.remove_repeats(odd, carry=("lang", "Extra col")).collect()
    assert len(got) == len(ODD) and {r.doc_id: r.kept_text for r in got}[1] is None
    assert suffixes.remove_repeats(empty).count() == 0
    twice = spark.createDataFrame([(1, "p" * 150), (1, "q" * 150), (2, "p" * 120)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in suffixes.remove_repeats(twice).collect()) == [(1, 0), (1, 149), (2, 120)]  # the first window of a run stays


def test_outliers_do_not_slow_a_group_down():
    """Near-copies behind outliers, and several families, are compared with few documents."""
    import time

    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 60, 80, dtype=np.uint64)
    sets = [np.unique(rng.integers(0, 1 << 60, 60, dtype=np.uint64)) for _ in range(5)]
    for _ in range(20_000):
        own = base.copy()
        own[rng.integers(0, 80, 3)] = rng.integers(0, 1 << 60, 3, dtype=np.uint64)
        sets.append(np.unique(own))
    start = time.perf_counter()
    found = neardup.group_components(neardup.SetIndex(sets))
    assert time.perf_counter() - start < 10 and found[:5].tolist() == [0, 1, 2, 3, 4] and (found[5:] == 5).all()


def test_families_that_touch_equal_brute_force():
    rng = np.random.default_rng(12)
    for _ in range(60):
        base, sets = rng.integers(0, 1 << 60, 40, dtype=np.uint64), []
        for _ in range(rng.integers(2, 6)):
            kin = base.copy()
            kin[rng.integers(0, 40, rng.integers(2, 14))] = rng.integers(0, 1 << 60, 1, dtype=np.uint64)
            for _ in range(rng.integers(1, 25)):
                own = kin.copy()
                own[rng.integers(0, 40, rng.integers(0, 4))] = rng.integers(0, 1 << 60, 1, dtype=np.uint64)
                sets.append(np.unique(own))
        rng.shuffle(order := np.arange(len(sets)))
        sets = [sets[k] for k in order]
        root = list(range(len(sets)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in itertools.combinations(range(len(sets)), 2):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
        assert neardup.group_components(neardup.SetIndex(sets)).tolist() == [find(k) for k in range(len(sets))]


def test_texts_under_one_id_are_documents_of_their_own(spark):
    a, b = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen"
    df = spark.createDataFrame([(3, a, 1), (5, a, 1), (5, b, 2), (9, b, 3), (9, b, 3), (11, None, 4), (None, a, 5), (12, "", 6), (12, "", 6)], "doc_id long, text string, component int")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(3, 3, True), (5, 3, False), (5, 5, True), (9, 5, False), (9, 5, False), (11, 11, True), (None, None, True), (12, 12, True), (12, 12, True)], key=repr)
    left = neardup.unlike(df)
    assert left.columns == df.columns
    assert sorted(map(tuple, left.collect()), key=repr) == sorted([(3, a, 1), (5, b, 2), (11, None, 4), (None, a, 5), (12, "", 6), (12, "", 6)], key=repr)
    again = spark.createDataFrame([(7, a, 1), (7, a, 2), (7, a + " x", 3), (8, a, 4)], "doc_id long, text string, n int")
    assert [r.doc_id for r in neardup.unlike(again).collect()] == [7]


def test_hot_groups_meet_where_they_are(spark):
    from glyphmill.llm import common

    rows = spark.range(5000).selectExpr("id", "case when id % 3 = 0 then 0 else id end as k")
    groups = rows.groupBy("k").agg(F.min("id").alias("m"), F.count("*").alias("n"))
    got = common.join_groups(rows, groups, ["k"], 5000)
    assert got.count() == 5000 and got.where("m <> case when k = 0 then 0 else id end").isEmpty()


def test_clashing_columns(spark):
    names = ["score", "mixture", "lang_pred", "slot", "block", "place", "key", "rank", "position", "id", "t", "component", "kept", "n_bytes", "row", "kept_text", "held_out", "hash", "bucket"]
    docs = spark.range(40).selectExpr("id as doc_id", "concat('some words of a text ', id) as text", "'en' as lang", "concat('s', id % 3) as source", "9L as n_chars", *[f"{k} as `{n}`" for k, n in enumerate(names)])
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality", "1 as score")
    path, pattern, words = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("word_bpe_49k.json")
    for df in (
        langmix.identify(docs), langmix.predict(docs, langmix.learn(docs)), pfair.mix(docs), neardup.near_duplicates(docs), neardup.unlike(docs), suffixes.remove_repeats(docs), suffixes.remove_repeats(docs, carry=("lang", "source")),
        licences.scan(docs, licences.known(spark)), qualityforest.judge(docs, qualityforest.learn(docs, labels)), bpe.round_trip(docs, path, pattern), bpe.encode(docs, path, pattern),
        tokenfiles.digest(tokenfiles.write(docs, lambda: tokenfiles.word_tokenizer(words).encode, 2)), tiff.features(tiff.pages(tiff.store_texts(docs), keep=("row", "doc_id", "n_bytes", "media_bytes", "media_sha256"))),
    ):
        assert df.count() == 40
    mixed = pfair.mix(docs)
    assert mixed.where("slot = 3 and block = 4 and place = 5").count() < 40 and mixed.select("key").distinct().count() == 1


def test_many_sources_and_rows_without_ids(spark):
    counts = spark.range(1_000_000, 1_000_003).selectExpr("concat('=', id) as key", "1L as n")
    shared = pfair.shares(counts, "n").selectExpr("keys", "c", "n", "cycle")
    assert sorted(r.slot_in_cycle for r in pfair.cycle(shared).collect()) == [0, 1, 2]
    rows = spark.range(3000).selectExpr("case when id % 3 > 0 then id end as doc_id", "concat('s', id % 2) as source", "id as n")
    got = pfair.mix(rows, block_docs=1).collect()
    assert len({r.slot for r in got}) == 3000 and got == pfair.mix(rows, block_docs=1).collect()


def test_wide_vocabularies(spark, empty):
    docs = spark.createDataFrame([(1, "x"), (2, "y"), (2, "x")], "doc_id long, text string")
    encoder = lambda: lambda texts: [np.array([70_000, 5], "<u4") for _ in texts]
    got = tokenfiles.digest(tokenfiles.write(docs, encoder, 2, largest_id=70_000)).orderBy("start").collect()
    want = zlib.crc32(np.array([70_000, 5, 2], "<u4").tobytes())
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == [(1, 0, 3, want), (2, 3, 3, want), (2, 6, 3, want)]
    with pytest.raises(Exception, match="doesn't fit"):
        tokenfiles.write(docs, encoder, 2, largest_id=60_000)
    with pytest.raises(OverflowError):
        tokenfiles.width_of(1 << 32)


def _tiff_of(tags, order="<"):
    import struct

    out = b"II" + struct.pack("<HI", 42, 8) + struct.pack("<H", len(tags))
    for tag, value in sorted(tags.items()):
        out += struct.pack("<HHII", tag, 4, 1, value)
    return out + bytes(4) + b"\0" * 64


def test_headers_that_lie_give_errors(spark):
    lies = [
        _tiff_of({tiff.WIDTH: 64, tiff.HEIGHT: 64, tiff.BITS: 8, tiff.TILE_OFFSETS: 8, tiff.TILE_BYTES: 9}),
        _tiff_of({tiff.WIDTH: 2_000_000, tiff.HEIGHT: 2_000_000, tiff.BITS: 8, tiff.STRIP_OFFSETS: 8, tiff.STRIP_BYTES: 9}),
        _tiff_of({tiff.WIDTH: 2_000_000, tiff.HEIGHT: 2_000_000, tiff.BITS: 8, tiff.STRIP_ROWS: 1, tiff.STRIP_OFFSETS: 8, tiff.STRIP_BYTES: 9}),
        _tiff_of({tiff.WIDTH: 4, tiff.HEIGHT: 4, tiff.BITS: 8, tiff.SAMPLES: 0, tiff.STRIP_OFFSETS: 8, tiff.STRIP_BYTES: 9}),
        _tiff_of({tiff.WIDTH: 4, tiff.HEIGHT: 4, tiff.BITS: 8, tiff.TILE_WIDTH: 4_000_000_000, tiff.TILE_HEIGHT: 1, tiff.TILE_OFFSETS: 8, tiff.TILE_BYTES: 9}),
    ]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lies)], "doc_id long, media binary")
    got = tiff.pages(df, keep=("doc_id",)).collect()
    assert len(got) == len(lies) and all(r.error and r.pixels is None for r in got)


def repeated_rows(seed, count=120):
    random.seed(seed)
    passages = ["".join(random.choices("ab é", k=260)) for _ in range(4)]
    pieces = [lambda: random.choice(passages)[random.randint(0, 120) :][: random.randint(90, 220)], lambda: "".join(random.choices("abcd", k=random.randint(0, 90))), lambda: "ab" * random.randint(0, 90)]
    return [(i * 7 % 181, "".join(random.choice(pieces)() for _ in range(random.randint(0, 4)))) for i in range(count)]


def test_colliding_hashes_remove_nothing_that_differs(spark, monkeypatch):
    """Hashes of a few bits bring unlike texts together all the time; bytes and digests still tell them apart."""
    whole = suffixes.gram_hashes
    monkeypatch.setattr(suffixes, "gram_hashes", lambda data: (whole(data) & np.uint64(0b11)) << np.uint64(40))
    monkeypatch.setattr(suffixes, "context_hashes", lambda grams, lo, hi: np.zeros(len(lo), np.uint64))
    for hot in (4000, 5):
        monkeypatch.setattr(suffixes, "HOT_CONTEXTS", hot)
        rows = repeated_rows(13, 60)
        got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_removal(rows)


def test_an_anchor_with_very_many_contexts(spark, monkeypatch):
    """100,000 contexts of one anchor, a third of them within windows that repeat."""
    monkeypatch.setattr(suffixes, "HELD_WINDOWS", 5000)
    random.seed(14)
    head = "".join(random.choices("abcdefgh", k=60))
    rows = [(i, head + (f"{i:06d}" * 7 if i % 3 else "same " * 8 + f"{i:06d}")) for i in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = suffixes.remove_repeats(df).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_removal(rows)


def test_hot_anchors_are_found_whatever_the_tasks(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT_CONTEXTS", 50)
    random.seed(17)
    heads = ["".join(random.choices("abcdefgh", k=80)) for _ in range(6)]
    rows = [(i, heads[i % 6] + f"{i:05d}" * 20) for i in range(1800)]
    for parts in (1, 7):
        hot, total = suffixes._hot_anchors(spark.createDataFrame(rows, "id long, text string").repartition(parts))
        assert len(hot) and total >= 1800


def brute_groups(rows):
    texts = {i: t.encode() for i, t in rows}
    windows, groups = collections.defaultdict(list), collections.defaultdict(set)
    for i, raw in texts.items():
        for k in range(len(raw) - 99):
            windows[raw[k : k + 100]].append((i, k))
    strings = set()
    for places in windows.values():
        for (i, a), (j, b) in itertools.combinations(places, 2):
            x, y = texts[i], texts[j]
            if a and b and x[a - 1] == y[b - 1]:
                continue  # seen from the window before
            n = 100
            while a + n < len(x) and b + n < len(y) and x[a + n] == y[b + n]:
                n += 1
            strings.add(x[a : a + n])
    for s in strings:
        for i, raw in texts.items():
            at = raw.find(s)
            while at >= 0:
                groups[s].add((i, at))
                at = raw.find(s, at + 1)
    return sorted((len(s), sorted(p)) for s, p in groups.items())


def test_repeat_groups_equal_brute_force(spark):
    for seed in (15, 16):
        rows = repeated_rows(seed, 40)
        rows = list(dict(rows).items()) + [(900, rows[3][1]), (901, "only " * 60)]
        found = suffixes.repeat_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        groups = collections.defaultdict(list)
        for r in found:
            assert not r.cut
            groups[r["repeat"], r.n_bytes, r.occurrences].append((r.doc_id, r.start))
        assert all(len(p) == n == len(set(p)) for (_, _, n), p in groups.items())
        assert sorted((n, sorted(p)) for (_, n, _), p in groups.items()) == brute_groups(rows)
    long = "".join(random.choices("abcdefgh", k=600))
    cut = suffixes.repeat_groups(spark.createDataFrame([(1, long), (2, "x" + long)], "doc_id long, text string"), reach=300).collect()
    assert {r.cut for r in cut} == {True} and all(r.occurrences == 2 for r in cut)
    assert suffixes.repeat_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
