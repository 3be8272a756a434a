"""Ranked search, fingerprints and periodic runs against brute force, and on odd rows."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest

from glyphmill.llm import fingerprints, lexical, periodic, queries
from tests.llm.test_small import DOCS, ODD

DATA = "/root/testdata/sf0.001"
TERM, WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---- ranked search

def brute_search(docs, items, top=10):
    counts = [(i, collections.Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counts:
            m = 25 + 75 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in TERM.findall((text or "").translate(LOWER)) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def text_of(rng, vocabulary, n):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def test_terms_are_the_patterns_matches():
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choices("aZ09É日\x00\x7f\x80  _-[`{@/:\n", k=rng.randint(0, 40)))
        assert [t.decode() for t in lexical.terms_of(text.encode())] == TERM.findall(text.translate(LOWER))


@pytest.mark.parametrize("block, short", [(4, 16), (16, 3), (512, 10**9), (8, 0)])
def test_a_segments_best_equal_all_scores(monkeypatch, block, short):
    """Blocks, short lists and skipping change nothing: also with many equal scores and a bound from before."""
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "SHORT", short)
    rng = random.Random(block + short)
    vocabulary = [f"w{int(rng.paretovariate(0.6))}" for _ in range(80)]
    texts = [text_of(rng, vocabulary, rng.randint(1, 30)).encode() for _ in range(120)]
    texts += [texts[3]] * 30
    numbers = lexical.Numbers()
    found = [np.fromiter(map(numbers.__getitem__, lexical.terms_of(t)), np.int32) for t in texts]
    ids = rng.sample(range(1000), len(texts))
    row = lexical._segment(ids, found, numbers)
    lists = {name: row.column(name).flatten() for name in ("ids", "lengths", "terms", "counts", "gaps", "tfs")}
    n_terms = int(row.column("n_terms")[0].as_py())
    segment = lexical.Segment(ids, *(lists[c].to_numpy() if c != "terms" else lists[c] for c in ("lengths", "terms", "counts", "gaps", "tfs")), len(texts), n_terms)
    for _ in range(60):
        asked = [(numbers[w.encode()], rng.randint(1, 9)) for w in set(rng.choices(vocabulary, k=rng.randint(1, 12))) if w.encode() in numbers]
        scores = {}
        for t, w in asked:
            p = segment.postings(t)
            for d, part in zip(p.docs.tolist(), p.parts.tolist(), strict=True):
                scores[d] = scores.get(d, 0) + w * part
        for least in (1, sorted(scores.values())[len(scores) // 2]):
            want = sorted((-s, ids[d], d) for d, s in scores.items() if s >= least)[:10]
            docs, got = segment.best(asked, least, 10)
            assert list(zip((-got).tolist(), docs.tolist(), strict=True)) == [(s, d) for s, _, d in want]


def test_search_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(60)] + ["É", "日本"]
    docs = [(k, text_of(rng, vocabulary, rng.randint(0, 25))) for k in range(150)] + [(1000 + k, "w1 w2 w2") for k in range(20)]
    items = [(k, text_of(rng, vocabulary, rng.randint(0, 12))) for k in range(30)] + [(7, "nowhere"), (8, None), (9, "")]
    index = lexical.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    got = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"))
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_search(docs, items)


def test_search_of_odd_rows(spark, odd, empty):
    items = [(1, "same WORDS here"), (1, "same words here"), (None, "text of more than five words, x"), (3, None), (4, "é\U0001f600 x")]
    asked = spark.createDataFrame([(i, t, 5, "z") for i, t in items], "item_id long, text string, rank int, doc_id string")
    got = lexical.search(lexical.build(odd), asked).collect()
    assert sorted(map(tuple, got), key=repr) == brute_search([(r[0], r[1]) for r in ODD], items)
    assert lexical.search(lexical.build(empty), asked).count() == 0
    assert lexical.search(lexical.build(odd), asked.limit(0)).count() == 0


# ---- fingerprints

def test_spans_and_extensions():
    rng = random.Random(2)
    for _ in range(60):
        a, b = ("".join(rng.choices("ab", k=rng.randint(0, 40))) * rng.randint(1, 3) for _ in range(2))
        x, y = (fingerprints.PrefixHashes(fingerprints.points(t)) for t in (a, b))
        for _ in range(30):
            i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
            want = 0
            while i + want < len(a) and j + want < len(b) and a[i + want] == b[j + want]:
                want += 1
            assert x.extension(i, y, j) == want
            n = rng.randint(0, min(len(a) - i, len(b) - j))
            assert (x.span(i, i + n) == y.span(j, j + n)) == (a[i : i + n] == b[j : j + n])


def test_hashes_do_not_depend_on_how_they_are_made(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choices("abcdefgh é日", k=3000))
    whole = fingerprints.PrefixHashes(fingerprints.points(text))
    monkeypatch.setattr(fingerprints, "CHUNK", 97)
    pieces = fingerprints.PrefixHashes(fingerprints.points(text[:1000])).with_end(700, fingerprints.points(text[700:]))
    assert all((s == t).all() for s, t in zip(whole.sums, pieces.sums, strict=True))
    print_of = lambda h, cut: fingerprints.fingerprint(h, np.minimum(h.least(0, cut), h.least(cut, h.n)))
    assert print_of(pieces, 5) == print_of(whole, 1234) == fingerprints.Hashed(1, text).fingerprint
    for text in ("", "a", "short", "exactly 12 c", "x" * 300):
        for following in ("", "b", "something else that is longer than all"):
            h = fingerprints.Hashed(1, text)
            edited = text[: h.cut] + following[: h.end]
            assert h.edited(following, h.fingerprint)[4] == fingerprints.Hashed(2, edited).fingerprint


def test_likeness_is_the_share_of_common_spans():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(3000)]
    for share in (0, 0.3, 0.6, 0.9):
        a = " ".join(rng.sample(words[:1500], 400))
        keep = int(len(a) * share)
        b = a[:keep] + " ".join(rng.sample(words[1500:], 400))[: len(a) - keep]
        spans = [{t[i : i + 12] for i in range(len(t) - 11)} for t in (a, b)]
        exact = 2 * len(spans[0] & spans[1]) / (len(spans[0]) + len(spans[1]))
        assert abs(fingerprints.likeness(*(fingerprints.Hashed(0, t).fingerprint for t in (a, b))) - exact) < 0.13
    one = fingerprints.Hashed(0, "abc").fingerprint
    assert fingerprints.likeness(one, fingerprints.Hashed(0, "abc").fingerprint) == 1 and fingerprints.likeness(one, fingerprints.Hashed(0, "").fingerprint) == 0


def brute_edits(rows):
    """Rows in their order: digests of the edited texts and lengths of common prefixes."""
    out = []
    for k, (i, text) in enumerate(rows):
        end = len(text) // 3
        edited = text[: len(text) - end] + rows[(k + 1) % len(rows)][1][:end]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), len(os.path.commonprefix([text, edited]))))
    return sorted(out)


def test_edits_equal_brute_force(spark):
    """Over all documents, dealt over many parts, some of them empty; equal texts have equal fingerprints, edited ones are near."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for parts in ("1", "13", "400"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = fingerprints.edits(docs).collect()
            assert sorted((r.doc_id, r.n_chars, r.edited_sha256, r.common_prefix) for r in got) == brute_edits(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, queries.op12_prefix_hashes(spark, DATA).collect())) == sorted(map(tuple, got))
    texts = dict(rows)
    prints = {(texts[r.doc_id], r.fingerprint) for r in got}
    assert len(prints) == len({t for t, _ in prints}) == len({p for _, p in prints})
    by_id = {r.doc_id: r for r in got}
    spans = lambda t: {t[k : k + 12] for k in range(max(1, len(t) - 11))} - {""}
    share = lambda a, b: 2 * len(a & b) / (len(a) + len(b)) if a or b else 1
    errors = []
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        edited = text[: len(text) - len(text) // 3] + following[: len(text) // 3]
        errors += [by_id[i].near_edited - share(spans(text), spans(edited)), by_id[i].near_next - share(spans(text), spans(following))]
    assert max(map(abs, errors)) < 0.25 and abs(sum(errors)) / len(errors) < 0.01
    for (i, _), (j, _) in zip(rows, rows[1:] + rows[:1], strict=True):
        assert by_id[i].near_next == fingerprints.likeness(by_id[i].fingerprint, by_id[j].fingerprint)
        assert by_id[i].near_edited == fingerprints.likeness(by_id[i].fingerprint, by_id[i].edited_fingerprint)


def test_edits_of_odd_rows(spark, odd, empty):
    order = sorted(((r[0], r[1] or "") for r in ODD if r[0] is not None), key=lambda r: -r[0])
    order += [(None, ODD[2][1])]
    got = fingerprints.edits(odd).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256, r.common_prefix) for r in got) == brute_edits([(-1 if i is None else i, t) for i, t in order])
    assert fingerprints.edits(empty).count() == 0
    alone = fingerprints.edits(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert [(r.n_chars, r.edited_sha256, r.near_next) for r in alone] == [(6, hashlib.sha256(b"abcdab").hexdigest(), 1.0)]
    same = spark.createDataFrame([(1, "one and the same text", 3, "x")] * 5 + [(1, "another text", 4, "y")], "doc_id long, text string, n_chars int, part string")
    assert sorted(r.n_chars for r in fingerprints.edits(same).collect()) == [12] + [21] * 5


# ---- periodic runs

def brute_runs(words, least=24):
    """All maximal stretches with a period, by comparing the words at each distance; those that a smaller period explains go."""
    n, found = len(words), set()
    for q in range(1, n // 3 + 1):
        start = 0
        for j in range(n - q + 1):
            if j == n - q or words[j] != words[j + q]:
                if j - start + q >= max(least, 3 * q):
                    found.add((start, j - start + q, q))
                start = j + 1
    return sorted(x for x in found if not any(y[2] < x[2] and y[0] <= x[0] and sum(y[:2]) >= sum(x[:2]) for y in found))


def test_runs_equal_brute_force():
    rng = random.Random(6)
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 150:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    texts = [list(fibonacci[-1]), list("abab" * 3 + "abc" * 20 + "cab" * 9), ["a"] * 100, []]
    for _ in range(400):
        text = []
        while len(text) < rng.randint(0, 120):
            root = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(1, 12))]
            text += root * rng.randint(1, 7) + root[: rng.randint(0, len(root))]
        texts.append(text)
    for least in (24, 3):
        for k in range(0, len(texts), 50):
            some = texts[k : k + 50]
            words = np.array([ord(c) for t in some for c in t], np.int64)
            starts = np.cumsum([0] + [len(t) for t in some])
            got = periodic.runs(words, np.repeat(np.arange(len(some)), [len(t) for t in some]), least=least).tolist()
            assert got == [[s + int(begin), length, q] for t, begin in zip(some, starts, strict=False) for s, length, q in brute_runs(t, least)]
    with pytest.raises(ValueError):
        periodic.runs(words, words, periods=2)


def test_long_keys_are_sorted_too():
    keys = np.array([5, 1, 5, 0, 1 << 61, 1], np.int64)
    assert periodic._in_order(keys, 1 << 62).tolist() == [3, 1, 5, 0, 2, 4]


def brute_collapse(doc, text, plant=True):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc).encode()), len(words)
    if plant and doc is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    digests = (hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{length},{q}\n" for s, length, q in found), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return doc, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *digests


def test_collapsed_texts_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    short = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 6000]
    got = {r.doc_id: tuple(r) for r in queries.op13_periodic_runs(spark, DATA).collect()}
    assert len(got) == 200 and len(short) > 150
    assert all(got[i] == brute_collapse(i, t) for i, t in short)


def test_collapse_of_odd_rows(spark, odd, empty):
    got = periodic.collapse(odd, periodic.planted).collect()
    want = [brute_collapse(r[0], r[1]) for r in ODD if len(r[1] or "") < 1000]
    assert sorted(map(repr, map(tuple, (r for r in got if r.doc_id != 4)))) == sorted(map(repr, want))
    (hot,) = (r for r in got if r.doc_id == 4)
    assert hot[1:6] == (1, 0, 30_000, 1, 30_000_000)
    assert periodic.collapse(empty).count() == 0
    plain = periodic.collapse(odd).collect()
    assert sorted(map(repr, map(tuple, (r for r in plain if r.doc_id != 4)))) == sorted(repr(brute_collapse(r[0], r[1], plant=False)) for r in ODD if len(r[1] or "") < 1000)
