"""Keys and references, and metres, against plain versions."""

import random
import re

import pytest

from glyphmill.operators import keys, metres, nodes


def tree(spark, *texts):
    return nodes.nodes(spark.createDataFrame(list(enumerate(texts)), "d long, x string"), "d", "x")


def test_references_and_vocabularies(spark):
    x = "<T><a xml:id='k1' spanTo='#k2 #k1 #nowhere plain'><b xml:id='k2' copyOf='#k1 #k3'/></a><c xml:id='k3' copyOf='#k2' spanTo='#k2'/><c xml:id='k3'/><rs type='month' key='magha  may'/><rs key='may'/><note source='bib:A bib:Z x'/></T>"
    bibliography = spark.createDataFrame([("bibliography", "A"), ("bibliography", "A"), ("other", "Z")], "of string, key string")
    lists = spark.createDataFrame(keys.VOCABULARIES, "list string, value string")
    got = {(r.doc_id, r.rule, r.token) for r in keys.violations(tree(spark, x, x.replace("k3", "k4"), "<T/>"), keys.EDITION_KEYS, lists, bibliography).where("doc_id = 0").collect()}
    assert got == {
        (0, "an identifier stands once", "k3"),
        (0, "the element indicated by spanTo must follow", "#k1"), (0, "the element indicated by spanTo must follow", "#nowhere"), (0, "the element indicated by spanTo must follow", "#k2"),
        (0, "the element that is copied must precede", "#k1"), (0, "the element that is copied must precede", "#k3"),
        (0, "a month has one of the twelve names", "may"), (0, "a source must be in the bibliography", "bib:Z"),
    }
    assert keys.violations(tree(spark, "<T/>"), keys.EDITION_KEYS).count() == 0


def test_a_node_inside_neither_follows_nor_precedes(spark):
    inside = tree(spark, "<a spanTo='#b'><b xml:id='b'/></a>", "<a xml:id='b'><c copyOf='#b'/></a>", "<a spanTo='#b'/>")
    assert keys.violations(inside, keys.EDITION_KEYS).count() == 3
    around = tree(spark, "<t><a spanTo='#b'/><b xml:id='b'/></t>", "<t><a xml:id='b'/><c copyOf='#b'/></t>")
    assert keys.violations(around, keys.EDITION_KEYS).count() == 0


def plain_best(verse, listed):
    fits = []
    for name, pattern in listed:
        rule = "".join({"+": r"\+", "-": "-", "=": "[-+]", "2": r"(?:--|\+)"}[c] for c in pattern)
        if verse and pattern and re.fullmatch(rule, verse):
            fits.append((sum(c in "=2" for c in pattern), name))
    return min(fits, default=None)


def test_metres_equal_every_pattern_tried():
    rng = random.Random(9)
    listed = [(f"m{k}", "".join(rng.choices("+-=2", k=rng.randint(0, 8)))) for k in range(300)] + [("all", "=" * 6), ("a", "22"), ("b", "=2")]
    trie = metres.Trie(listed)
    for _ in range(1500):
        verse = "".join(rng.choices("+-", k=rng.randint(0, 9)))
        assert trie.best(verse) == plain_best(verse, listed)


@pytest.mark.parametrize("bound", [100_000, 3])
def test_metre_frames(spark, monkeypatch, bound):
    monkeypatch.setattr(metres, "BROADCAST_METRES", bound)
    rng = random.Random(1)
    listed = [(f"m{k}", "".join(rng.choices("+-=2", k=4))) for k in range(12)] + [(None, "++"), ("none", None), ("odd", "x"), ("paused", "+|-/ ==")]
    verses = [(k, "".join(rng.choices("+-", k=4))) for k in range(40)] + [(90, None), (91, ""), (92, "+-|+/+"), (93, "no")]
    got = metres.metre_of(spark.createDataFrame(verses, "v long, p string"), spark.createDataFrame(listed, "name string, pattern string"), "v", "p").collect()
    known = [(n, p.translate(str.maketrans("", "", metres.PAUSES))) for n, p in listed if n and p and p != "x"]
    want = {(k, plain_best((p or "").translate(str.maketrans("", "", metres.PAUSES)), known)) for k, p in verses}
    assert {(r.v, (r.free, r.metre)) for r in got} == {(k, b) for k, b in want if b}
