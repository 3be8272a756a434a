"""Passes over trees: languages against a recursion, deep trees, many documents in a part."""

import random
import time

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import nodes, tours, trees

LANGUAGES = [("san", "sanskrit", True), ("tam", "tamil", True), ("eng", "eng", False), ("fra", "fra", False)]
SCRIPTS = [("x", "brahmi", True), ("y", "latin", False)]


def tree_of(rng, depth=0):
    """(name, attributes, children): children are texts and trees."""
    name = rng.choice(["p", "div", "q", "seg", "head", "foreign", "lem", "hi", "note"])
    attrs = {}
    if rng.random() < 0.4:
        attrs["xml:lang"] = rng.choice(["san", "tam-Latn", "eng", "fra", "zzz"])
    if rng.random() < 0.3:
        attrs["rendition"] = rng.choice(["class:x", "other class:y", "class:undetermined", "x"])
    if name == "div" and rng.random() < 0.5:
        attrs["type"] = "edition"
    children = []
    for _ in range(rng.randint(0, 3) if depth < 6 else 0):
        children.append(rng.choice(["text", " \n"]) if rng.random() < 0.4 else tree_of(rng, depth + 1))
    return name, attrs, children


def written(tree):
    if isinstance(tree, str):
        return tree
    name, attrs, children = tree
    return f"<{name}" + "".join(f' {k}="{v}"' for k, v in attrs.items()) + ">" + "".join(map(written, children)) + f"</{name}>"


def spoken(tree, above, out):
    """The recursion that the pass must equal; appends (name, value) in order of ends, returns what the tree tells its parent."""
    if isinstance(tree, str):
        return above if tree.strip() else None
    name, attrs, children = tree
    codes, classes = {c: (n, s) for c, n, s in LANGUAGES}, {c: (n, s) for c, n, s in SCRIPTS}
    lang, lang_source = codes.get(attrs.get("xml:lang", "").split("-")[0], (None, None))
    own = [w[6:] for w in attrs.get("rendition", "").split() if w.startswith("class:")] or ([attrs["rendition"]] if "rendition" in attrs else [])
    script, script_source = classes.get(own[-1] if own and own[-1] != "undetermined" else "", (None, None))
    value = above
    if name in trees.FORCED or name == "div" and attrs.get("type") == "edition":
        value = lang if lang_source else "source_other", script if script_source else "source_other", True
    elif name in trees.SENSITIVE and (lang or script):
        source = above[2] if lang is None else lang_source
        value = lang or above[0], script or (above[1] if source == above[2] else "source_other" if source else "latin"), source
    at = len(out)
    out.append(None)
    given = {v for v in (spoken(c, value, out) for c in children) if v is not None}
    if len({v[:2] for v in given}) == 1:
        value = min(given)
    out[at] = (name, *value)
    return None if name == "head" else value


def test_languages_equal_a_recursion(spark):
    rng = random.Random(4)
    docs = [("TEI", {}, [tree_of(rng) for _ in range(3)]) for _ in range(80)]
    tree = nodes.nodes(spark.createDataFrame([(i, written(t)) for i, t in enumerate(docs)], "d long, x string").repartition(7), "d", "x")
    got = trees.assigned_languages(tree, spark.createDataFrame(LANGUAGES, "code string, language string, is_source boolean"), spark.createDataFrame(SCRIPTS, "code string, script string, script_is_source boolean"))
    named = got.join(tree.select("doc_id", "pre", "name"), ["doc_id", "pre"]).orderBy("doc_id", "pre").collect()
    want = []
    for t in docs:
        out = []
        spoken(t, ("eng", "latin", False), out)
        want += out
    assert [(r.name, r.language, r.script, r.is_source) for r in named] == want


def test_deep_trees_take_one_pass(spark):
    deep = "".join(f'<p xml:lang="{"san" if k % 7 == 0 else "eng"}">' for k in range(60)) + "x" + "</p>" * 60
    tree = nodes.nodes(spark.createDataFrame([(i, f"<TEI>{deep}</TEI>") for i in range(2)], "d long, x string"), "d", "x").cache()
    tree.count()
    languages = spark.createDataFrame(LANGUAGES, "code string, language string, is_source boolean")
    scripts = spark.createDataFrame(SCRIPTS, "code string, script string, script_is_source boolean")
    trees.assigned_languages(tree, languages, scripts).count()
    start = time.perf_counter()
    rows = trees.assigned_languages(tree, languages, scripts).collect()
    assert time.perf_counter() - start < 10 and len(rows) == 122 and {r.language for r in rows} == {"eng"}
    held = trees.nearest_above(tree.where("kind = 'tag'").select("doc_id", "pre", "parent_pre", "level", "attrs"), F.when(F.col("level") % 10 == 2, F.col("level")), "near")
    assert all(r.near == (r.level - (r.level - 2) % 10 if r.level >= 2 else None) for r in held.collect())


def test_completed_languages(spark):
    x = "<d>a<p lang='san x'>b<q>c</q><npage lang='eng latin'>1<h lang='fra latin'>2</h><span class='fw-contents'>d<b>e</b></span></npage></p><r> </r><s><t lang='ta t'>f</t></s></d>"
    tree = nodes.nodes(spark.createDataFrame([(1, x), (2, "<d/>")], "d long, x string"), "d", "x")
    got = trees.completed_languages(tree).join(tree.select("doc_id", "pre", "name"), ["doc_id", "pre"]).orderBy("pre").collect()
    assert [(r.name, r.lang) for r in got] == [("d", "eng latin"), ("p", "san x"), ("q", "san x"), ("npage", "zxx latin"), ("h", "zxx latin"), ("span", "san x"), ("b", "san x"), ("t", "ta t")]


@pytest.mark.parametrize("docs", [[], [(1, "<a/>")]])
def test_small_passes(spark, docs):
    tree = nodes.nodes(spark.createDataFrame(docs, "d long, x string"), "d", "x")
    tags = tree.where("kind = 'tag'").select("doc_id", "pre", "parent_pre", "level", "name")
    assert trees.joined_above(tags, F.col("name"), ".").count() == len(docs)
    assert tours.down_and_up(tree, ["doc_id", "level", "pre"], "pre long", lambda a, r: None, lambda n: (None, (n.row[2],))).count() == 2 * len(docs)
