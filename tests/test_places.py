"""Places from marks, first rules and serialised trees against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import cover, dispatch, nodes, serialise

DATA = "/root/testdata/sf0.001"


def tree(spark, texts, parts=4):
    return nodes.nodes(spark.createDataFrame(list(enumerate(texts)), "d long, x string").repartition(parts), "d", "x")


def plain_places(events):
    """(page, line, cell) of each text: marks are ('page' | 'line' | 'cell', n), texts strings."""
    out, at, label = [], [0, 0, 0], ["", "", ""]
    units = ("page", "line", "cell")

    def start(level, n=""):
        at[level] += 1
        label[level] = n

    # Blank texts after or between marks, or before all texts, go behind the marks.
    moved, group, spoken = [], [], False
    for e in [*events, None]:
        if e is None or isinstance(e, str) and e.strip():
            keep = next((k for k, x in enumerate(group) if not isinstance(x, str)), len(group)) if spoken else 0
            moved += group[:keep] + [x for x in group[keep:] if not isinstance(x, str)] + [x for x in group[keep:] if isinstance(x, str)]
            moved += [e] if e else []
            group, spoken = [], True
        else:
            group.append(e)
    events = moved
    # Marks up to the next text that isn't blank stand together.
    stuck = []
    for k, e in enumerate(events):
        following = next((x for x in events[k + 1 :] if not isinstance(x, str) or x.strip()), None) if not isinstance(e, str) else None
        stuck.append(following[0] if following is not None and not isinstance(following, str) else None)
    first = next((e for e in events if not isinstance(e, str) or e.strip()), None)
    begins = first[0] if first is not None and not isinstance(first, str) else None
    if events:
        if begins != "page":
            start(0)
        if begins in (None, "cell"):
            start(1)
        if begins is None:
            start(2)
    for e, following in zip(events, stuck, strict=True):
        if isinstance(e, str):
            out.append((*at, *label, e))
            continue
        unit, n = e
        start(units.index(unit), n)
        if unit == "page" and following != "line":
            start(1)
            if following != "cell":
                start(2)
        if unit == "line" and following != "cell":
            start(2)
    return out


def test_every_text_has_its_places(spark):
    rng = random.Random(8)
    docs, texts = [], []
    for _ in range(120):
        events = []
        for _ in range(rng.randint(0, 14)):
            kind = rng.choice(["page", "line", "cell", "text", "text", "blank"])
            n = rng.choice(["", "1", "b"])
            if kind in ("text", "blank"):
                new = rng.choice(["x", "yy "]) if kind == "text" else " \n"
                if events and isinstance(events[-1], str):
                    events[-1] += new
                else:
                    events.append(new)
            else:
                events.append((kind, n))
        docs.append(events)
        tag = {"page": "<pb{}/>", "line": "<lb{}/>", "cell": "<milestone{}/>"}
        texts.append("<TEI><pb/><div type='edition'>" + "".join(e if isinstance(e, str) else tag[e[0]].format(f" n='{e[1]}'" if e[1] else "") for e in events) + "<note>n<lb/></note></div>out<lb/></TEI>")
    got = cover.text_places(tree(spark, texts)).orderBy("doc_id", "pre").collect()
    want = [(i, *row) for i, events in enumerate(docs) for row in plain_places(events)]
    assert [(r.doc_id, r.page, r.line, r.cell, r.page_n, r.line_n, r.cell_n, r.data) for r in got] == want
    for r in cover.cells(tree(spark, texts)).collect():
        whole = "".join(e for e in docs[r.doc_id] if isinstance(e, str))
        own = [(x.page, x.line, x.page_n, x.line_n, x.cell_n) for x in got if (x.doc_id, x.cell) == (r.doc_id, r.cell)]
        assert whole[r.start : r.stop] == r.text and set(own) <= {(r.page, r.line, r.page_n, r.line_n, r.cell_n)} and r.page and r.line


PATTERNS = ["/html/head", "head/title", "li/a", "ul/li", "div//p", "article//a", "html//li/a", "p", "a", "body/*", "*"]


def test_first_rules_equal_single_patterns(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    rows = nodes.nodes(pages, "page_id", "html", tolerant=True).cache()
    found = nodes.XPath(rows)
    want = {}
    for i, p in enumerate(PATTERNS):
        for r in found.matches(p).where("kind = 'tag'").collect():
            want.setdefault((r.doc_id, r.pre), i)
    got = {(r.doc_id, r.pre): r.rule for r in dispatch.first_rules(rows, PATTERNS).collect()}
    assert got == want and len(set(want.values())) > 6


def test_rules_with_tests_of_attributes(spark):
    x = "<a k='1'><b/><b k='2'><c/></b><a><b k='2'><d><c m='x'/></d></b></a></a>"
    rows = tree(spark, [x])
    rules = ["/a[@k='1']/b[not(@k)]", "a/a", "b[@k=\"2\"]//c[@m]", "b[@k]/c", "/a"]
    assert [(r.name, r.rule) for r in dispatch.first_rules(rows, rules).orderBy("pre").collect()] == [("a", 4), ("b", 0), ("c", 3), ("a", 1), ("c", 2)]
    for bad in ("", "a//", "a[b]", "a[@k", "[@k]"):
        with pytest.raises(dispatch.PatternError):
            dispatch.parse(bad)


def test_serialised_pages_parse_to_equal_rows(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    # Raw text elements have no escapes in pages, and names that are none in XML can't be read back.
    rows = nodes.nodes(pages, "page_id", "html", tolerant=True).cache()
    fit = rows.groupBy("doc_id").agg(F.max(F.coalesce(F.exists(F.map_keys("attrs"), lambda k: ~k.rlike(r"^[A-Za-z_][\w.-]*$")), F.lit(False)) | F.coalesce(~F.col("name").rlike(r"^[A-Za-z_][\w.-]*$"), F.lit(False))).alias("odd")).where("not odd")
    before = rows.join(fit.select("doc_id"), "doc_id")
    out = serialise.serialise(before)
    again = nodes.nodes(out.select("doc_id", F.concat(F.lit("<root>"), "xml", F.lit("</root>")).alias("x")), "doc_id", "x")
    kept = ["doc_id", "kind", "name", "data"]
    key = lambda df, shift: sorted((r.doc_id, r.pre - shift, r.kind, r.name, tuple(sorted((r.attrs or {}).items())), r.data) for r in df.where("kind <> 'tree'").select("pre", "attrs", *kept).collect() if not (shift and r.pre == 1))
    assert fit.count() > 10 and key(again, 1) == key(before, 0)


def test_serialised_subtrees(spark):
    x = "<a>t<b k='&lt;&quot;'><c/>&amp;<?p q?></b><!--n--><b/></a>"
    rows = tree(spark, [x, "<a/>", "<a"])
    got = serialise.serialise(rows, rows.where("name = 'b'")).orderBy("pre").collect()
    assert [r.xml for r in got] == ['<b k="&lt;&quot;"><c></c>&amp;<?p q?></b>', "<b></b>"]
    assert {r.doc_id: r.xml for r in serialise.serialise(rows).collect()} == {0: '<a>t<b k="&lt;&quot;"><c></c>&amp;<?p q?></b><!--n--><b></b></a>', 1: "<a></a>"}
