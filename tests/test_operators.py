"""Small cases with known results, and comparisons with plain Python."""

import collections
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.functions.collate import sort_columns
from glyphmill.operators import biblio, catalog, nodes, parallels, quality, relational
from glyphmill.sources import readers
from glyphmill.streaming.ingest import VersionedTable, ingest, routed, webhook_names


def column(spark, values, function, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(function(F.col("x"))).collect()]


def test_folding(spark):
    assert column(spark, ["Œuvre Đại", "süße", None, "  ÀB "], T.fold) == ["oeuvre dai", "susse", "", "ab"]
    assert T.fold_text(["a", "b"]) == "a!!!!!b"
    assert T.fold_passage_text("na-mo’pi") == "namoapi"
    assert T.clean_passage_text("[12 x] a_b, c'd") == "a b c’d"
    assert T.clean_file_text("﻿\na  \n\n") == "a\n"


def test_scripts_clusters_and_tamil(spark):
    clusters = {"a": (None, True), "ж": (None, False), "ә": (None, True), "Ә": (None, False), "கி": ("TAMIL", True), "తే": ("TELUGU", True), "ಕಿ": ("KANNADA", True), "ᬓᬶ": ("BALINESE", True), "कि": ("DEVANAGARI", True), "r̥": (None, True), "r̥̄": (None, True), "a̋": (None, False), "q̊": (None, False), "ə̄": (None, True), "कி": (None, False)}
    df = spark.createDataFrame(list(clusters.items()) and [(k,) for k in clusters], "c string")
    assert {r.c: (r.s, r.v) for r in df.select("c", T.script(F.col("c")).alias("s"), T.is_valid_cluster(F.col("c")).alias("v")).collect()} == clusters
    words = {"தமிழ்": "tamiḻ", "ஜி": "ji", "ஸ்ரீ": "srī", "ஃ": "ḥ", "ௐ": "oṃ", "௧௦ ௱": "10 100", "கை": "kai", "ஔ": "au", "க": "ka", "abc": "abc", "அக": "aka", "ஷஹஶ": "ṣahaśa", "ஂ": "ṃ", "": ""}
    df = spark.createDataFrame([(k,) for k in words], "c string")
    assert {r.c: r.l for r in df.select("c", T.tamil_to_latin(F.col("c")).alias("l")).collect()} == words
    T.register(spark)
    assert tuple(spark.sql("select jaccard('abcd', 'bcde'), jaccard('ab', 'x'), page_from_url('http://a/b?x=1&page=12'), format_url('/texts/%s', 'a b/é')").first()) == (1 / 3, 0.0, 12, "/texts/a%20b/%C3%A9")


def test_trigrams_and_jaccard(spark):
    assert column(spark, ["abcd", "ab", "", "aaaa"], T.trigrams) == [["abc", "bcd"], [], [], ["aaa"]]
    df = spark.createDataFrame([("abcd", "bcde"), ("ab", "ab")], "a string, b string")
    assert [r[0] for r in df.select(T.jaccard(T.trigrams(F.col("a")), T.trigrams(F.col("b")))).collect()] == [pytest.approx(1 / 3), 0.0]


def test_column_functions(spark):
    assert column(spark, [" a  b\n"], T.normalize_space) == ["a b"]
    assert column(spark, ["hello World x"], T.sentence_case) == ["Hello World x"]
    assert column(spark, ["Yes", "off", "?"], T.to_boolean) == [True, False, None]
    assert column(spark, ['<a b="&">'], T.quote_xml) == ["&lt;a b=&quot;&amp;&quot;&gt;"]
    assert column(spark, ["éx"], T.graphemes) == [["é", "x"]]
    assert column(spark, ["abc", "aXc", "abd"], lambda c: T.glob(c, "a[a-z]c")) == [True, False, False]


def test_collation(spark):
    df = spark.createDataFrame([("a-b",), ("ab",), ("a b",), ("Ab",), (None,), ("[]",), ("b",)], "x string")
    assert [r.x for r in df.orderBy(*sort_columns(F.col("x"))).collect()][:5] == ["a b", "a-b", "ab", "Ab", "b"]


def test_catalogue_language():
    parse = catalog.parse
    assert parse("stone AND seal") == [catalog.Term("stone"), catalog.Term("seal")]
    assert parse('title:"a \\" b" x') == [catalog.Term('a " b', "title"), catalog.Term("x")]
    for bad in ('"unterminated', ":x", "nofield:x", "x\\"):
        with pytest.raises(catalog.InvalidQuery):
            parse(bad)
    assert catalog.resolve_languages(parse("lang:fra lang:tamil lang:none"), {"fra": "fr"}, {"ta": ["old tamil"]}) == [catalog.Exact(("fr",), "lang"), catalog.Exact(("ta",), "lang"), catalog.Exact((), "lang")]


def test_boolean_language():
    t = catalog.Term
    assert catalog.parse_boolean("a and (b or not title:c) d") == catalog.Op("and", (t("a"), catalog.Op("or", (t("b"), catalog.Op("not", (t("c", "title"),)))), t("d")))
    assert catalog.parse_boolean('x "and"') == catalog.Op("and", (t("x"), t("and")))
    for bad in ("", "(a", "a )", "a or", '"x'):
        with pytest.raises(catalog.InvalidQuery):
            catalog.parse_boolean(bad)


def test_search_grows_no_results_with_more_clauses(spark):
    df = spark.createDataFrame([(i, f"word{i % 7} text{i % 3}", "src") for i in range(60)], "id int, t string, s string")
    index = catalog.folded_index(df, {"summary": F.col("t"), "repo": F.col("s")}, "id").cache()
    found = [catalog.search(index, q, ["summary", "repo"]).count() for q in ("", "word", "word1", "word1 text2", "word1 text2 zz")]
    assert found == sorted(found, reverse=True) and found[:2] == [60, 60] and found[-1] == 60 or found[-1] == 0


def test_offsets(spark):
    df = spark.createDataFrame([(1, "aXaXaXa"), (2, "none"), (3, "a.b.c")], "id int, t string")
    assert sorted(map(tuple, catalog.occurrences(df, "id", F.col("t"), "aXa").collect())) == [(1, 0, 3), (1, 4, 3)]
    assert [r.start for r in catalog.occurrences(df, "id", F.col("t"), ".").collect()] == [1, 3]
    places = lambda text, term: [(m["start"], m["length"]) for m in catalog.covered(text, term)]
    assert places("süße", "se") == [(2, 2)] and places("süße", "üs") == [(1, 2)] and places("süße", "s") == [(0, 1), (2, 1)]
    assert places("ßß", "sss") == [(0, 2)] and places("Œuvre", "oeu") == [(0, 2)] and places("", "a") == places("a", "") == []
    df = spark.createDataFrame([(1, "süße Süsse"), (2, None), (3, "")], "id int, t string")
    assert sorted(map(tuple, catalog.display_matches(df, "id", "t", "SÜß").collect())) == [(1, 0, 3), (1, 5, 4)]


def test_closure(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "rid int, parent int")
    assert len(relational.closure(df).collect()) == 9
    random.seed(1)
    parent = {i: (random.randrange(i) if i else None) for i in range(40)}
    got = {(r.rid, r.root) for r in relational.closure(spark.createDataFrame(list(parent.items()), "rid int, parent int")).collect()}
    want = set()
    for node in parent:
        at = node
        while True:
            want.add((node, at))
            if at is None:
                break
            at = parent[at]
    assert got == want


def test_positions_and_pages(spark):
    df = spark.range(0, 1000, 3).withColumnRenamed("id", "k")
    got = relational.positions(df, F.expr("k div 100"), ["k"]).orderBy("k").collect()
    assert [r.pos for r in got] == list(range(len(got)))
    pages = [relational.page(df, ["k"], n, 50).collect() for n in range(1, 9)]
    assert [r.k for p in pages for r in p] == list(range(0, 1000, 3)) and all(r.total == 334 for p in pages for r in p)


def test_changes(spark):
    before, now = spark.createDataFrame([("a", 1), ("b", 1), ("d", 1)], "k string, t int"), spark.createDataFrame([("b", 2), ("c", 1), ("d", 1)], "k string, t int")
    assert dict(relational.change_classes(before, now, "k", "t").collect()) == {"a": "delete", "b": "update", "c": "insert", "d": "keep"}


def test_passages(spark):
    lines = spark.createDataFrame([(7, i, f"w{i}") for i in range(4)] + [(8, i, "x") for i in range(5)] + [(9, 0, "y")], "v int, o int, t string")
    got = parallels.passages(lines, "v", "o", "t").collect()
    assert sorted(r.number for r in got if r.v == 7) == ["7", "7a", "7ab", "7b", "7c", "7cd", "7d"]
    assert sorted(r.type for r in got if r.v == 8) == [1, 2, 2, 4, 4, 4, 4, 4]
    assert next(r.text for r in got if r.number == "7ab") == " w0 w1 "


def test_similar_pairs_equal_brute_force(spark):
    random.seed(3)
    texts = ["".join(random.choices("abc", k=random.randint(0, 12))) for _ in range(120)] + ["", "ab"]
    sets = [{t[i : i + 3] for i in range(len(t) - 2)} for t in texts]
    want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] | sets[j] and 10 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j])}
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for size in (16, 1024):
        assert {(r.id1, r.id2) for r in parallels.similar_pairs(df, "id", F.col("t"), block_rows=size).collect()} == want
    both = parallels.mirrored(parallels.similar_pairs(df, "id", F.col("t"))).collect()
    assert {(r.id, r.id2) for r in both} == want | {(j, i) for i, j in want}


XML = '<a><b k="1">x<c/>y</b> <b k="2"><!--n--><c/>z</b><d><c><e/></c></d></a>'


def test_trees(spark):
    rows = nodes.parse_xml(1, XML)
    assert [r["name"] for r in rows if r["kind"] == "tag"] == ["a", "b", "c", "b", "c", "d", "c", "e"]
    for a, b in itertools.combinations(rows, 2):
        inside = b["pre"] > a["pre"] and b["post"] < a["post"]
        at = b
        while at["parent_pre"] is not None and at is not a:
            at = rows[at["parent_pre"]]
        assert inside == (at is a)
    assert nodes.parse_xml(2, "<a><b></a>")[0]["error"] and nodes.parse_xml(2, "<!DOCTYPE a><a/>")[0]["error"] and nodes.parse_xml(2, "<a><![CDATA[x]]></a>")[0]["error"]


@pytest.mark.parametrize(
    ("path", "found"),
    [
        ("/a/b", 2), ("//c", 3), ("//c/..", 3), ("//e/ancestor::*", 3), ("//b[@k='2']", 1), ("//b[@k]/following-sibling::d", 1), ("//d/preceding-sibling::b", 2), ("//b/following::c", 2),
        ("//d/preceding::c", 2), ("//b[c and not(@k='1')]", 1), ("//*[name()='e' or name()='d']", 2), ("//b[regex('^x')]", 1), ("//b[glob('*z')]", 1), ("//b/stuck-child::c", 1), ("//d/stuck-child::c", 1),
        ("//b[mixed()]", 2), ("//c[empty()]", 2), ("//c[plain()]", 2), ("//d[.//e]", 1), ("//b[@k<'2']", 1), ("//zz", 0), ("/a/d/c/e/.", 1), ("//a[text()='xy z']", 1),
    ],
)
def test_xpath(spark, path, found):
    df = spark.createDataFrame([(1, XML)], "id int, x string")
    assert nodes.XPath(nodes.nodes(df, "id", "x")).find(path).count() == found


def test_bad_paths():
    for bad in ("//", "a[", "a[@b='x", "foo::a", "a]b"):
        with pytest.raises(nodes.XPathError):
            nodes.parse_xpath(bad)


def test_quality(spark):
    df = spark.createDataFrame([(1, "plain é\nд here"), (2, "schwa ә"), (3, None)], "id long, t string")
    assert [tuple(r) for r in quality.odd_clusters(df, "id", "t").collect()] == [(1, 2, 1)]
    tree = nodes.nodes(spark.createDataFrame([(1, '<a lang="x"><b/><c lang="y"><d/></c><e id="1"/><e id="1"/></a>')], "id int, x string"), "id", "x")
    assert [r.value for r in quality.inherited(tree, "lang", "und").orderBy("pre").collect()] == ["x", "x", "y", "y", "x", "x"]
    assert quality.unique_attribute(tree, "id", "r").count() == 2 and quality.forbidden(tree, "//c//d", "r").count() == 1


def test_bibliography(spark):
    kind = f"key string, version long, data {biblio.RECORD.split('data:')[1][:-1]}"
    creator = lambda last, kind="author": (kind, "F", last, "")
    data = lambda kind, title, extra="", date="1990", deleted=0, people=(): (kind, title, "t", date, extra, "1-2", "https://doi.org/10.1/x", "", deleted, list(people), [("t1",)], "J", "", "B", *[None] * 3, "4", "2", "2", *[None] * 10)
    rows = [("k1", 1, data("book", "A", people=[creator("Zed")])), ("k2", 2, data("book", "A", "Shorthand: SH", people=[creator("Abe")])), ("k3", 3, data("podcast", "B")), ("k4", 4, data("book", " ")), ("k5", 5, data("book", "C", deleted=1)), ("k6", 6, data("thesis", "D", date="n.d.", people=[creator("X", "editor"), creator("Y"), creator("W")]))]
    df = spark.createDataFrame(rows, kind)
    assert {(r.short_title, r.key, r.sort_key) for r in biblio.admitted(df).collect()} == {("A", "k2", "SH k2"), ("D", "k6", "X, F k6")}
    got = {r.key: r for r in df.select("key", biblio.reference(F.col("data")).alias("r"), biblio.clean_doi(F.col("data.DOI")).alias("doi"), biblio.is_page_range(F.col("data.pages")).alias("pp")).collect()}
    assert got["k1"].r == "Zed 1990" and got["k6"].r == "X et al. n.d." and got["k1"].doi == "10.1/x" and got["k1"].pp
    entries = {r[0]: r[1] for r in df.select("key", biblio.entry(F.col("data"))).collect()}
    end = 'No place, pp.\u00a01–2. DOI: <link href="https://doi.org/10.1/x">10.1/x</link>.'
    assert entries["k1"] == f"Zed, F. 1990. <i>t</i>. 2nd edition. Vol.\u00a04. {end}" and entries["k3"] is None and entries["k6"] == f"X, F, F Y and F W. N.d. “t.” Thesis. {end}"
    assert entries["k2"] == "SH. <i>t</i>. By F Abe. 2nd edition. Vol.\u00a04. " + end.replace("place,", "place, 1990,")
    assert {r.key for r in biblio.sync(df, df.limit(0), df.where("key = 'k1'")).collect()} == {"k2", "k3", "k4", "k5", "k6"}
    assert {r.key for r in biblio.sync(df, df.where("key = 'k3'"), df.limit(0), since=0).collect()} == {"k3"}
    at = F.array(F.struct(F.lit("page").alias("unit"), F.lit("3-5").alias("value")), F.struct(F.lit("mixed").alias("unit"), F.lit("verse 2").alias("value")), F.struct(F.lit("entry").alias("unit"), F.lit("x").alias("value")))
    k2 = df.where("key = 'k2'").select(biblio.cited(F.col("data"), "siglum", at, F.lit("B")), biblio.cited(F.col("data"), "default"), biblio.listed_entry(F.col("data"), at, F.lit("B"))).first()
    assert k2[0] == "B, pp.\u00a03–5, verse 2, s.v.\u00a0x" and k2[1] == "SH" and k2[2].startswith("<b>[B]</b> SH. <i>t</i>.") and k2[2].endswith(". Pages 3–5, verse 2, entry x.")


def test_entries_of_all_kinds(spark):
    names = biblio.RECORD.split("data:struct<")[1]
    fields = [f.name for f in spark.createDataFrame([], f"d struct<{names[:-1]}").schema["d"].dataType]
    people = [("author", "Ann", "Ash", ""), ("editor", "Ed", "Elm", ""), ("bookAuthor", "", "", "Team"), ("author", "Bo", "", "")]
    common = {"title": "On what?", "shortTitle": "s", "date": "1990-91", "pages": "5", "creators": people, "url": "http://a; http://b", "publisher": "n.pub", "place": "Rome", "series": "Ser", "seriesNumber": "3", "volume": "7", "issue": "2", "publicationTitle": "Paper", "journalAbbreviation": "J.", "bookTitle": "Book!", "proceedingsTitle": "Proc", "websiteTitle": "Site", "blogTitle": "Blog", "university": "U", "repository": "Repo", "numberOfVolumes": "2", "edition": "revised"}
    front, short, urls = "Ash, Ann, Ed Elm, Team and Bo No name. 1990–91.", "Ash, Ann and Bo No name. 1990–91.", '<link href="http://a">[URL]</link> <link href="http://b">[URL]</link>.'
    place, series, title = "Rome, p.\u00a05.", "Vol.\u00a07. Ser 3. 2 vols.", "“On what?”"
    want = {
        "book": f"{front} <i>On what?</i> revised. {series} {place} {urls}", "journalArticle": f"{front} {title} <i>J.</i> 7 (2), p.\u00a05. {urls}", "conferencePaper": f"{short} {title} In: <i>Proc</i>. By Team. Edited by Ed Elm. {series} {place} {urls}",
        "report": f"{front} {title} {place} {urls}", "bookSection": f"{short} {title} In: <i>Book!</i> revised. By Team. Edited by Ed Elm. {series} {place} {urls}", "thesis": f"{front} {title} Thesis, U. {place} {urls}",
        "webpage": f"{front} {title} Site. {urls}", "document": f"{front} {title} {urls}", "newspaperArticle": f"{front} {title} <i>Paper</i>. revised. {place} {urls}", "dataset": f"{front} {title} Repo. {urls}", "blogPost": f"{front} {title} <i>Blog</i> (blog). {urls}", "podcast": None,
    }
    rows = [(tuple((common | {"itemType": k}).get(f) for f in fields),) for k in want]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, f"d struct<{names[:-1]}").select("d.itemType", biblio.entry(F.col("d"))).collect()}
    assert got == want
    late = spark.createDataFrame([(tuple((common | {"itemType": k, "extra": "Shorthand: SH\nOriginal date: 1800"}).get(f) for f in fields),) for k in ("blogPost", "journalArticle", "document")], f"d struct<{names[:-1]}")
    assert [r[0] for r in late.select(biblio.entry(F.col("d"))).collect()] == [f"SH. {title} By Ann Ash and Bo No name. [1800] 1990–91. <i>Blog</i> (blog). {urls}", f"SH. {title} By Ann Ash and Bo No name. <i>J.</i> 7 (2) ([1800] 1990–91), p.\u00a05. {urls}", f"SH. {title} By Ann Ash and Bo No name. [1800] 1990–91. {urls}"]


def test_rich_text(spark):
    from glyphmill.operators.biblio import ordinal_edition, rich_text

    assert column(spark, ["a <i>b</i> <u>c</u> <B>d</B>"], rich_text) == ['a <span class="italics">b</span> c <span class="bold">d</span>']
    spans = ['<span style="font-variant: small-caps;">A</span>  <em>b</em>', "<span class='nocase' style='font-variant:small-caps'>x</span>", '<span class="nocase">y</span>', '<span id="q">z</span><a href="u">v</a> ']
    assert column(spark, spans, rich_text) == ['<span class="smallcaps">A</span> <span class="italics">b</span>', '<span class="nocase smallcaps">x</span>', '<span class="nocase">y</span>', '<span>z</span><link href="u">v</link>']
    assert column(spark, ["1", "12", "23", "revised", ""], ordinal_edition) == ["1st edition", "12th edition", "23rd edition", "revised", None]


def test_languages_and_scripts(spark):
    from glyphmill.operators import languages

    iso3 = spark.createDataFrame([("fra", "fre", "fra", "fr", "French"), ("tam", "tam", "tam", "ta", "Tamil")], "Id string, Part2b string, Part2t string, Part1 string, Ref_Name string")
    names = spark.createDataFrame([("fra", "French", "French"), ("tam", "Tamil", "Tamil"), ("tam", "Tamul", "Tamul")], "Id string, Print_Name string, Inverted_Name string")
    iso5 = spark.createDataFrame([("dra", "Dravidian languages")], "code string, label string")
    own = spark.createDataFrame([("tam", "Old Tamil", "Tamil, Old", "source"), ("xxx", "Special", "Special", ""), ("fra", "", "", "study")], "Id string, Print_Name string, Inverted_Name string, type string")
    listed, codes = languages.languages(iso3, names, iso5, own)
    got = {r.id: r for r in listed.collect()}
    assert len(got) == 9 and (got["tam"].name, got["tam"].inverted_name, got["tam"].custom, got["tam"].project, got["tam"].iso) == ("Old Tamil", "Tamil, Old", True, True, 3)
    assert got["fra"].parent == got["study"].rid and not got["fra"].custom and got["xxx"].custom and got["xxx"].parent == got["source"].rid and got["dra"].iso == 5 and got["lang"].parent is None
    assert {(r.code, r.id) for r in codes.where("id = 'fra'").collect()} == {("fra", "fra"), ("fre", "fra"), ("fr", "fra")}
    xml = "<script><id>source</id><script><id>arabic</id><id>arab</id><name>Arabic</name><script><id>jawi</id></script></script><script><id>latin</id></script></script>"
    scripts = languages.scripts(nodes.nodes(spark.createDataFrame([(1, xml)], "id int, x string"), "id", "x"))
    got = [(r.rid, r.id, r.parent) for r in scripts.orderBy("rid").collect()]
    assert got == [(1, "source", None), (2, "arabic", 1), (3, "jawi", 2), (4, "arabic_other", 2), (5, "latin", 1), (6, "source_other", 1)]


def test_prosody(spark):
    from glyphmill.functions.prosody import is_pattern, render_pattern

    assert column(spark, ["-+=2", "12-||"], render_pattern) == ["⏑–⏓⏖", "12⏑||"]
    assert column(spark, ["-+|", "", "abc"], is_pattern) == [True, False, False]


def test_tables_with_tabs(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("names\ttext\tdescription\tsearch\na b a\tX\t\t\nc\t\td\tq\n")
    got = {r.name: (r.text, r.description, r.search) for r in readers.symbols(spark, f"file://{tmp_path}/s.tsv").collect()}
    assert got == {"a": ("X", "symbol", "X"), "b": ("X", "symbol", "X"), "c": (None, "d", "q")}
    (tmp_path / "r.tsv").write_text("name\ttextual\ttitle\nr1\ttrue\tT\nr1\tfalse\n")
    with pytest.raises(ValueError):
        readers.repositories(spark, f"file://{tmp_path}/r.tsv")
    (tmp_path / "g.tsv").write_text("git_name\tdh_id\na\tb\tc\n")
    with pytest.raises(Exception, match="too many cells"):
        readers.git_names(spark, f"file://{tmp_path}/g.tsv").collect()


def test_files_and_members(spark, tmp_path):
    for name in ("pre_a.xml", "pre_Template.xml", "other.xml", ".hidden/pre_b.xml", "sub/pre_c.XML"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes("<l><person xml:id='x/ab'><forename>A</forename><surname>B</surname><affiliation>U</affiliation></person></l>".encode())
    files = readers.edition_files(spark, f"file://{tmp_path}", ("pre_",))
    assert sorted(r.name for r in files.collect()) == ["pre_a", "pre_c"]
    text = readers.decoded(files).select(F.lit(1).alias("id"), "text").limit(1)
    got = readers.members(nodes.nodes(text, "id", "text")).first()
    assert (got.id, got.print_name, got.inverted_name, got.affiliation) == ("ab", "A B", "B, A", "U")


def test_stream(spark, tmp_path):
    source = f"{tmp_path}/in"
    kind = "k int, v int, gone boolean"
    into = VersionedTable(spark, f"file://{tmp_path}/table", "k int, v int")
    run = lambda: ingest(spark.readStream.schema(kind).json(source), into, "k", "v", F.col("gone"), f"{tmp_path}/checkpoint")
    spark.createDataFrame([(1, 1, False), (2, 1, False), (1, 3, False)], kind).coalesce(1).write.json(source)
    run()
    assert sorted(map(tuple, into.read().collect())) == [(1, 3), (2, 1)]
    spark.createDataFrame([(2, 5, True), (3, 1, False)], kind).coalesce(1).write.mode("append").json(source)
    run()
    run()
    assert sorted(map(tuple, into.read().collect())) == [(1, 3), (3, 1)]


def test_a_crash_loses_no_version(spark, tmp_path, monkeypatch):
    from glyphmill.streaming import ingest

    into = ingest.VersionedTable(spark, f"file://{tmp_path}/t", "k long, n long, v string")
    change = lambda *rows: spark.createDataFrame(list(rows), "k long, n long, v string")
    into.apply(change((1, 1, "a"), (2, 1, "b")), "k", "n", F.lit(False), 0)
    whole = ingest.VersionedTable._point
    monkeypatch.setattr(ingest.VersionedTable, "_point", lambda *_: (_ for _ in ()).throw(OSError("crash before the pointer")))
    with pytest.raises(OSError):
        into.apply(change((3, 2, "c")), "k", "n", F.lit(False), 1)
    assert {r.k for r in into.read().collect()} == {1, 2}
    monkeypatch.setattr(ingest.VersionedTable, "_point", whole)
    for batch in range(1, 9):
        into.apply(change((3, batch, f"c{batch}"), (1, batch, "x")), "k", "n", F.col("k") == 1, batch)
        into.apply(change((9, 9, "twice")), "k", "n", F.lit(False), batch)  # came before
        assert sorted(map(tuple, into.read().collect())) == [(2, 1, "b"), (3, batch, f"c{batch}")]
    assert len(list(tmp_path.glob("t/v*"))) == ingest.RETAINED
    repos = spark.createDataFrame([("a", "1", "x"), ("b", "2", "x"), ("c", "1", "y"), ("d", "1", "x")], "repo string, commit_hash string, code_hash string")
    seen = spark.createDataFrame([("a", "1", "x"), ("b", "1", "x"), ("c", "1", "x")], "repo string, commit_hash string, code_hash string")
    assert dict(map(tuple, ingest.due(repos, seen).collect())) == {"a": "skip", "b": "changed", "c": "all", "d": "all"}


def test_events(spark):
    events = spark.createDataFrame([('{"repository":{"name":"r"},"commits":[{"author":{"email":"bot"}}]}',), ('{"repository":{"name":"s"},"commits":[{"author":{"email":"bot"}},{"author":{"email":"me"}}]}',), ("junk",)], "value string")
    assert [r.name for r in webhook_names(events, ["bot"]).collect()] == ["s"]
    lines = spark.createDataFrame([("all",), ("bib",), (" r1 ",), ("x",)], "value string")
    assert dict(routed(lines, spark.createDataFrame([("r1",)], "repo string")).collect()) == {"all": "all", "bib": "bib", "r1": "repository", "x": "junk"}


EDITION = """<TEI><teiHeader><titleStmt><title>T  1</title><editor><persName>A B</persName></editor><editor><persName>A B</persName></editor></titleStmt><summary>S</summary></teiHeader>
<text><body><div type="edition" xml:lang="san"><pb n="1"/><p><lb n="1"/>foo <choice><sic>bra</sic><corr>bar</corr></choice> <gap reason="lost" quantity="3" unit="character"/>
<supplied reason="lost" cert="low">xx</supplied>ba<lb n="2" break="no"/>z<note>N 1</note> <g type="numeral">1/4</g> <g type="dot"/><del>old</del> <choice><unclear>a</unclear><unclear>b</unclear></choice><zz/></p>
<lg><l>one</l><l>two</l></lg></div></body></text></TEI>"""


def test_editions(spark):
    from glyphmill.operators import editions

    df = spark.createDataFrame([(1, EDITION), (2, "<a>"), (3, "<TEI/>")], "id int, x string")
    got = {r.doc_id: r for r in editions.displays(df, "id", "x", {"dot": ("•", ".")}).collect()}
    one = got[1]
    assert one.logical == "foo bar [3+] [xx?]baz ¼ • (a/b)\none\ntwo" and one.search == "foo bar ... xxbaz 1/4 . a\none\ntwo"
    assert "foo bra [***] [xx?]ba-\n(2) z" in one.physical and "⟦old⟧" in one.physical and "¿bra?⟨bar⟩" in one.full
    assert (one.title, one.editors, one.summary, one.langs, one.notes, one.lines, one.unknown) == ("T 1", ["A B"], "S", ["san"], ["N 1"], 2, ["zz"])
    assert got[2].error and got[3].logical == "" and got[3].langs == ["und"]


def test_gaps_and_fractions():
    from glyphmill.operators.editions import fraction, gap_views, space_view

    assert gap_views("lost", "3", "character") == {"logical": "[3+]", "physical": "[***]", "full": "[3+]", "search": "...", "tip": "3 lost characters"}
    assert gap_views()["logical"] == "[…]" and gap_views()["search"] == "....." and gap_views()["tip"] == "Unknown number of lost or illegible characters"
    assert gap_views("lost", "2", "line", "low") == {"logical": "[ca. 2 lost lines]", "physical": "[ca. 2 lost lines]", "full": "[ca. 2 lost lines]", "search": ".....", "tip": "About 2 lost lines"}
    assert gap_views("illegible", "1", "character", "low") == {"logical": "[ca. 1×]", "physical": "[*]", "full": "[ca. 1×]", "search": ".", "tip": "About 1 illegible character"}
    assert gap_views("lost", "2", "component", "low") | {"tip": ""} == {"logical": "[ca. ..]", "physical": "[ca. ..]", "full": "[ca. ..]", "search": ".", "tip": ""}
    assert gap_views("lost", "2", uncertain=True)["logical"] == "[2*]" and gap_views("lost", "x", "line", uncertain=True)["full"] == "[unknown number of possibly lost lines]"
    assert gap_views("ellipsis") == {"logical": "…", "physical": "…", "full": "…", "search": "…", "tip": ""}
    assert fraction("1/4") == "¼" and fraction("7/9") == "⁷⁄₉" and fraction("x") == "x" and fraction("0/3") == "↉" and fraction("1⁄2") == "½" and fraction("03/04") == "¾" and fraction("1/10") == "¹⁄₁₀"
    assert space_view("defect") == "□" and space_view("descender", "3") == "⊔" and space_view("ascender") == "⊓" and space_view("vacat", "3") == "___" and space_view("", "x") == "_" and space_view("feature", "4") == "_"


def test_addresses(spark):
    from glyphmill.functions import web

    assert column(spark, ["a b/é"], lambda c: web.format_url("http://x/%s", c)) == ["http://x/a%20b/%C3%A9"]
    assert column(spark, ["/a/b.tar.gz", "C:\\x\\y.xml", ".z"], web.base_name) == ["b.tar", "y", ".z"]
    assert column(spark, ["u?x=1&page=12", "u"], web.page_of) == [12, None]
    assert column(spark, ["/dictionaries/mw/?page=1", "x"], web.dictionary_of) == ["mw", None]
    assert column(spark, [1, 3], lambda c: web.count_of(c, "line"), "int") == ["1 line", "3 lines"]
    assert column(spark, [0], web.format_date, "long") == ["1970-01-01 00:00"]
    assert column(spark, ['<a href="../x">'], web.absolute_links("http://h/d/e/")) == ['<a href="http://h/d/x">']


def test_collected_material(spark, tmp_path):
    from glyphmill.sources import collections as C

    (tmp_path / "d.tsv").write_text("mw\t2\t<hw>b</hw> x\nmw\t1\tpre <hw>a <i>q</i></hw> one <hw>c</hw> two\nap\t1\t<p>\n")
    pages = C.dictionary_pages(spark, f"file://{tmp_path}/d.tsv", "m*")
    assert [(r.page, r.head) for r in C.dictionary_entries(pages).orderBy("page", "n").collect()] == [(1, "a q"), (1, "c"), (2, "b")]
    xml = "<doc><H1><arie n='5' ref='R'/></H1><H2>Place  A</H2><pb n='3'/><INSCRIPTION><S>one</S></INSCRIPTION><H2>B</H2><INSCRIPTION>two</INSCRIPTION></doc>"
    tree = nodes.nodes(spark.createDataFrame([(1, xml)], "id int, x string"), "id", "x")
    assert [tuple(r)[2:] for r in C.report_entries(tree).orderBy("pre").collect()] == [("R", "5", "Place A", "3", "one"), ("R", "5", "B", "3", "two")]
    sheet = "<o><table><table-row><table-cell><p>K</p></table-cell><table-cell>L</table-cell></table-row><table-row><table-cell number-columns-repeated='2'>v</table-cell></table-row><table-row><table-cell/><table-cell>w</table-cell></table-row></table></o>"
    rows = C.spreadsheet_rows(nodes.nodes(spark.createDataFrame([(1, sheet)], "id int, x string"), "id", "x"))
    assert [r.html for r in C.spreadsheet_cards(rows).orderBy("row").collect()] == ["<dl><dt>K</dt><dd>v</dd><dt>L</dt><dd>v</dd></dl>", "<dl><dt>L</dt><dd>w</dd></dl>"]


def test_paths_and_patterns(spark):
    tree = nodes.nodes(spark.createDataFrame([(1, XML)], "id int, x string"), "id", "x")
    assert [r.path for r in tree.where("kind = 'tag'").orderBy("pre").collect()] == ["/a[1]", "/a[1]/b[1]", "/a[1]/b[1]/c[1]", "/a[1]/b[2]", "/a[1]/b[2]/c[1]", "/a[1]/d[1]", "/a[1]/d[1]/c[1]", "/a[1]/d[1]/c[1]/e[1]"]
    assert nodes.locate(tree, "/a[1]/b[2]").count() == nodes.locate(tree, "/").count() == 1
    with pytest.raises(nodes.XPathError):
        nodes.locate(tree, "/a")
    find = nodes.XPath(tree)
    assert find.matches("b/c").count() == 2 and find.matches("d//e").count() == 1 and find.first("//c").first().path == "/a[1]/b[1]/c[1]"


def test_searchable_text():
    from glyphmill.operators.editions import searchable_text, tree_of

    xml = "<document><div><head>H</head><para>a<split><display>X</display><search>y</search></split><note>n</note></para><verse><verse-line>b</verse-line><verse-line break='true'>c</verse-line></verse><dlist><key>k</key><value>v</value></dlist></div></document>"
    assert searchable_text(tree_of(nodes.parse_xml(1, xml))) == "ay\nb c\n k v\n"


def test_every_event_is_counted(spark):
    from glyphmill.plans import registry

    data = "/root/testdata/sf0.001"
    want = collections.Counter((f"report{r.user_id % 5}", r.at) for r in spark.read.parquet(f"{data}/events.parquet").selectExpr("user_id", "substring(cast(cast(ts as timestamp) as string), 1, 16) as at").collect())
    got = {(r.report, r.at): r.n for r in registry.queries()["formatted_counts"](spark, data).collect()}
    assert got == {k: f"{n} event" + "s" * (n != 1) for k, n in want.items()}


def test_offsets_of_a_long_text(spark):
    text = "".join("x" * (k % 5) + "ti" for k in range(100_000))
    want = [m.start() for m in re.finditer("ti", text)]
    df = spark.createDataFrame([(1, text), (1, "é\nti"), (2, None)], "id int, t string")
    found = catalog.occurrences(df, "id", F.col("t"), "ti")
    assert sorted(map(tuple, found.collect())) == sorted([(1, s, 2) for s in want] + [(1, 2, 2)])  # rows of one key are texts of their own


def test_offsets_of_whole_documents(spark):
    from glyphmill.plans import registry

    data = "/root/testdata/sf0.001"
    want = sorted((r.doc_id, m.start(), 2) for r in spark.read.parquet(f"{data}/documents.parquet").collect() for m in re.finditer("ti", r.text.lower()))
    assert sorted(map(tuple, registry.queries()["match_offsets_documents"](spark, data).collect())) == want


def test_trigrams_of_odd_and_long_texts(spark):
    texts = ["", "ab", "abc", "a\nb\nc\x00\x00é\U0001f600日本語\U0001f600日本", "aaaaaa", "$.^[(a", "".join(chr(97 + k * k % 23) for k in range(200_000))]
    for text, grams in spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.trigrams(F.col("t"))).collect():
        assert grams == list(dict.fromkeys(text[k : k + 3] for k in range(len(text) - 2)))


def test_passages_are_found_in_documents(spark):
    from glyphmill.plans import registry

    data = "/root/testdata/sf0.001"
    grams = lambda t: {t[k : k + 3] for k in range(len(t) - 2)}
    documents = [(r.doc_id, grams(r.text)) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    want = []
    for q in spark.read.parquet(f"{data}/benchmark.parquet").collect():
        own = grams(q.text)
        scored = sorted((-(1_000_000 * len(own & g) // len(own | g)), i) for i, g in documents if own & g)
        want += [(q.item_id, i, -c / 1e6, len(scored)) for c, i in scored[:50]]
    got = registry.queries()["parallels_search_documents"](spark, data).select("item_id", "doc_id", "coeff", "total").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_trees_of_editions(spark):
    from glyphmill.operators import rules, trees

    xml = """<TEI><text><body><div n="1"><div><div n="3"><lg n="12"><l n="a">A b<note>no <lg><l n="a">inner</l></lg></note><space/>c</l><l n="b" enjamb="yes">'d' <gap/><del>x</del>[12 e]</l></lg>
      <lg><l n="a">123</l></lg><lg n="2"><l n="b">z</l></lg></div></div></div><div type="apparatus"><listApp><app loc="1"><lem>  one
      two </lem></app><app loc="1"><lem/></app><app loc="1"><lem>x</lem><rdg>y</rdg></app><app loc="2"><lem>z</lem><note>n</note></app><app loc="1"><lem>q</lem></app></listApp></div></body></text></TEI>"""
    df = nodes.nodes(spark.createDataFrame([(1, xml), (2, "<lg><l n='a'>only</l></lg>"), (3, "<a>")], "id int, x string"), "id", "x").where("error is null")
    lines = [(r.doc_id, r.number, r["at"], r.text) for r in trees.verse_lines(df).orderBy("doc_id", "verse", "at").collect()]
    assert lines == [(1, "1.3.12", 0, "A b c"), (1, "1.3.12", 1, "-’d’"), (1, "1.3.?", 0, "inner"), (2, "?", 0, "only")]
    assert [r.text for r in trees.apparatus(df).orderBy("paragraph").collect()] == ["⟨1⟩ one two — ⟨1⟩ x ◇ y.", "⟨2⟩ z • n", "⟨1⟩ q"]
    assert [(r.n, r.text) for r in trees.numbered_notes(df).collect()] == [(1, "no inner")]
    assert {r.rule for r in rules.letters_in_order(df).collect()} == set()
    bad = """<TEI><div type="edition"><lg><l n="a"/><l n="a"/></lg><l/><num atLeast="1"/><date when="1" from="2"/><note>a<note>b</note></note><app/><seg rend="pun"/><fw/><pb/><fw/><lem><l/></lem></div><div type="translation"><p corresp="#x"/><seg rend="pun"/></div></TEI>"""
    df = nodes.nodes(spark.createDataFrame([(1, bad)], "id int, x string"), "id", "x")
    found = collections.Counter(r.rule for r in rules.violations(df, rules.inscription_rules()).collect())
    assert found == {"a line is in a verse or stanza": 1, "atLeast needs atMost": 1, "when excludes other dates": 1, "notes cannot nest": 1, "app is in a listApp": 1, "puns only in translations": 1, "fw follows a page or another fw": 1, "a lemma has no single line": 1, "corresp only with a stanza in a translation": 1}
    assert rules.letters_in_order(df).count() == 1
    df = spark.createDataFrame([("INS_1.xml",), ("x",)], "n string")
    assert [r[0] for r in df.select(rules.schema_of(F.col("n"), {"INS_": "inscription"})).collect()] == ["inscription", None]


def test_holdings(spark):
    from glyphmill.operators import holdings

    assert [tuple(r[0]) for r in spark.createDataFrame([(0, 0), (9, 101), (2, 100), (1, 5)], "p int, t int").select(holdings.page_bounds(F.col("p"), F.col("t"), 50)).collect()] == [(1, 1, 0, 0), (3, 3, 101, 101), (2, 2, 51, 100), (1, 1, 1, 5)]
    old, new = spark.createDataFrame([(1, "a", "b")], "k int, x string, y string"), spark.createDataFrame([(1, None), (2, "n")], "k int, x string")
    assert sorted(map(tuple, holdings.update_columns(old, new, "k", "x").collect())) == [(1, None, "b"), (2, "n", None)]
    assert sorted(map(tuple, holdings.insert_new(old, spark.createDataFrame([(1, "z", "z"), (3, "q", "r"), (3, "p", "r")], "k int, x string, y string"), "k").collect())) == [(1, "a", "b"), (3, "p", "r")]
