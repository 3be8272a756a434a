"""Queries of keys and references, and of metres."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators import keys, metres, nodes, rules, trees
from glyphmill.plans.registry import query
from glyphmill.session import table


def _referring(spark, d) -> DataFrame:
    """Editions of conversations whose turns refer to each other, to dates and to the benchmark as bibliography."""
    turns = table(spark, d, "conversations").selectExpr("*", "row_number() over (partition by conv_id order by turn) - 1 as k")
    one = F.expr("""concat('<p xml:id="t', k div 2, '"><ref target="#t', k, ' #t0"/><span spanTo="#t', (k + 1) div 2, '"/><ptr copyOf="#t', (k + 1) div 2, ' plain"/>',
      '<rs type="month" key="', case when k % 3 = 0 then 'magha' else 'march' end, '"/><rs type="fortnight" subtype="', case when k % 2 = 0 then 'dark' else 'grey' end, '"/>',
      '<rs type="other" key="march"/><note source="bib:B', k * 7, ' bib:B1"/></p>')""")
    whole = turns.groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("k", one.alias("x"))))["x"], "").alias("x"))
    return nodes.kept(nodes.nodes(whole.select("conv_id", F.concat(F.lit("<TEI>"), "x", F.lit("</TEI>")).alias("x")), "conv_id", "x"))


# A turn's paragraph is t<k // 2>: two turns share one, so identifiers repeat and half of the numbers aren't there.
@query("""with t as (select conv_id, (row_number() over (partition by conv_id order by turn) - 1)::int as k, count(*) over (partition by conv_id)::int as n from conversations),
            ids as (select conv_id, k // 2 as i, min(k) as first, max(k) as last, count(*) as times from t group by all)
          select conv_id as doc_id, rule, token, count(*) as n from (
            select t.conv_id, 'an identifier stands once' as rule, 't' || (k // 2) as token from t join ids on ids.conv_id = t.conv_id and i = k // 2 where times > 1
            union all select conv_id, 'the element indicated by target must be there', '#t' || k from t where k > (n - 1) // 2
            union all select t.conv_id, 'the element indicated by spanTo must follow', '#t' || ((k + 1) // 2) from t left join ids on ids.conv_id = t.conv_id and i = (k + 1) // 2 where last is null or last <= k
            union all select t.conv_id, 'the element that is copied must precede', '#t' || ((k + 1) // 2) from t left join ids on ids.conv_id = t.conv_id and i = (k + 1) // 2 where first is null or first >= k
            union all select conv_id, 'a month has one of the twelve names', 'march' from t where k % 3 <> 0
            union all select conv_id, 'a fortnight is dark or bright', 'grey' from t where k % 2 <> 0
            union all select conv_id, 'a source must be in the bibliography', 'bib:B' || (k * 7) from t where k * 7 not in (select item_id from benchmark)) group by all""")
def key_violations(spark, d):
    lists = spark.createDataFrame(keys.VOCABULARIES, "list string, value string")
    bibliography = table(spark, d, "benchmark").select(F.lit("bibliography").alias("of"), F.concat(F.lit("B"), "item_id").alias("key"))
    found = keys.violations(_referring(spark, d), keys.EDITION_KEYS, lists, bibliography)
    return found.groupBy("doc_id", "rule", "token").agg(F.count("*").alias("n"))


# Words of the benchmark stand for metres, those of conversations for verses: vowels are long, n and r free, h two short or a long one.
@query(r"""with w as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]{4,8}')) as w from benchmark), m as (select w as name, translate(w, 'aeiounrhbcdfgjklmpqstvwxyz', '+++++==2-----------------') as p from w),
            f as (select p, min(name) as name, length(p) - length(replace(replace(p, '=', ''), '2', '')) as free, '^' || replace(replace(replace(p, '+', '\+'), '=', '[-+]'), '2', '(--|\+)') || '$' as re from m group by p),
            t as (select conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]{4,8}')) as w from conversations),
            v as (select distinct translate(w, 'aeioubcdfghjklmnpqrstvwxyz', '+++++---------------------') as p from t),
            b as (select v.p, min(struct_pack(free := free, name := name)) as m from v join f on regexp_matches(v.p, f.re) group by v.p)
          select conv_id as doc_id, m.name as metre, m.free::bigint as free, count(*) as n from t join b on b.p = translate(w, 'aeioubcdfghjklmnpqrstvwxyz', '+++++---------------------') group by all""")
def metre_of_verse(spark, d):
    words = lambda c: F.explode(F.regexp_extract_all(F.lower(c), F.lit("([a-z]{4,8})"), F.lit(1)))
    listed = table(spark, d, "benchmark").select(words("text").alias("name")).withColumn("pattern", F.translate("name", "aeiounrhbcdfgjklmpqstvwxyz", "+++++==2-----------------"))
    verses = table(spark, d, "conversations").select("conv_id", words("text").alias("w")).withColumn("verse", F.translate("w", "aeioubcdfghjklmnpqrstvwxyz", "+++++---------------------"))
    found = metres.metre_of(verses, listed, "conv_id", "verse")
    return found.groupBy(F.col("conv_id").alias("doc_id"), "metre", "free").agg(F.count("*").alias("n"))


@query(r"""select r_regionkey as doc_id, n_name as name, case when n_nationkey % 3 = 0 then '⏑–⏓|⏖⏑' when n_nationkey % 3 = 1 then '-+=' else 'ma-' || n_nationkey end as pattern
           from nation join region on r_regionkey = n_regionkey union all select n_regionkey, 'n' || n_nationkey, case when n_nationkey % 3 = 0 then '⏑–⏓|⏖⏑' when n_nationkey % 3 = 1 then '-+=' else 'ma-' || n_nationkey end from nation""")
def metre_lists(spark, d):
    seg = F.expr("""case n_nationkey % 3 when 0 then '<seg type="xml">-</seg><seg type="prosody">-+=|2-</seg>' when 1 then '<seg type="prosody">no data available</seg><seg type="xml"> -+= </seg>'
      else concat('<seg type="gana">ma-', n_nationkey, '</seg><seg type="xml"/>') end""")
    item = F.concat(F.lit("<item><measure unit='syllable'>4</measure><name>"), T.quote_xml(F.col("n_name")), F.lit("</name><name> </name><name>n"), "n_nationkey", F.lit("</name>"), seg, F.lit("<note>x</note></item>"))
    whole = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.collect_list(item), "").alias("x"))
    rows = nodes.nodes(whole.select("n_regionkey", F.concat(F.lit("<TEI><body><list>"), "x", F.lit("</list></body></TEI>")).alias("x")), "n_regionkey", "x")
    return metres.metre_names(metres.metre_lists(nodes.kept(rows))).select("doc_id", "name", "pattern")


# ---- sources of an apparatus

@query("""with t as (select *, (row_number() over (partition by conv_id order by turn) - 1)::int as k from conversations),
            e as (select conv_id, k, 'l' || k || ' ' || case when k % 5 < 3 then 'S' || (k % 5) else 'A' || (k % 5) end || ' ' || case when k * 3 in (select item_id from benchmark) then 'Item ' || (k * 3) else 'B' || (k * 3) end as lem from t)
          select conv_id as doc_id, string_agg('⟨' || k || '⟩ ' || lem || ' ◇ r S0; s.', chr(10) order by k) as text from e where k % 4 <> 3 group by conv_id""")
def apparatus_sources(spark, d):
    """Sources by the sigla of the edition's own bibliography, else by the collection's; lemmas without text at first."""
    turns = table(spark, d, "conversations").selectExpr("*", "row_number() over (partition by conv_id order by turn) - 1 as k")
    app = F.expr("""concat('<app loc="', k, '">', case when k % 4 = 3 then '<lem> </lem>' else concat('<lem source="bib:A', k % 5, ' bib:B', k * 3, '">l', k, '</lem>') end, '<rdg source="bib:A0">r</rdg><rdg>s</rdg></app>')""")
    whole = turns.groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("k", app.alias("x"))))["x"], "").alias("x"))
    books = "".join(f"<bibl n='S{i}'><ptr target='bib:A{i}'/></bibl>" for i in range(3)) + "<bibl n='late'><ptr target='bib:A0'/></bibl><bibl><ptr target='bib:A3'/></bibl>"
    x = F.concat(F.lit("<TEI><body><div type='apparatus'><listApp>"), "x", F.lit(f"</listApp></div><div type='bibliography'><listBibl>{books}</listBibl></div></body></TEI>"))
    works = table(spark, d, "benchmark").select(F.concat(F.lit("B"), "item_id").alias("ref"), F.concat(F.lit("Item "), "item_id").alias("shown"))
    found = trees.apparatus(nodes.kept(nodes.nodes(whole.select("conv_id", x.alias("x")), "conv_id", "x")), works)
    return found.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("paragraph", "text")))["text"], "\n").alias("text"))


# ---- every structural rule

#: What breaks each rule, and what else it breaks.
BROKEN = [
    ("<p when='1' to='2'/>", ["when excludes other dates"]), ("<p from='1' notBefore='2'/>", ["from excludes notBefore"]), ("<p to='1' notAfter='2'/>", ["to excludes notAfter"]),
    ("<p calendar='c'/>", ["a calendar needs text"]), ("<p unitRef='a' unit='b'/>", ["unitRef makes unit unnecessary"]), ("<p subtype='s'/>", ["subtype requires type"]),
    ("<p targetLang='x'/>", ["targetLang requires target"]), ("<p schemeVersion='1' scheme='free'/>", ["schemeVersion requires a scheme"]), ("<div type='notes'><ab rend='stanza'>x</ab></div>", ["stanzas only in editions and translations"]),
    ("<p corresp='c'>x</p>", ["corresp only with a stanza in a translation"]), ("<num value='1' atLeast='1' atMost='2'/>", ["value excludes a range"]), ("<num atMost='2'/>", ["atMost needs atLeast"]),
    ("<num atLeast='2'/>", ["atLeast needs atMost"]), ("<list type='gloss'><item/></list>", ["a gloss list needs labels"]), ("<note><q><note/></q></note>", ["notes cannot nest"]),
    ("<div type='apparatus'><p><note/></p></div>", ["no note in a paragraph of the apparatus"]), ("<listApp><app><lem source='s'>x<note/></lem></app></listApp>", ["no note in a reading or lemma"]),
    ("<listBibl><bibl><note/><x/></bibl></listBibl>", ["a note is last in a bibliography item"]), ("<listApp><app><note/><rdg/></app></listApp>", ["an apparatus note is last"]),
    ("<listBibl><bibl><citedRange><note/></citedRange></bibl></listBibl>", ["citedRange holds no note"]), ("<p><l>x</l></p>", ["a line is in a verse or stanza"]),
    ("<lg met='mixed'><l>x</l></lg>", ["lines of a mixed stanza need a metre"]), ("<p><q/><fw/></p>", ["fw follows a page or another fw"]),
    ("<q><certainty match='../@met' locus='value'/></q>", ["certainty of a metre needs a verse"]), ("<q><certainty match='..' locus='name'/></q>", ["certainty of a name needs a gap"]),
    ("<lg><certainty match='../@met' locus='name'/></lg>", ["certainty of a metre is of its value"]), ("<gap><certainty match='..' locus='value'/></gap>", ["certainty of a gap is of its name"]),
    ("<seg type='other' subtype='s'/>", ["a segment's subtype needs type component"]), ("<seg cert='low'/>", ["uncertain segments only in translations"]), ("<seg rend='pun'/>", ["puns only in translations"]),
    ("<listApp><app><lem>x</lem></app></listApp>", ["a lemma alone needs a source"]), ("<app><lem source='s'>x</lem></app>", ["app is in a listApp"]), ("<lem><l>x</l></lem>", ["a lemma has no single line"]),
    ("<lem><p/></lem>", ["a lemma may not contain p"]), ("<lem><ab/></lem>", ["a lemma may not contain ab"]), ("<lem><lg/></lem>", ["a lemma may not contain lg"]),
    ("<rdg><p/></rdg>", ["a reading may not contain p"]), ("<rdg><ab/></rdg>", ["a reading may not contain ab"]), ("<rdg><lg/></rdg>", ["a reading may not contain lg"]), ("<rdg><l/></rdg>", ["a reading may not contain l"]),
    ("<listApp><app><lem/><rdg/><note/><note/></app></listApp><p rend='x'>y</p>", []),
]
_BROKEN_SQL = ", ".join(f"""({i}, '{r.replace("'", "''")}')""" for i, (_, broken) in enumerate(BROKEN) for r in broken)


@query(f"""select e.event_id as doc_id, b.rule, count(*) as n from events e join (values {_BROKEN_SQL}) b(i, rule) on b.i = (e.event_id + 7 * e.user_id) % {len(BROKEN)} group by all""")
def every_rule(spark, d):
    """An edition for each event, with a passage that breaks one of the rules, or none."""
    passages = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(BROKEN)], "i long, x string")
    events = table(spark, d, "events").withColumn("i", (F.col("event_id") + 7 * F.col("user_id")) % len(BROKEN)).join(F.broadcast(passages), "i")
    editions = nodes.kept(nodes.nodes(events.select("event_id", F.concat(F.lit("<TEI><body>"), "x", F.lit("</body></TEI>")).alias("x")), "event_id", "x"))
    found = rules.violations(editions, rules.inscription_rules())
    return found.groupBy("doc_id", "rule").agg(F.count("*").alias("n"))
