"""Queries answered by one pass over trees in document order."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators import cover, dispatch, nodes, serialise, trees
from glyphmill.plans.registry import _nodes, _tree_sql, query
from glyphmill.session import table

_SPEECHES_SQL = """t as (select *, row_number() over (partition by conv_id order by turn) - 1 as k from conversations),
  p as (select conv_id, k, case role when 'user' then 'sanskrit brahmi' when 'assistant' then 'fra latin' else 'eng latin' end as own,
               case k % 3 when 0 then 'fra latin' when 2 then 'sanskrit source_other' end as q from t),
  s as (select conv_id, k, own, case when q = 'sanskrit source_other' and own like 'sanskrit%' then 'sanskrit brahmi' else coalesce(q, own) end as q from p)"""


def _speeches(spark, d) -> DataFrame:
    """An edition of each conversation in French: a paragraph a turn, in the language of its role, with a quotation that may be all of it."""
    turns = table(spark, d, "conversations").selectExpr("*", "row_number() over (partition by conv_id order by turn) - 1 as k")
    said = T.quote_xml(F.concat(F.lit("x"), F.coalesce("text", F.lit(""))))
    start = F.expr("case role when 'user' then ' xml:lang=\"san-Latn\" rendition=\"class:x\"' when 'assistant' then '' else ' xml:lang=\"eng\"' end")
    quote = F.expr("case k % 3 when 0 then ' xml:lang=\"fra\"' when 2 then ' xml:lang=\"san\"' else '' end")
    p = F.concat(F.lit("<p"), start, F.lit(">"), F.when(F.col("k") % 2 == 1, said).otherwise("\n "), F.lit("<q"), quote, F.lit(">"), said, F.lit("</q><!-- c --></p>"))
    whole = turns.groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("k", p.alias("p"))))["p"], "").alias("x"))
    return nodes.kept(nodes.nodes(whole.select("conv_id", F.concat(F.lit("<TEI><text xml:lang='san'><body><div xml:lang='fra'>"), "x", F.lit("</div></body></text></TEI>")).alias("x")), "conv_id", "x"))


# A quotation's script: its own class, else its paragraph's if both are sources or both not, else that of its kind.
@query(f"""with {_SPEECHES_SQL}, i as (select conv_id, k, q, case when k % 2 = 0 then q else own end as inferred from s),
           d as (select conv_id, case when count(distinct inferred) = 1 then min(inferred) else 'fra latin' end as div, count(distinct inferred) as n from i group by conv_id)
           select conv_id as doc_id, name, split_part(lang, ' ', 1) as language, split_part(lang, ' ', 2) as script, count(*) as n from (
             select conv_id, 'p' as name, inferred as lang from i union all select conv_id, 'q', q from i
             union all select conv_id, unnest(['TEI', 'text', 'body', 'div']), div from d) group by all""")
def bubbled_languages(spark, d):
    languages = spark.createDataFrame([("san", "sanskrit", True), ("eng", "eng", False), ("fra", "fra", False)], "code string, language string, is_source boolean")
    scripts = spark.createDataFrame([("x", "brahmi", True)], "code string, script string, script_is_source boolean")
    speeches = _speeches(spark, d)
    named = trees.assigned_languages(speeches, languages, scripts).join(speeches.select("doc_id", "pre", "name"), ["doc_id", "pre"])
    return named.groupBy("doc_id", "name", "language", "script").agg(F.count("*").alias("n"))


_SAID = "replace(replace(replace(replace(concat('x', coalesce(text, '')), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(f"""with t as (select *, row_number() over (partition by conv_id order by turn) - 1 as k, {_SAID} as x from conversations)
           select conv_id as doc_id, '<TEI><text xml:lang="san"><body><div xml:lang="fra">' || string_agg(
             '<p' || case role when 'user' then ' xml:lang="san-Latn" rendition="class:x"' when 'assistant' then '' else ' xml:lang="eng"' end || '>' || case when k % 2 = 1 then x else chr(10) || ' ' end
             || '<q' || case k % 3 when 0 then ' xml:lang="fra"' when 2 then ' xml:lang="san"' else '' end || '>' || x || '</q><!-- c --></p>', '' order by k) || '</div></body></text></TEI>' as xml from t group by conv_id""")
def serialised_trees(spark, d):
    return serialise.serialise(_speeches(spark, d))


@query(f"""with t as (select *, row_number() over (partition by conv_id order by turn) - 1 as k, {_SAID} as x from conversations)
           select conv_id as doc_id, '<q' || case k % 3 when 0 then ' xml:lang="fra"' when 2 then ' xml:lang="san"' else '' end || '>' || x || '</q>' as xml from t""")
def serialised_subtrees(spark, d):
    speeches = _speeches(spark, d)
    return serialise.serialise(speeches, speeches.where("name = 'q'")).select("doc_id", "xml")


# ---- the first pattern that matches

NAMES = ("html", "head", "title", "meta", "body", "div", "article", "h1", "p", "ul", "li", "a", "span")
RULES = [
    "/html", "/title", "head/title", "meta[@charset='utf-8']", "meta[not(@charset)]", "li/a[@href]", "article//a", "div/ul/li", "ul//a", "article/h1", "html//article/p", "div[@class='content']",
    "body/div//p", "li/p", "p/p", "p//a", "a//p", "body/*[@id]", "div/div", "ul/li/ul", "script", "style", "head/*", "article/*", *NAMES, "li//*", "body/*", "*",
]


def _matched(pattern: str) -> str:
    """A pattern as a test of a tag's names from the root on; the attributes tested are the tag's own."""
    tests = re.findall(r"\[(.*?)\]", pattern)
    names = re.sub(r"\[.*?\]", "", pattern).replace("*", "[^/]+").replace("//", "/([^/]+/)*")
    found = [f"regexp_matches(path, '^{names}$')" if pattern.startswith("/") else f"regexp_matches(path, '/{names}$')"]
    for t in tests:
        name, _, value = t.removeprefix("not(").rstrip(")").removeprefix("@").partition("=")
        held = f"regexp_matches(tok, ' {name}=\"[^\"]*[^\" ][^\"]*\"')" if not value else f"""contains(tok, ' {name}="{value.strip("'")}"')"""
        found.append(f"not {held}" if t.startswith("not") else held)
    return " and ".join(found)


@query(_tree_sql(f"""select page_id, pre, name, rule::int as rule from (select *, case {" ".join(f"when {_matched(p)} then {i}" for i, p in enumerate(RULES))} end as rule
                     from (select *, array_to_string(open, '/') || '/' || name as path from tags)) where rule is not null"""))
def first_rules(spark, d):
    return dispatch.first_rules(_nodes(spark, d), RULES).withColumnRenamed("doc_id", "page_id")


# ---- pages, lines and cells

def _marked(spark, d) -> DataFrame:
    """Editions of conversations: marks before some turns, marks that don't count in headings, notes and elsewhere."""
    turns = table(spark, d, "conversations").selectExpr("*", "row_number() over (partition by conv_id order by turn) - 1 as k").withColumn("said", T.quote_xml(F.coalesce("text", F.lit(""))))
    one = F.expr("""concat(case when k % 5 = 0 then concat('<pb n="p', turn, '"/>') else '' end, case when k % 2 = 0 then concat('<lb n="', turn, '"/>') else '' end,
      case when k % 3 = 0 then concat('<milestone unit="column" n="', k, '"/>') when k % 7 = 5 then '<milestone type="pagelike"/>' else '' end, '<s>x', said, '</s>\n', case when k % 4 = 1 then '<note>see <lb n="9"/>there</note>' else '' end)""")
    whole = turns.groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("k", one.alias("x"))))["x"], "").alias("x"))
    begin = F.when(F.col("conv_id") % 3 == 0, "start").otherwise("")
    x = F.concat(F.lit("<TEI><text><body><lb/>out<div type='edition'><head>title<pb/></head><p>"), begin, "x", F.lit("</p></div><div type='apparatus'><lb/>out</div></body></text></TEI>"))
    return nodes.kept(nodes.nodes(whole.select("conv_id", x.alias("x")), "conv_id", "x"))


@query("""with t as (select *, row_number() over (partition by conv_id order by turn) - 1 as k from conversations),
  e as (select distinct conv_id, -1 as k, 0 as sub, null as unit, null as n, 'start' as data from t where conv_id % 3 = 0
        union all select conv_id, k, 0, 'page', 'p' || turn, null from t where k % 5 = 0 union all select conv_id, k, 1, 'line', turn::varchar, null from t where k % 2 = 0
        union all select conv_id, k, 2, 'cell', k::varchar, null from t where k % 3 = 0 union all select conv_id, k, 2, 'page', null, null from t where k % 3 <> 0 and k % 7 = 5
        union all select conv_id, k, 3, null, null, 'x' || coalesce(text, '') from t union all select conv_id, k, 4, null, null, chr(10) from t),
  m as (select *, sum(case when data <> chr(10) then 1 else 0 end) over (partition by conv_id order by k, sub) as texts from e),
  g as (select *, lead(unit) over (partition by conv_id, texts order by k, sub) as nx from m where unit is not null),
  f as (select c.conv_id, first from (select distinct conv_id from e) c left join (select conv_id, arg_min(unit, k * 10 + sub) as first from g where texts = 0 group by conv_id) using (conv_id)),
  s as (select conv_id, k, sub * 10 as sub, unit, n, false as phantom, null as data from g
        union all select conv_id, k, sub * 10 + 1, 'line', null, true, null from g where unit = 'page' and nx is distinct from 'line'
        union all select conv_id, k, sub * 10 + 2, 'cell', null, true, null from g where unit = 'line' and nx is distinct from 'cell' or unit = 'page' and nx is distinct from 'line' and nx is distinct from 'cell'
        union all select conv_id, -9, 0, 'page', null, true, null from f where first is distinct from 'page' union all select conv_id, -9, 1, 'line', null, true, null from f where first is null or first = 'cell'
        union all select conv_id, -9, 2, 'cell', null, true, null from f where first is null union all select conv_id, k, sub * 10, null, null, false, data from e where data is not null),
  r as (select *, count(*) filter (unit = 'page') over w as page, count(*) filter (unit = 'line') over w as line, count(*) filter (unit = 'cell') over w as cell, k * 100 + sub as o, sum(coalesce(length(data), 0)) over w - coalesce(length(data), 0) as start from s window w as (partition by conv_id order by k, sub)),
  l as (select conv_id, cell, max(page) filter (unit = 'cell') as page, max(line) filter (unit = 'cell') as line, bool_or(unit = 'cell' and phantom) as phantom, min(start) filter (unit = 'cell') as start, coalesce(string_agg(data, '' order by o) filter (data is not null), '') as text from r where cell > 0 group by conv_id, cell)
  select l.conv_id as doc_id, l.page, l.line, l.cell, coalesce(l.phantom, false) as phantom, l.start::bigint as start, (l.start + length(text))::bigint as stop, text, coalesce(p.n, '') as page_n, coalesce(i.n, '') as line_n, coalesce(c.n, '') as cell_n
  from l join r p on p.conv_id = l.conv_id and p.unit = 'page' and p.page = l.page join r i on i.conv_id = l.conv_id and i.unit = 'line' and i.line = l.line join r c on c.conv_id = l.conv_id and c.unit = 'cell' and c.cell = l.cell""")
def page_line_cells(spark, d):
    return cover.cells(_marked(spark, d))
