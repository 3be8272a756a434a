"""Queries of readers, catalogue fields, first nodes, choices and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.operators import biblio, catalog, holdings, nodes, relational, rules
from glyphmill.plans.registry import _FOLD_SQL, _nodes, _records, _SQL, _tree_sql, query
from glyphmill.session import shared_folder, table
from glyphmill.sources import readers
from glyphmill.streaming import ingest


@query("select n_nationkey as key, 'é ' || n_name as name from nation")
def edition_files_read(spark, d):
    """Nations as XML files, with letters apart from their marks; what is read is in NFC."""
    at = shared_folder(spark, "files")
    table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.concat(F.lit("é "), "n_name").alias("name")).repartition(4, "key").write.format("xml").option("rowTag", "nation").save(at)
    texts = readers.decoded(readers.edition_files(spark, at, ("part",)))
    found = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?s)<nation>(.*?)</nation>"), F.lit(1))).alias("x"))
    return found.select(F.regexp_extract("x", r"<key>(\d+)</key>", 1).cast("long").alias("key"), F.regexp_extract("x", r"<name>([^<]*)</name>", 1).alias("name"))


@query("""select n_name as name, case when n_nationkey % 3 > 0 then 't' || n_nationkey end as text, case when n_nationkey % 2 = 0 then 'd' else 'symbol' end as description, case when n_nationkey % 5 = 0 then 's' else case when n_nationkey % 3 > 0 then 't' || n_nationkey end end as search from nation
          union all select 'n' || n_nationkey, case when n_nationkey % 3 > 0 then 't' || n_nationkey end, case when n_nationkey % 2 = 0 then 'd' else 'symbol' end, case when n_nationkey % 5 = 0 then 's' else case when n_nationkey % 3 > 0 then 't' || n_nationkey end end from nation""")
def symbols_read(spark, d):
    at = shared_folder(spark, "symbols")
    cell = lambda sql: F.expr(sql)
    line = F.concat_ws("\t", F.concat("n_name", F.lit("  n"), "n_nationkey", F.lit(" "), "n_name"), cell("if(n_nationkey % 3 > 0, concat('t', n_nationkey), '')"), cell("if(n_nationkey % 2 = 0, ' d ', '')"), cell("if(n_nationkey % 5 = 0, 's', '')"))
    table(spark, d, "nation").select(line).write.text(at)
    return readers.symbols(spark, at)


@query("select doc_id, case when source like 'src1%' then 'one' when source like 'src%' then 'many' end as schema from documents")
def schema_choice(spark, d):
    return table(spark, d, "documents").select("doc_id", rules.schema_of(F.col("source"), {"src": "many", "src1": "one"}).alias("schema"))


@query(_tree_sql("select page_id, min(pre) as pre from tags where name = 'p' group by page_id"))
def xpath_first(spark, d):
    return nodes.XPath(_nodes(spark, d)).first("//p").select(F.col("doc_id").alias("page_id"), "pre")


# Hundreds of events stand for files, before and after a change: the first go, the last come, one in between gets another last event.
@query("""with b as (select event_id // 100 as f, max_by(event_type || props, event_id) as c, max(event_id) // 2000 as k from events where event_id < 5950 group by 1), n as (select event_id // 100 as f, max_by(event_type || props, event_id) as c, max(event_id) // 2000 as k from events where event_id >= 3000 group by 1)
          select 'r' || n.f as repo, case when n.c is not distinct from b.c and n.k is not distinct from b.k then 'skip' when n.k is distinct from b.k then 'all' else 'changed' end as action from n left join b on b.f = n.f""")
def due_repositories(spark, d):
    events = table(spark, d, "events").withColumn("f", F.expr("event_id div 100"))
    at = lambda rows: rows.groupBy("f").agg(F.max_by(F.concat("event_type", "props"), "event_id").alias("commit_hash"), F.expr("cast(max(event_id) div 2000 as string)").alias("code_hash")).withColumn("repo", F.concat(F.lit("r"), "f"))
    return ingest.due(at(events.where("event_id >= 3000")), at(events.where("event_id < 5950")))


@query("""with b as (select event_id // 100 as f, max(event_id) as s from events where event_id < 5950 group by 1), n as (select event_id // 100 as f, max(event_id) as s from events where event_id >= 3000 group by 1),
          c as (select 'r' || (f % 7) as repo, 'u' || f as name, case when b.s is null then 'insert' when n.s is null then 'delete' when n.s > b.s then 'update' else 'keep' end as action from b full join n using (f))
          select repo, row_number() over (partition by repo order by action, name) as position, action, name from c where action <> 'keep'""")
def file_order(spark, d):
    events = table(spark, d, "events").withColumn("f", F.expr("event_id div 100"))
    at = lambda rows: rows.groupBy("f").agg(F.max("event_id").alias("s"))
    changes = relational.change_classes(at(events.where("event_id < 5950")), at(events.where("event_id >= 3000")), "f", "s")
    return holdings.processing_order(changes.select(F.concat(F.lit("r"), F.col("f") % 7).alias("repo"), F.concat(F.lit("u"), "f").alias("name"), "action"))


@query("""select n_nationkey as id, '<span class="italics">' || n_name || '</span> <span class="smallcaps">sc</span> ' || case when n_nationkey % 2 = 0 then '<span class="nocase">n</span>' else '<span class="bold">n</span>' end || ' <link href="u">u</link> q' as title from nation""")
def rich_titles(spark, d):
    nocase = F.when(F.col("n_nationkey") % 2 == 0, "<span class='nocase'>n</span>").otherwise("<B>n</b>")
    title = F.concat(F.lit("<i>"), "n_name", F.lit("</I> <span  style='font-variant: small-caps;'>sc</span>\n  "), nocase, F.lit(' <a href="u">u</a> <q>q</q> '))
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), biblio.rich_text(title).alias("title"))


# ---- all nine fields of the catalogue

_NINE = {
    "ident": ("concat('doc', doc_id)", "'doc' || doc_id"), "repo": ("source", "source"), "title": ("substr(text, 1, 30)", "substr(text, 1, 30)"), "author": ("concat('Àuthor ', doc_id % 7)", "'Àuthor ' || (doc_id % 7)"),
    "editor": ("concat('ed ', source)", "'ed ' || source"), "editor_id": ("concat('part:', lang)", "'part:' || lang"), "lang": ("lang", "lang"), "script": ("if(lang = 'en', 'latin', 'brahmi')", "case when lang = 'en' then 'latin' else 'brahmi' end"), "summary": ("text", "text"),
}
_NINE_SQL = "i as (select doc_id, " + ", ".join(f"coalesce({_FOLD_SQL.format(sql)}, '') as {name}" for name, (_, sql) in _NINE.items()) + " from documents)"
#: Queries, and what they ask of the folded fields.
_ASKED = [
    ("author:auth", "contains(author, 'auth')"), ("ident:doc12 script:brah", "contains(ident, 'doc12') and contains(script, 'brah')"), ('title:"the" editor:src1', "contains(title, 'the') and contains(editor, 'src1')"),
    ("editor_id:\"part:de\"", "contains(editor_id, 'part:de')"), ("src19", " or ".join(f"contains({n}, 'src19')" for n in _NINE)), ("brahmi", " or ".join(f"contains({n}, 'brahmi')" for n in _NINE)), ("summary:tion AND repo:src2", "contains(summary, 'tion') and contains(repo, 'src2')"),
]


@query(f"with {_NINE_SQL} " + " union all ".join(f"select doc_id, {k} as search from i where {where}" for k, (_, where) in enumerate(_ASKED)))
def catalog_nine_fields(spark, d):
    index = catalog.folded_index(table(spark, d, "documents"), {n: F.expr(e) for n, (e, _) in _NINE.items()}, "doc_id").persist()
    found = [catalog.search(index, q, list(_NINE)).select("doc_id", F.lit(k).alias("search")) for k, (q, _) in enumerate(_ASKED)]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


# ---- entries with sigla

@query(f"""with e as ({_SQL["bib_entries"]}) select key, '<b>[S' || key || ']</b> ' || entry || ' Pages 1–' || key || '.' as entry from e""")
def bib_listed_entries(spark, d):
    location = F.array(F.struct(F.lit("page").alias("unit"), F.concat(F.lit("1-"), "key").alias("value")))
    whole = _records(spark, d).select(F.from_json(F.to_json(F.struct("key", "version", "data")), biblio.RECORD).alias("r")).select("r.*")
    return whole.where(F.col("data.itemType").isin(*biblio.ITEM_TYPES)).select("key", biblio.listed_entry(F.col("data"), location, F.concat(F.lit("S"), "key")).alias("entry"))
