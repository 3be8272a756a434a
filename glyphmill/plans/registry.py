"""All queries on the driver's tables, with their SQL counterparts for DuckDB.

The tables stand in for the catalogue's own: sources of documents for
repositories, labels for validation results, regions and nations for a
hierarchy, turns of conversations for lines of verse, events for records with
versions, pages for trees.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.functions.collate import sort_columns
from glyphmill.operators import catalog, cover, holdings, nodes, parallels, quality, relational, rules, trees
from glyphmill.session import shared_folder, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        _QUERIES[function.__name__] = function
        if sql:
            _SQL[function.__name__] = sql
        return function

    return add


# ---- production statistics

@query("select lang, count(*) as prod from (select distinct source, lang from documents) group by lang")
def lang_prod(spark, d):
    repos = table(spark, d, "documents").groupBy("source").agg(F.collect_set("lang").alias("langs"))
    return relational.production(repos.select(F.explode("langs").alias("lang")), "lang")


@query("select lang, source, count(*) as prod from documents group by lang, source")
def lang_source_prod(spark, d):
    return relational.production(table(spark, d, "documents"), "lang", "source")


@query("""select lang, sum(n)::bigint as prod, string_agg(source || ':' || n, ',' order by n desc, source) as sources
          from (select lang, source, count(*) as n from documents group by all) group by lang""")
def lang_display(spark, d):
    counts = relational.production(table(spark, d, "documents"), "lang", "source", name="n")
    total = counts.groupBy("lang").agg(F.sum("n").alias("prod"))
    return total.join(relational.ordered_counts(counts, "lang", "source", "n", "sources"), "lang").select("lang", "prod", "sources")


@query("""select source, docs, langs, labelled from
            (select source, sum(n)::bigint as docs, string_agg(lang || ':' || n, ',' order by n desc, lang) as langs
             from (select source, lang, count(*) as n from documents group by all) group by source)
          left join (select source, count(distinct doc_id) as labelled from documents join labels using (doc_id) group by source) using (source)""")
def source_display(spark, d):
    documents = table(spark, d, "documents")
    counts = relational.production(documents, "source", "lang", name="n")
    labelled = documents.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("labelled"))
    docs = counts.groupBy("source").agg(F.sum("n").alias("docs"))
    return docs.join(relational.ordered_counts(counts, "source", "lang", "n", "langs"), "source").join(labelled, "source", "left").select("source", "docs", "langs", "labelled")


@query("""select c_custkey as id, c_name as name, n_name as nation, orders, priorities from customer left join nation on c_nationkey = n_nationkey
          left join (select o_custkey, sum(n)::bigint as orders, string_agg(o_orderpriority || ':' || n, ',' order by n desc, o_orderpriority) as priorities
                     from (select o_custkey, o_orderpriority, count(*) as n from orders group by all) group by o_custkey) on o_custkey = c_custkey""")
def people_display(spark, d):
    counts = relational.production(table(spark, d, "orders"), "o_custkey", "o_orderpriority", name="n")
    orders = counts.groupBy("o_custkey").agg(F.sum("n").alias("orders")).join(relational.ordered_counts(counts, "o_custkey", "o_orderpriority", "n", "priorities"), "o_custkey")
    people = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return people.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("n_name").alias("nation"), "orders", "priorities")


@query("""select c_custkey, replace(c_name, '#', ' ') as print_name, split_part(c_name, '#', 2) || ', ' || split_part(c_name, '#', 1) as inverted_name from customer""")
def names_generated(spark, d):
    from glyphmill.sources.readers import names

    parts = table(spark, d, "customer").select("c_custkey", F.split("c_name", "#").alias("name"))
    return parts.withColumns(names("name")).drop("name")


# ---- predicates, lookups, joins, sets

@query("select json_extract(props, '$.k')::bigint as k, count(*) as n from events group by 1")
def json_props(spark, d):
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").cast("bigint").alias("k")).agg(F.count("*").alias("n"))


@query("select c_custkey as key, c_name as name from customer where c_name glob 'Customer#*[05]?'")
def glob_filter(spark, d):
    return table(spark, d, "customer").where(T.glob(F.col("c_name"), "Customer#*[05]?")).select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))


@query("""select code, id::bigint as id from (values ('3'), ('FRANCE'), ('7'), ('NOWHERE'), ('GERMANY')) v(code)
          left join (select code, min_by(id, rank * 1000 + id) as id from
            (select n_name as code, 0 as rank, n_nationkey as id from nation union all select n_nationkey::varchar, 1, n_nationkey from nation) group by code) using (code)""")
def fallback_lookup(spark, d):
    codes = spark.createDataFrame([("3",), ("FRANCE",), ("7",), ("NOWHERE",), ("GERMANY",)], "code string")
    nation = table(spark, d, "nation").select("n_name", F.col("n_nationkey").cast("string").alias("n_code"), F.col("n_nationkey").cast("bigint").alias("id"))
    return relational.first_match(codes, "code", nation, ["n_name", "n_code"], "id")


@query("""select doc_id, (case when toxic = 1 then 3 when quality = 0 then 2 when quality is null then 1 else 0 end)::bigint as status
          from documents left join labels using (doc_id)""")
def status_ladder(spark, d):
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    status = quality.ladder((F.col("quality").isNull(), quality.WARNING), (F.col("quality") == 0, quality.ERROR), (F.col("toxic") == 1, quality.FATAL))
    return joined.select("doc_id", status.cast("bigint").alias("status"))


@query("""select doc_id, source, (case when toxic = 1 then 3 else 2 end)::bigint as status from documents join labels using (doc_id) where toxic = 1 or quality = 0""")
def errors_listing(spark, d):
    listed = status_ladder(spark, d).where(F.col("status") >= quality.ERROR).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return listed.select("doc_id", "source", "status").orderBy("source", F.desc("status"), "doc_id")


@query("""select c_custkey::varchar as ident, c_name as label from customer where c_custkey in (select o_custkey from orders)
          union select '!' || o_clerk, o_clerk from (select o_orderstatus as o_clerk from orders)""")
def owners_union(spark, d):
    orders = table(spark, d, "orders")
    known = table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.col("c_custkey").cast("string").alias("ident"), F.col("c_name").alias("label"))
    others = orders.select(F.concat(F.lit("!"), "o_orderstatus").alias("ident"), F.col("o_orderstatus").alias("label"))
    return known.unionByName(others).distinct().orderBy(*sort_columns(F.col("label"), F.col("ident")))


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null)")
def anti_join(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def anti_join_labels(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("select n_nationkey from nation where n_regionkey in (select r_regionkey from region where r_name like 'A%')")
def semi_join(spark, d):
    return table(spark, d, "nation").join(table(spark, d, "region").where("r_name like 'A%'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi").select("n_nationkey")


@query("select p_name, count(*) as n from part group by p_name having count(*) > 1")
def dup_having(spark, d):
    return relational.duplicates(table(spark, d, "part"), "p_name")


@query("select count(quality) as labelled from documents left join labels using (doc_id)")
def count_non_null(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").agg(F.count("quality").alias("labelled"))


@query("select o_orderstatus as status, max(o_orderdate) as latest from orders group by 1")
def max_mtime(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.max("o_orderdate").alias("latest"))


@query("""select c_mktsegment as key, string_agg(distinct o_orderpriority, '|' order by o_orderpriority) as values
          from orders join customer on o_custkey = c_custkey group by 1""")
def collect_distinct(spark, d):
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_mktsegment").alias("key")).agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("values"))


# ---- holdings: documents with owners, editors, languages and scripts made from their numbers

_HOLDINGS_SQL = """docs as (select doc_id, source, ('f' || doc_id) as name, case when doc_id % 9 = 0 then [lang, 'x' || (doc_id % 2)] else [lang] end as langs,
      case when doc_id % 4 = 0 then []::varchar[] when doc_id % 5 = 0 then ['latn', 'deva'] else ['latn'] end as scripts,
      case when doc_id % 6 = 0 then []::varchar[] when doc_id % 10 = 1 then ['p' || (doc_id % 40)] else ['p' || (doc_id % 40), 'p' || (40 + doc_id % 7)] end as editors from documents),
    owners as (select 'f' || doc_id as name, 'u' || (doc_id % 23) as git_name from documents union select 'f' || doc_id, 'u' || (doc_id % 5) from documents where doc_id % 3 = 0),
    members as (select 'u' || c_custkey as git_name, c_custkey::varchar as member from customer where c_mktsegment in ('BUILDING', 'MACHINERY'))"""


def _documents(spark, d) -> DataFrame:
    return table(spark, d, "documents").selectExpr(
        "doc_id", "source", "concat('f', doc_id) as name", "case when doc_id % 9 = 0 then array(lang, concat('x', doc_id % 2)) else array(lang) end as langs",
        "case when doc_id % 4 = 0 then cast(array() as array<string>) when doc_id % 5 = 0 then array('latn', 'deva') else array('latn') end as scripts",
        "case when doc_id % 6 = 0 then cast(array() as array<string>) when doc_id % 10 = 1 then array(concat('p', doc_id % 40)) else array(concat('p', doc_id % 40), concat('p', 40 + doc_id % 7)) end as editors",
    )


def _owners(spark, d) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, d, "documents")
    owners = documents.selectExpr("concat('f', doc_id) as name", "concat('u', doc_id % 23) as git_name").unionByName(documents.where("doc_id % 3 = 0").selectExpr("concat('f', doc_id) as name", "concat('u', doc_id % 5) as git_name")).distinct()
    return owners, table(spark, d, "customer").where("c_mktsegment in ('BUILDING', 'MACHINERY')").selectExpr("concat('u', c_custkey) as git_name", "cast(c_custkey as string) as member")


def _languages(spark) -> tuple[DataFrame, DataFrame]:
    codes = spark.createDataFrame([("en", "eng"), ("fr", "fra"), ("de", "deu"), ("x1", "xxx")], "code string, id string")
    return codes, spark.createDataFrame([("eng", "English"), ("fra", "French"), ("deu", "German")], "id string, name string")


@query(f"""with {_HOLDINGS_SQL}, codes(code, id) as (values ('en', 'eng'), ('fr', 'fra'), ('de', 'deu'), ('x1', 'xxx')), names(id, name) as (values ('eng', 'English'), ('fra', 'French'), ('deu', 'German'))
          select doc_id, lang, codes.id as id, names.name as language from (select doc_id, unnest(langs) as lang from docs) left join codes on code = lang left join names on names.id = codes.id""")
def language_names(spark, d):
    named = holdings.with_names(holdings.listed(_documents(spark, d).select("doc_id", F.col("langs").alias("lang")), "lang"), "lang", *_languages(spark))
    return named.select("doc_id", "lang", "id", F.col("name").alias("language"))


@query(f"""with {_HOLDINGS_SQL}, l as (select doc_id, editors, unnest(langs) as lang from docs), e as (select doc_id, lang, unnest(editors) as editor from l)
          select lang, editor, count(*) as docs from e group by all""")
def language_editors(spark, d):
    pairs = holdings.listed(_documents(spark, d).select("doc_id", F.col("langs").alias("lang"), F.col("editors").alias("editor")), "lang", "editor")
    return relational.production(pairs, "lang", "editor", name="docs")


@query(f"with {_HOLDINGS_SQL} select git_name, count(*) as files, min(docs.doc_id) as first from docs join owners using (name) group by git_name")
def files_owners(spark, d):
    owners, _ = _owners(spark, d)
    return _documents(spark, d).join(owners, "name").groupBy("git_name").agg(F.count("*").alias("files"), F.min("doc_id").alias("first"))


_OWNED_SQL = f"{_HOLDINGS_SQL}, owned as (select distinct name, source as repo, coalesce(member, '!' || git_name) as ident from docs join owners using (name) left join members using (git_name))"


def _owned(spark, d) -> DataFrame:
    return holdings.owned(_documents(spark, d).select("name", F.col("source").alias("repo")), *_owners(spark, d))


@query(f"with {_OWNED_SQL} select name, repo, ident from owned")
def owned_documents(spark, d):
    return _owned(spark, d)


@query(f"with {_OWNED_SQL} select '4' as owner, name from owned where ident = '4' union all select '!u20', name from owned where ident = '!u20'")
def owner_filter(spark, d):
    found = _owned(spark, d)
    of = lambda ident: holdings.owned_by(found, ident).select(F.lit(ident).alias("owner"), "name")
    return of("4").unionByName(of("!u20"))


@query(f"""with {_OWNED_SQL}, s as (select doc_id, (case when toxic = 1 then 3 when quality = 0 then 2 when quality is null then 1 else 0 end)::bigint as status from documents left join labels using (doc_id))
          select ident as owner, count(distinct name) filter (status >= 2) as errors, max(status) as worst from owned join s on name = 'f' || doc_id group by ident""")
def errors_by_owner(spark, d):
    status = status_ladder(spark, d).select(F.concat(F.lit("f"), "doc_id").alias("name"), "status")
    return _owned(spark, d).join(status, "name").groupBy(F.col("ident").alias("owner")).agg(F.count_distinct(F.when(F.col("status") >= quality.ERROR, F.col("name"))).alias("errors"), F.max("status").alias("worst"))


def _listed_sql(of: str, by: str, name: str) -> str:
    return f"(select {by} as k, string_agg({of} || ':' || n, ',' order by n desc, {of}) as {name} from (select {by}, {of}, count(*) as n from (select *, unnest({of}s) as {of} from docs) group by all) group by 1)"


@query(f"""with {_HOLDINGS_SQL} select r.source as repo, docs, langs, scripts, editors from (select source, count(*) as docs from docs group by source) r
          left join {_listed_sql('lang', 'source', 'langs')} l on l.k = r.source left join {_listed_sql('script', 'source', 'scripts')} s on s.k = r.source
          left join {_listed_sql('editor', 'source', 'editors')} e on e.k = r.source""")
def repository_statistics(spark, d):
    documents = _documents(spark, d).withColumnRenamed("source", "repo")
    of = lambda item: holdings.counted_list(holdings.listed(documents.select("repo", f"{item}s"), f"{item}s").withColumnRenamed(f"{item}s", item), "repo", item, f"{item}s")
    repos = relational.production(documents, "repo", name="docs")
    return holdings.with_statistics(repos.select("repo"), "repo", repos, of("lang"), of("script"), of("editor"))


@query(f"""with {_HOLDINGS_SQL}, e as (select *, unnest(editors) as editor from docs), people as (select 'p' || i as person from range(60) t(i))
          select person, docs, langs, repos from people left join (select editor, count(*) as docs from e group by 1) a on a.editor = person
          left join (select editor, string_agg(lang || ':' || n, ',' order by n desc, lang) as langs from (select editor, lang, count(*) as n from (select editor, unnest(langs) as lang from e) group by all) group by 1) b on b.editor = person
          left join (select editor, string_agg(source || ':' || n, ',' order by n desc, source) as repos from (select editor, source, count(*) as n from e group by all) group by 1) c on c.editor = person""")
def people_statistics(spark, d):
    edited = holdings.listed(_documents(spark, d).withColumnRenamed("editors", "person"), "person")
    people = spark.range(60).select(F.concat(F.lit("p"), "id").alias("person"))
    langs = holdings.counted_list(holdings.listed(edited.select("person", F.col("langs").alias("lang")), "lang"), "person", "lang", "langs")
    repos = holdings.counted_list(edited, "person", "source", "repos")
    return holdings.with_statistics(people, "person", relational.production(edited, "person", name="docs"), langs, repos)


@query(f"""with {_HOLDINGS_SQL}, l as (select source, editors, unnest(langs) as lang from docs), e as (select lang, unnest(editors) as editor from l),
    up(id, root) as (values ('en', 'germanic'), ('de', 'germanic'), ('fr', 'romance'), ('es', 'romance'), ('en', 'ie'), ('de', 'ie'), ('fr', 'ie'), ('es', 'ie'))
    select distinct root, lang, (select count(*) from l l2 where l2.lang = l.lang) as prod, (select count(distinct editor) from e where e.lang = l.lang) as editors, (select count(distinct source) from l l3 where l3.lang = l.lang) as repos
    from l join up on id = lang where lang in (select lang from e)""")
def language_view(spark, d):
    documents = holdings.listed(_documents(spark, d).select("source", "editors", F.col("langs").alias("lang")), "lang")
    edited = documents.select("lang", F.explode("editors").alias("editor")).groupBy("lang").agg(F.count_distinct("editor").alias("editors"))
    repos = documents.groupBy("lang").agg(F.count_distinct("source").alias("repos"))
    tree = spark.createDataFrame([(1, "ie", None), (2, "germanic", 1), (3, "romance", 1), (4, "en", 2), (5, "de", 2), (6, "fr", 3), (7, "es", 3)], "rid int, id string, parent int")
    above = relational.closure(tree).where("depth > 0 and root is not null").join(tree.select("rid", F.col("id").alias("lang")), "rid").join(tree.select(F.col("rid").alias("root"), F.col("id").alias("above")), "root")
    return above.select(F.col("above").alias("root"), "lang").join(relational.production(documents, "lang"), "lang").join(edited, "lang").join(repos, "lang").distinct()


@query(f"""with {_HOLDINGS_SQL} select doc_id, name, source as repo, upper(source) as repo_title, n_chars as size from docs join documents using (doc_id, source) where len(langs) > 1""")
def file_details(spark, d):
    repos = table(spark, d, "documents").select("source").distinct().select("source", F.upper("source").alias("repo_title"))
    files = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("size"))
    wide = _documents(spark, d).where(F.size("langs") > 1)
    return wide.join(files, "doc_id").join(repos, "source").select("doc_id", "name", F.col("source").alias("repo"), "repo_title", "size")


@query(f"""with {_HOLDINGS_SQL} select editor, count(*) as docs from (select unnest(editors) as editor from docs) join (select 'p' || i as person from range(44) t(i)) on person = editor group by editor""")
def known_editors(spark, d):
    # A left join whose right side is then required is an inner one.
    people = spark.range(44).select(F.concat(F.lit("p"), "id").alias("editor"))
    return relational.production(_documents(spark, d).select(F.explode("editors").alias("editor")).join(people, "editor"), "editor", name="docs")


@query(f"""with {_HOLDINGS_SQL}, p as (select distinct lang, script from (select lang, unnest(scripts) as script from (select scripts, unnest(langs) as lang from docs)))
          select 'lang' as side, lang as key, string_agg(script, ',' order by script) as others from p group by lang union all select 'script', script, string_agg(lang, ',' order by lang) from p group by script""")
def language_scripts(spark, d):
    pairs = holdings.listed(_documents(spark, d).select(F.col("langs").alias("lang"), F.col("scripts").alias("script")), "lang", "script")
    return holdings.both_ways(pairs, "lang", "script")


@query("""select user_id as file, string_agg(distinct event_type, ',' order by event_type) as authors, 'c' || max_by(event_id, (epoch_us(ts), 'c' || event_id)) as last_commit, max(ts) as last_modified from events group by user_id""")
def git_metadata(spark, d):
    commits = table(spark, d, "events").select(F.col("user_id").alias("file"), "ts", F.concat(F.lit("c"), "event_id").alias("commit"), "event_type")
    return holdings.last_commits(commits, "file", "ts", "commit", "event_type")


@query("""with o as (select distinct user_id as k, 'old' as v from events where event_id < 3000), n as (select user_id as k, min(event_type) as v from events where event_id >= 3000 group by 1)
          select * from o union all select * from n where k not in (select k from o)""")
def insert_ignore(spark, d):
    events = table(spark, d, "events")
    old = events.where("event_id < 3000").select(F.col("user_id").alias("k"), F.lit("old").alias("v")).distinct()
    return holdings.insert_new(old, events.where("event_id >= 3000").select(F.col("user_id").alias("k"), F.col("event_type").alias("v")), "k")


@query("""with o as (select user_id as k, max(event_id) as a, count(*) as b from events where event_id < 6000 group by 1), n as (select user_id as k, min(event_id) as a from events where event_id >= 4000 group by 1)
          select coalesce(o.k, n.k) as k, coalesce(n.a, o.a) as a, b from o full join n using (k)""")
def update_two_columns(spark, d):
    events = table(spark, d, "events")
    old = events.where("event_id < 6000").groupBy(F.col("user_id").alias("k")).agg(F.max("event_id").alias("a"), F.count("*").alias("b"))
    return holdings.update_columns(old, events.where("event_id >= 4000").groupBy(F.col("user_id").alias("k")).agg(F.min("event_id").alias("a")), "k", "a")


@query("""select c_custkey as k, greatest(1, least(c_custkey, greatest(ceil(n / 100.0), 1)))::bigint as page, greatest(ceil(n / 100.0), 1)::bigint as pages,
            least((greatest(1, least(c_custkey, greatest(ceil(n / 100.0), 1))) - 1) * 100 + 1, n)::bigint as first, least(greatest(1, least(c_custkey, greatest(ceil(n / 100.0), 1))) * 100, n)::bigint as last
          from (select c_custkey, (select count(*) from orders o where o.o_custkey = c.c_custkey) * 37 as n from customer c)""")
def page_clamp(spark, d):
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg((F.count("*") * 37).alias("n"))
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("k")).join(orders, "k", "left").fillna({"n": 0})
    return asked.select("k", holdings.page_bounds(F.col("k"), F.col("n"), 100).alias("p")).select("k", "p.*")


@query("""select event_id, '{"k":"' || json_extract_string(props, '$.k') || '","type":"' || event_type || '","user":"' || user_id || '"}' as json from events""")
def json_compact(spark, d):
    pairs = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("type"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k"))
    return table(spark, d, "events").select("event_id", holdings.json_text(pairs).alias("json"))


@query(f"""with {_HOLDINGS_SQL} select doc_id, array_to_string(list_sort(list_filter(editors, lambda x: not list_contains(['p1', 'p2', 'p41', 'p45'], x))), ',') as others,
            len(editors)::int as n, editors[1] as first, array_to_string(case when len(scripts) > 0 then scripts else ['source_other'] end, ',') as scripts from docs""")
def array_functions(spark, d):
    known = F.array(*[F.lit(x) for x in ("p1", "p2", "p41", "p45")])
    return _documents(spark, d).select(
        "doc_id", F.array_join(holdings.without(F.col("editors"), known), ",").alias("others"), F.size("editors").alias("n"), F.get("editors", F.lit(0)).alias("first"),
        F.array_join(holdings.defaulted(F.col("scripts"), "source_other"), ",").alias("scripts"),
    )


@query("select c_custkey as key, c_name as name, c_acctbal as balance from customer")
def jsonl_backup(spark, d):
    at = _scratch(spark, "backup")
    holdings.backup(table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")), "key", at)
    return spark.read.schema("key bigint, name string, balance double").json(at)


# ---- windows and pages

@query("""select o_orderkey as key, (row_number() over (order by o_orderkey) - 1)::bigint as pos, ((row_number() over (order by o_orderkey) - 1) // 100 + 1)::bigint as page from orders""")
def row_number_page(spark, d):
    keys = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"))
    placed = relational.positions(keys, relational.range_bucket(keys, "key", 100_000), ["key"])
    return placed.select("key", "pos", F.expr("pos div 100 + 1").alias("page"))


@query("select conv_id, turn, row_number() over (partition by conv_id order by turn)::bigint as n from conversations")
def doc_order_number(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("bigint").alias("n"))


@query("""select conv_id, turn, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn) as last_user_turn from conversations""")
def carry_forward(spark, d):
    return relational.carried(table(spark, d, "conversations"), "conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")), "last_user_turn").select("conv_id", "turn", "last_user_turn")


@query("""select conv_id, segment, role, count(*) as n from
            (select conv_id, role, sum(new) over (partition by conv_id order by turn)::bigint as segment from
              (select *, case when lag(role) over (partition by conv_id order by turn) is not distinct from role and row_number() over (partition by conv_id order by turn) > 1 then 0 else 1 end as new from conversations))
          group by all""")
def run_segments(spark, d):
    return relational.runs(table(spark, d, "conversations"), "conv_id", "turn", "role").select("conv_id", F.col("segment").cast("bigint").alias("segment"), "role", "n")


@query("""select c_custkey as key, c_name as name, (select count(*) from customer where c_acctbal > 0) as total
          from customer where c_acctbal > 0 order by c_name, c_custkey limit 50 offset 50""")
def page_limit_offset(spark, d):
    found = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return relational.page(found, sort_columns(F.col("name"), F.col("key")), 2, 50)


# ---- hierarchies

def _tree(spark, d) -> DataFrame:
    top = spark.createDataFrame([(0, "world", None)], "rid int, id string, parent int")
    regions = table(spark, d, "region").select((F.col("r_regionkey") + 100).alias("rid"), F.col("r_name").alias("id"), F.lit(0).alias("parent"))
    nations = table(spark, d, "nation").select((F.col("n_nationkey") + 1000).alias("rid"), F.col("n_name").alias("id"), (F.col("n_regionkey") + 100).alias("parent"))
    return top.unionByName(regions).unionByName(nations)


_TREE_SQL = """tree(rid, parent) as (select 0, null union all select r_regionkey + 100, 0 from region union all select n_nationkey + 1000, n_regionkey + 100 from nation),
               up(rid, root, depth) as (select rid, rid, 0 from tree union all select up.rid, tree.parent, depth + 1 from up join tree on up.root = tree.rid)"""


@query(f"with recursive {_TREE_SQL} select rid::int as rid, root::int as root, depth::int as depth from up")
def closure(spark, d):
    return relational.closure(_tree(spark, d))


@query(f"""with recursive {_TREE_SQL} select root::int as root, count(c_custkey) as customers from up join customer on c_nationkey + 1000 = rid where root is not null group by root""")
def subtree_prod(spark, d):
    counts = relational.production(table(spark, d, "customer").select((F.col("c_nationkey") + 1000).alias("rid")), "rid", name="n")
    return relational.closure(_tree(spark, d)).where("root is not null").join(counts, "rid").groupBy("root").agg(F.sum("n").alias("customers"))


@query(f"""with recursive {_TREE_SQL} select n_nationkey, n_name from nation where n_nationkey + 1000 in (select rid from up where root = 102)""")
def subtree_filter(spark, d):
    tree = _tree(spark, d)
    nation = table(spark, d, "nation").select((F.col("n_nationkey") + 1000).alias("rid"), "n_nationkey", "n_name")
    return relational.below(nation, relational.closure(tree), 102).select("n_nationkey", "n_name")


# ---- text

_FOLD_SQL = "trim(replace(replace(replace(replace(lower(strip_accents({0})), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae'), 'đ', 'd'), ' ' || chr(10))"


@query(f"select doc_id, {_FOLD_SQL.format('text')} as folded from documents")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.fold(F.col("text")).alias("folded"))


@query("select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') as text from documents")
def normalize_space(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize_space(F.col("text")).alias("text"))


_TRIGRAMS_SQL = "list_distinct([substr({0}, i, 3) for i in range(1, length({0}) - 1)])"


@query(f"select item_id, len({_TRIGRAMS_SQL.format('text')})::bigint as n from benchmark")
def trigram_counts(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.size(T.trigrams(F.col("text"))).cast("bigint").alias("n"))


@query(f"""with s as (select item_id, {_TRIGRAMS_SQL.format('text')} as g from benchmark)
           select a.item_id as id1, b.item_id as id2, ((1000000 * len(list_intersect(a.g, b.g))) // (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))))::double / 1e6 as coeff
           from s a join s b on b.item_id = a.item_id + 1""")
def jaccard_pairs_scalar(spark, d):
    s = table(spark, d, "benchmark").select("item_id", T.trigrams(F.col("text")).alias("g"))
    nxt = s.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("id2"), F.col("g").alias("h"))
    return s.join(nxt, "item_id").select(F.col("item_id").alias("id1"), "id2", (F.floor(T.jaccard(F.col("g"), F.col("h")) * 1e6 + 1e-7) / 1e6).alias("coeff"))


@query(r"""select conv_id, turn, upper(substr(w, 1, 1)) || lower(substr(w, 2)) || substr(text, length(w) + 1) as sentence, regexp_replace(text, '\s+', ' ', 'g') as squeezed, length_grapheme(text)::int as graphemes,
            case role when 'user' then true when 'assistant' then false end as boolean,
            trim(replace(regexp_replace(replace(lower(text), chr(39), '’'), '[^\p{L}\p{M}\s’]', '', 'g'), '’', 'a'), ' ' || chr(10)) as folded,
            trim(regexp_replace(translate(replace(regexp_replace(text, '\[[0-9]+.*?\]', '', 'g'), '[]', ''), '_әʼ' || chr(39) || '◉◆“”.+\,|/"॥।*!', ' ə’’'), '\s+', ' ', 'g'), ' ') as clean,
            trim(regexp_replace(text || ' ', '[ \t]+(\n|$)', '\1', 'g'), chr(10)) || chr(10) as filed,
            'ka' || turn || 'k' || turn % 2 as latin
          from (select *, regexp_extract(text, '^(\S*)', 1) as w from conversations)""")
def text_values(spark, d):
    turns = table(spark, d, "conversations")
    tamil = F.concat(F.lit("க"), F.translate(F.col("turn").cast("string"), "0123456789", "௦௧௨௩௪௫௬௭௮௯"), F.lit("க்"), F.translate((F.col("turn") % 2).cast("string"), "01", "௦௧"))
    return turns.select(
        "conv_id", "turn", T.sentence_case(F.col("text")).alias("sentence"), T.squeeze(F.col("text")).alias("squeezed"), F.size(T.graphemes(F.col("text"))).alias("graphemes"),
        T.to_boolean(F.when(F.col("role") == "user", " Yes").when(F.col("role") == "assistant", "OFF").otherwise("?")).alias("boolean"),
        T.fold_passage(F.replace("text", F.lit("'"), F.lit("’"))).alias("folded"), T.clean_passage(F.col("text")).alias("clean"), T.clean_file(F.col("text")).alias("filed"), T.tamil_to_latin(tamil).alias("latin"),
    )


@query("""select page_id, '/pages/' || replace(replace(url_encode(url), '%2F', '/'), '%3A', ':') as address, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)[.][^.]*$', '\\1') as base,
            substr(md5(url), 1, 7) as commit, replace(html, 'href="/', 'href="https://a.b/') as html from pages""")
def address_values(spark, d):
    from glyphmill.functions import web

    pages = table(spark, d, "pages")
    return pages.select("page_id", web.format_url("/pages/%s", F.col("url")).alias("address"), web.base_name(F.col("url")).alias("base"), web.format_commit(F.md5(F.col("url").cast("binary"))).alias("commit"), web.absolute_links("https://a.b/c/")(F.col("html")).alias("html"))


@query("""select event_id, '10.' || user_id || '/x' as doi, case when event_id % 3 > 0 then user_id || case when user_id % 100 in (11, 12, 13) then 'th' when user_id % 10 = 1 then 'st' when user_id % 10 = 2 then 'nd' when user_id % 10 = 3 then 'rd' else 'th' end || ' edition' else 'revised' end as edition,
            event_id % 2 = 0 as several, case event_id % 2 when 0 then '⏑–' || event_id || '⏓||' else '⏖|⏑' end as pattern from events""")
def entry_values(spark, d):
    from glyphmill.functions import prosody
    from glyphmill.operators import biblio

    events = table(spark, d, "events")
    edition = F.when(F.col("event_id") % 3 > 0, F.col("user_id").cast("string")).otherwise("revised")
    pages = F.when(F.col("event_id") % 2 == 0, F.concat("user_id", F.lit("–9"))).otherwise(F.col("user_id").cast("string"))
    pattern = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("-+0"), F.lpad(F.col("event_id").cast("string"), 7, "0"), F.lit("=॥"))).otherwise("2।-")
    return events.select("event_id", biblio.clean_doi(F.concat(F.lit("https://doi.org/10."), "user_id", F.lit("/x"))).alias("doi"), biblio.ordinal_edition(edition).alias("edition"), biblio.is_page_range(pages).alias("several"), F.regexp_replace(prosody.render_pattern(pattern), "0*([0-9]+)", "$1").alias("pattern"))


@query("""select 'r' || r_regionkey as name, r_regionkey % 2 = 0 as textual, r_name as title, null as dh_id from region union all select n_name, null, null, 'm' || n_nationkey from nation""")
def tab_tables(spark, d):
    from glyphmill.sources import readers

    base = _scratch(spark, "tables")
    line = lambda *cells: F.concat_ws("\t", *cells).alias("value")
    table(spark, d, "region").select(line(F.concat(F.lit("r"), "r_regionkey"), F.when(F.col("r_regionkey") % 2 == 0, "true").otherwise("false"), F.concat(F.lit("  "), "r_name"))).write.text(f"{base}/repos")
    table(spark, d, "nation").select(line("n_name", F.concat(F.lit("m"), "n_nationkey"))).write.text(f"{base}/names")
    repos = readers.repositories(spark, f"{base}/repos").select("name", "textual", "title", F.lit(None).cast("string").alias("dh_id"))
    return repos.unionByName(readers.git_names(spark, f"{base}/names").select(F.col("git_name").alias("name"), F.lit(None).cast("boolean").alias("textual"), F.lit(None).cast("string").alias("title"), "dh_id"))


@query("""select user_id::varchar as name, case when user_id < 5 then 'repository' else 'junk' end as action, count(*) as n from events where event_type <> 'error' group by 1, 2 union all select 'all', 'all', 1 union all select 'bib', 'bib', 1""")
def routed_events(spark, d):
    from glyphmill.streaming import ingest

    events = table(spark, d, "events")
    push = F.to_json(F.struct(F.struct(F.col("user_id").cast("string").alias("name")).alias("repository"), F.array(F.struct(F.struct(F.when(F.col("event_type") == "error", "robot@x").otherwise("a@b").alias("email")).alias("author"))).alias("commits")))
    pushed = ingest.webhook_names(events.select(push.alias("value")), ["robot@x"]).select(F.concat(F.lit(" "), "name").alias("value"))
    lines = pushed.unionByName(spark.createDataFrame([("all",), ("bib",)], "value string"))
    known = spark.range(5).select(F.col("id").cast("string").alias("repo"))
    return ingest.routed(lines, known).groupBy("name", "action").agg(F.count("*").alias("n"))


# ---- parallel passages

_PAIRS_SQL = f"""s as (select conv_id * 1000 + turn as id, {_TRIGRAMS_SQL.format('lower(text)')} as g from conversations),
    c as (select a.id as id1, b.id as id2, len(list_intersect(a.g, b.g)) as inter, len(a.g) + len(b.g) as n2 from s a join s b on a.id < b.id),
    pairs as (select id1, id2, ((1000000 * inter) // (n2 - inter))::double / 1e6 as coeff from c where 10 * inter >= 3 * (n2 - inter))"""


def _turns_of(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")


def _pairs(spark, d) -> DataFrame:
    return parallels.similar_pairs(_turns_of(spark, d), "id", F.lower("text"))


def _parallels(spark, d) -> DataFrame:
    return parallels.similar_counts(_turns_of(spark, d), "id", F.lower("text"))


@query(f"with {_PAIRS_SQL} select id1, id2, coeff from pairs")
def jaccard_selfjoin(spark, d):
    return _pairs(spark, d).select("id1", "id2", parallels.coefficient().alias("coeff"))


@query(f"with {_PAIRS_SQL} select id1 as id, id2, coeff from pairs union all select id2, id1, coeff from pairs")
def jaccard_symmetric(spark, d):
    return parallels.mirrored(_pairs(spark, d))


@query(f"""with {_PAIRS_SQL}, b as (select id1 as id from pairs union all select id2 from pairs)
          select conv_id * 1000 + turn as id, coalesce(n, 0)::bigint as parallels from conversations left join (select id, count(*) as n from b group by id) on id = conv_id * 1000 + turn""")
def parallels_per_passage(spark, d):
    ids = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    return parallels.parallel_counts(_parallels(spark, d), ids, "id")


@query(f"""with {_PAIRS_SQL}, b as (select distinct id from (select id1 as id from pairs union all select id2 from pairs))
          select conv_id, count(*) filter (role = 'user') as users, count(*) filter (role = 'assistant') as assistants from conversations join b on id = conv_id * 1000 + turn group by conv_id""")
def parallels_by_source(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "role", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    found = turns.join(_parallels(spark, d), "id", "left_semi")
    return found.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("users"), F.count_if(F.col("role") == "assistant").alias("assistants"))


@query("""with n as (select conv_id, text, row_number() over (partition by conv_id order by turn) - 1 as ix, count(*) over (partition by conv_id) as n from conversations),
          g as (select type, size, conv_id, n, ix // size as g, string_agg(chr((97 + ix)::int), '' order by ix) as letters, string_agg(text, ' ' order by ix) as t
                from n, (values (1, 4), (2, 2), (4, 1)) k(type, size) where (ix // size + 1) * size <= n group by all)
          select type::int as type, conv_id, conv_id || case when type = 1 and n <= 4 then '' else letters end as number, regexp_replace(' ' || t || ' ', '\\s{2,}', ' ', 'g') as text from g""")
def passages(spark, d):
    return parallels.passages(table(spark, d, "conversations"), "conv_id", "turn", "text")


@query("""select conv_id, (count(*) // 4)::bigint as verses, (count(*) // 2)::bigint as hemistiches, count(*) as padas from conversations group by conv_id""")
def parallels_counts_pivot(spark, d):
    kinds = parallels.passages(table(spark, d, "conversations"), "conv_id", "turn", "text")
    count = lambda kind: F.count_if(F.col("type") == kind)
    return kinds.groupBy("conv_id").agg(count(parallels.VERSE).alias("verses"), count(parallels.HEMISTICH).alias("hemistiches"), count(parallels.PADA).alias("padas"))


@query(f"""with q as (select item_id, {_TRIGRAMS_SQL.format('text')} as g from benchmark),
    s as (select conv_id * 1000 + turn as id, {_TRIGRAMS_SQL.format('text')} as g from conversations),
    c as (select item_id, id, len(list_intersect(q.g, s.g)) as inter, len(q.g) + len(s.g) as n2 from q, s),
    r as (select item_id, id, ((1000000 * inter) // (n2 - inter))::double / 1e6 as coeff from c where inter > 0)
    select item_id, id, coeff, total from (select *, count(*) over (partition by item_id) as total, row_number() over (partition by item_id order by coeff desc, id) as k from r) where k <= 50""")
def parallels_search(spark, d):
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return parallels.nearest(table(spark, d, "benchmark").select("item_id", F.col("text").alias("q")), "item_id", F.col("q"), turns, "id", F.col("text"))


@query(f"""with q as (select item_id, {_TRIGRAMS_SQL.format('text')} as g from benchmark),
    s as (select doc_id, {_TRIGRAMS_SQL.format('text')} as g from documents),
    c as (select item_id, doc_id, len(list_intersect(q.g, s.g)) as inter, len(q.g) + len(s.g) as n2 from q, s),
    r as (select item_id, doc_id, ((1000000 * inter) // (n2 - inter))::double / 1e6 as coeff from c where inter > 0)
    select item_id, doc_id, coeff, total from (select *, count(*) over (partition by item_id) as total, row_number() over (partition by item_id order by coeff desc, doc_id) as k from r) where k <= 50""")
def parallels_search_documents(spark, d):
    passages = table(spark, d, "benchmark").select("item_id", F.col("text").alias("q"))
    return parallels.nearest(passages, "item_id", F.col("q"), table(spark, d, "documents").select("doc_id", "text"), "doc_id", F.col("text"))


# ---- catalogue

FIELDS = ["ident", "repo", "lang", "summary"]
LANGUAGES = {"en": ["english"], "fr": ["french"], "de": ["german"], "es": ["spanish", "castilian"]}


def _index(spark, d) -> DataFrame:
    own = {"ident": F.col("doc_id"), "repo": F.col("source"), "lang": F.col("lang"), "summary": F.col("text")}
    return catalog.folded_index(table(spark, d, "documents"), own, "doc_id")


def _found(spark, d, q: str, number: int = 1) -> DataFrame:
    found = catalog.search(_index(spark, d), q, FIELDS, {k: k for k in LANGUAGES}, LANGUAGES).select("doc_id", F.col("repo").alias("source"), "lang").persist()
    # Kept for the page and its total, so that the texts are folded once.
    return relational.page(found, [F.col("doc_id")], number, catalog.PER_PAGE).select("doc_id", "source", "lang", "total")


_SUMMARY = _FOLD_SQL.format("text")


def _page_sql(where: str, number: int = 1) -> str:
    return f"""with i as (select doc_id, source, lang, {_SUMMARY} as summary from documents), f as (select * from i where {where})
               select doc_id, source, lang, (select count(*) from f) as total from f order by doc_id limit 50 offset {50 * (number - 1)}"""


@query(_page_sql("contains(doc_id::varchar, 'mentoi') or contains(source, 'mentoi') or contains(lang, 'mentoi') or contains(summary, 'mentoi')"))
def catalog_search_unscoped(spark, d):
    return _found(spark, d, "Mentoi")


@query(_page_sql("contains(source, 'src1') and contains(summary, 'tion')", 2))
def catalog_search_scoped(spark, d):
    return _found(spark, d, 'repo:src1 AND summary:"tion"', 2)


@query(_page_sql("false"))
def catalog_search_short(spark, d):
    return _found(spark, d, "en summary:tion")


@query(_page_sql("lang = 'es'"))
def catalog_search_lang_name(spark, d):
    return _found(spark, d, "lang:Castil")


@query(_page_sql("lang = 'de' and contains(summary, 'keit')"))
def catalog_search_lang_code(spark, d):
    return _found(spark, d, "lang:de keit")


@query(_page_sql("true", 3))
def catalog_search_all(spark, d):
    return _found(spark, d, "", 3)


@query(f"""with i as (select doc_id, source, {_SUMMARY} as summary from documents)
           select doc_id from i where contains(source, 'src1') and (contains(summary, 'ation') or not contains(summary, 'ing'))""")
def boolean_query(spark, d):
    return catalog.search_boolean(_index(spark, d), "repo:src1 and (summary=ation or not summary:ing)", FIELDS).select("doc_id")


@query("""with p as (select item_id, string_split(lower(text), 'ti') as parts from benchmark),
          e as (select item_id, parts, unnest(range(1, len(parts))) as i from p)
          select item_id, (list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * 2)::bigint as start, 2::bigint as length from e""")
def match_offsets(spark, d):
    return catalog.occurrences(table(spark, d, "benchmark").withColumn("low", F.lower("text")), "item_id", F.col("low"), "ti")


@query("""with p as (select doc_id, string_split(lower(text), 'ti') as parts from documents where contains(lower(text), 'ti')),
          e as (select doc_id, unnest(range(1, len(parts) + 1)) as i, unnest(parts) as part from p),
          s as (select doc_id, i, (sum(length(part) + 2) over (partition by doc_id order by i) - 2)::bigint as start, max(i) over (partition by doc_id) as n from e)
          select doc_id, start, 2::bigint as length from s where i < n""")
def match_offsets_documents(spark, d):
    return catalog.occurrences(table(spark, d, "documents").withColumn("low", F.lower("text")), "doc_id", F.col("low"), "ti")


_FOLDED = "replace(replace(lower(text), 'ß', 'ss'), 'œ', 'oe')"


@query(f"""with c as (select doc_id, text, string_split(text, '') as cs from documents where contains({_FOLDED}, 'ss')),
          x as (select doc_id, unnest(cs) as c, unnest(range(0, len(cs))) as i from c),
          f as (select doc_id, i, case when c = 'ß' then 'ss' when c in ('œ', 'Œ') then 'oe' when c in ('æ', 'Æ') then 'ae' when c in ('đ', 'Đ') then 'd' else lower(c) end as f from x),
          p as (select doc_id, i, f, (sum(length(f)) over (partition by doc_id order by i))::bigint as stop from f),
          w as (select doc_id, string_split(string_agg(f, '' order by i), 'ss') as parts from p group by doc_id),
          m as (select doc_id, unnest(range(1, len(parts) + 1)) as k, unnest(parts) as part from w),
          s as (select doc_id, (sum(length(part) + 2) over (partition by doc_id order by k) - 2)::bigint as place, k, max(k) over (partition by doc_id) as n from m),
          h as (select s.doc_id, s.place, min(p.i) as start, max(p.i) as last from s join p on p.doc_id = s.doc_id and p.stop - length(p.f) < s.place + 2 and p.stop > s.place where k < n group by all),
          g as (select *, coalesce(lag(last) over (partition by doc_id order by place), -1) as before from h)
          select doc_id, greatest(start, before + 1)::bigint as start, (last - greatest(start, before + 1) + 1)::bigint as length from g where last > before""")
def display_matches(spark, d):
    return catalog.display_matches(table(spark, d, "documents"), "doc_id", "text", "ss")


# ---- records with versions

@query("""with b as (select user_id, max(event_id) as s from events where event_id < 6000 group by 1), n as (select user_id, max(event_id) as s from events where event_id >= 3000 group by 1)
          select user_id, case when b.s is null then 'insert' when n.s is null then 'delete' when n.s > b.s then 'update' else 'keep' end as action
          from b full join n using (user_id)""")
def change_classes(spark, d):
    events = table(spark, d, "events")
    at = lambda rows: rows.groupBy("user_id").agg(F.max("event_id").alias("s"))
    return relational.change_classes(at(events.where("event_id < 6000")), at(events.where("event_id >= 3000")), "user_id", "s")


@query("select user_id, max(event_id) as version, max_by(value, event_id) as value from events group by user_id")
def cdc_latest(spark, d):
    return relational.latest(table(spark, d, "events"), "user_id", "event_id", "value").select("user_id", F.col("event_id").alias("version"), "value")


@query("""select * from (select user_id, max(event_id) as version, max_by(value, event_id) as value, max_by(event_type, event_id) as kind from events group by user_id) where kind <> 'purchase'""")
def cdc_delete(spark, d):
    newest = relational.latest(table(spark, d, "events"), "user_id", "event_id", "value", "event_type")
    return newest.where("event_type <> 'purchase'").select("user_id", F.col("event_id").alias("version"), "value", F.col("event_type").alias("kind"))


@query("""with o as (select user_id as key, max_by(value, event_id) as value from events where event_id < 5000 group by 1), n as (select user_id as key, max_by(value, event_id) as value from events where event_id >= 5000 group by 1)
          select * from n union all select * from o where key not in (select key from n)""")
def upsert_merge(spark, d):
    events = table(spark, d, "events")
    rows = lambda part: relational.latest(part, "user_id", "event_id", "value").select(F.col("user_id").alias("key"), "value")
    return relational.upsert(rows(events.where("event_id < 5000")), rows(events.where("event_id >= 5000")), "key")


def _records(spark, d) -> DataFrame:
    data = """named_struct('itemType', case when event_type = 'purchase' then 'book' when event_type = 'click' then 'journalArticle' else event_type end,
      'shortTitle', case when event_id % 7 = 0 then ' ' else concat('k', get_json_object(props, '$.k')) end, 'title', '', 'date', case when user_id % 5 = 0 then 'n.d.' else cast(user_id as string) end,
      'extra', case when event_id % 11 = 0 then concat('Shorthand: S', event_id) end, 'pages', '', 'DOI', '', 'url', '', 'deleted', cast(event_id % 13 = 0 as int),
      'creators', array(named_struct('creatorType', 'author', 'firstName', 'A', 'lastName', concat('N', user_id % 10), 'name', '')), 'tags', cast(array() as array<struct<tag:string>>))"""
    return table(spark, d, "events").select(F.col("event_id").cast("string").alias("key"), F.col("event_id").alias("version"), F.expr(data).alias("data"))


_BIB_SQL = """r as (select event_id, event_id::varchar as key, case when event_id % 7 <> 0 then 'k' || json_extract_string(props, '$.k') end as short_title, event_id % 13 = 0 as deleted,
    case when event_type in ('purchase', 'click') then
      coalesce(case when event_id % 11 = 0 then 'S' || event_id end, 'N' || (user_id % 10) || ', A' || case when user_id % 5 = 0 then '' else ' ' || user_id end) || ' ' || event_id end as sort_key from events)"""


@query(f"with {_BIB_SQL} select key, sort_key from r")
def bib_sort_key(spark, d):
    from glyphmill.operators import biblio

    return _records(spark, d).select("key", biblio.sort_key(F.col("key"), F.col("data")).alias("sort_key"))


@query(f"with {_BIB_SQL} select short_title, max(event_id) as version, max_by(sort_key, event_id) as sort_key from r where short_title is not null and sort_key is not null and not deleted group by 1")
def bib_admission(spark, d):
    from glyphmill.operators import biblio

    return biblio.admitted(_records(spark, d)).select("short_title", "version", "sort_key")


@query("""select 'discount in range' as rule, count(*) as violations from lineitem where l_discount < 0 or l_discount > 1
          union all select 'order exists', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders)
          union all select 'order key unique', count(*) from (select o_orderkey from orders group by 1 having count(*) > 1)
          union all select 'customer name shape', count(*) from customer where not regexp_matches(c_name, '^Customer#[0-9]+$')
          union all select 'positive balance', count(*) from customer where c_acctbal < 0""")
def constraints_report(spark, d):
    lineitem, orders, customer = (table(spark, d, n) for n in ("lineitem", "orders", "customer"))
    return relational.violations({
        "discount in range": lineitem.where("l_discount < 0 or l_discount > 1"),
        "order exists": relational.orphans(lineitem, "l_orderkey", orders.select("o_orderkey"), "o_orderkey"),
        "order key unique": relational.duplicates(orders, "o_orderkey"),
        "customer name shape": customer.where(~F.col("c_name").rlike("^Customer#[0-9]+$")),
        "positive balance": customer.where("c_acctbal < 0"),
    })


@query(r"""select 'props json object' as rule, count(*) as violations from events where try_cast(props as json) is null or json_type(props) <> 'OBJECT'
          union all select 'event_type one of click view', count(*) from events where event_type not in ('click', 'view')
          union all select 'user_id length 1 2', count(*) from events where length(user_id::varchar) not between 1 and 2
          union all select 'value integer', count(*) from events where not regexp_full_match(value::varchar, '[+-]?[0-9]+')""")
def type_checks(spark, d):
    checks = {"props": "json object", "event_type": "one of click view", "user_id": "length 1 2", "value": "integer"}
    return relational.violations(relational.type_rules(table(spark, d, "events"), **checks))


@query("select page_id, try_cast(nullif(regexp_extract(url, '[?&]page=(\\d+)', 1), '') as int) as page from pages")
def url_page(spark, d):
    from glyphmill.functions import web

    return table(spark, d, "pages").select("page_id", web.page_of(F.col("url")).try_cast("int").alias("page"))


@query("select page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') as quoted from pages")
def quote_xml(spark, d):
    return table(spark, d, "pages").select("page_id", T.quote_xml(F.col("html")).alias("quoted"))


@query("""select 'report' || (user_id % 5) as report, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') as at, count(*)::varchar || case when count(*) = 1 then ' event' else ' events' end as n from events group by 1, 2""")
def formatted_counts(spark, d):
    from glyphmill.functions import web

    events = table(spark, d, "events")
    seconds = F.unix_seconds(F.date_trunc("minute", F.col("ts").cast("timestamp")))
    counted = events.groupBy(F.concat(F.lit("report"), F.col("user_id") % 5).alias("report"), web.format_date(seconds).alias("at")).agg(F.count("*").alias("c"))
    return counted.select("report", "at", web.count_of(F.col("c"), "event").alias("n"))


@query(f"""with {_BIB_SQL}, e as (select event_id, user_id, event_type from events where event_type in ('purchase', 'click'))
          select event_id::varchar as key, 'N' || (user_id % 10) || ' ' || case when user_id % 5 = 0 then 'n.d.' else user_id::varchar end as reference from e""")
def bib_reference(spark, d):
    from glyphmill.operators import biblio

    records = _records(spark, d).where(F.col("data.itemType").isin("book", "journalArticle"))
    return records.select("key", biblio.reference(F.col("data")).alias("reference"))


_RANGES_SQL = "case event_id % 3 when 0 then ', p.' || chr(160) || (event_id % 50) when 1 then ', pp.' || chr(160) || (event_id % 50) || '–' || (event_id % 50 + 7) || ', n.' || chr(160) || '3' else '' end"


@query(f"""with {_BIB_SQL}, e as (select event_id, user_id from events where event_type in ('purchase', 'click'))
          select event_id::varchar as key, case when event_id % 11 = 0 then 'S' || event_id else 'N' || (user_id % 10) || ' ' || case when user_id % 5 = 0 then 'n.d.' else user_id::varchar end end || {_RANGES_SQL} as reference,
            case when event_id % 11 = 0 then 'S' || event_id when user_id % 5 = 0 then 'n.d.' else user_id::varchar end || {_RANGES_SQL} as omitname, 'ibid.' || {_RANGES_SQL} as ibid,
            coalesce(case when event_id % 4 = 0 then 'A' end, case when event_id % 11 = 0 then 'S' || event_id else 'N' || (user_id % 10) || ' ' || case when user_id % 5 = 0 then 'n.d.' else user_id::varchar end end) || {_RANGES_SQL} as siglum from e""")
def bib_cited_ranges(spark, d):
    from glyphmill.operators import biblio

    ranges = """case version % 3 when 0 then array(named_struct('unit', 'page', 'value', cast(version % 50 as string)))
      when 1 then array(named_struct('unit', 'page', 'value', concat(version % 50, '-', version % 50 + 7)), named_struct('unit', 'note', 'value', '3')) else cast(array() as array<struct<unit:string,value:string>>) end"""
    records = _records(spark, d).where(F.col("data.itemType").isin("book", "journalArticle")).withColumn("at", F.expr(ranges))
    of = lambda form, siglum=None: biblio.cited(F.col("data"), form, F.col("at"), siglum).alias(form)
    return records.select("key", of("default").alias("reference"), of("omitname"), of("ibid"), of("siglum", F.when(F.col("version") % 4 == 0, "A")))


@query(f"""with {_BIB_SQL}, e as (select event_id, event_type, user_id, case when user_id % 5 = 0 then 'N.d.' else user_id::varchar || '.' end as dated, case when user_id % 5 = 0 then '' else ', ' || user_id end as later from events where event_type in ('purchase', 'click'))
          select event_id::varchar as key, case when event_id % 11 = 0 then 'S' || event_id || '. Untitled. By A N' || (user_id % 10) || '.' || case when event_type = 'purchase' then ' No place' || later || '.' else '' end
            else 'N' || (user_id % 10) || ', A. ' || dated || ' Untitled.' || case when event_type = 'purchase' then ' No place.' else '' end end as entry from e""")
def bib_entries(spark, d):
    from glyphmill.operators import biblio

    whole = _records(spark, d).select(F.from_json(F.to_json(F.struct("key", "version", "data")), biblio.RECORD).alias("r")).select("r.*")
    return whole.where(F.col("data.itemType").isin(*biblio.ITEM_TYPES)).select("key", biblio.entry(F.col("data")).alias("entry"))


@query("select 'A N' || (user_id % 10) as creator, 'author' as kind, count(*) as n from events group by 1")
def bib_creators(spark, d):
    from glyphmill.operators import biblio

    return biblio.by_creator(_records(spark, d)).groupBy("creator", "kind").agg(F.count("*").alias("n"))


def _scratch(spark, name: str) -> str:
    """A new folder that executors share."""
    return shared_folder(spark, name)


@query("""select event_id::varchar as key, event_id as version, case event_type when 'purchase' then 'book' when 'click' then 'journalArticle' else event_type end as kind, 'A N' || (user_id % 10) as creator from events""")
def jsonl_records(spark, d):
    from glyphmill.operators import biblio

    at = _scratch(spark, "records")
    _records(spark, d).select(F.to_json(F.struct("key", "version", "data"))).write.text(at)
    return biblio.read_jsonl(spark, at).select("key", "version", F.col("data.itemType").alias("kind"), biblio.name_first_last(F.get("data.creators", F.lit(0))).alias("creator"))


@query("""select 'd' || n_regionkey as dictionary, n_nationkey::int as page, k::int as n, n_name || ' ' || k as head from nation, range(1, 4) t(k) where n_regionkey in (1, 2)""")
def dictionary_entries(spark, d):
    from glyphmill.sources import collections

    at = _scratch(spark, "dictionaries")
    entry = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.concat(F.lit("<hw>"), "n_name", F.lit("  "), k.cast("string"), F.lit("</hw> text <i>x</i>"))), "")
    table(spark, d, "nation").select(F.concat_ws("\t", F.concat(F.lit("d"), "n_regionkey"), "n_nationkey", F.concat(F.lit("before "), entry))).write.text(at)
    return collections.dictionary_entries(collections.dictionary_pages(spark, at, "d[12]")).select("dictionary", "page", "n", "head")


@query("""select c_custkey::varchar as id, case when c_custkey % 3 = 0 then c_name else 'F ' || c_name end as print_name, case when c_custkey % 3 = 0 then c_name else c_name || ', F' end as inverted_name,
            case when c_custkey % 4 = 0 then c_mktsegment end as affiliation, case when c_custkey % 5 = 0 then '000-' || c_custkey end as orcid from customer""")
def members_read(spark, d):
    from glyphmill.sources import readers

    customer = table(spark, d, "customer")
    person = F.expr("""concat('<person xml:id="https://x/', c_custkey, '"><persName>', case when c_custkey % 3 = 0 then concat('<name>', c_name, '</name>') else concat('<forename> F </forename><surname>', c_name, '</surname>') end, '</persName>',
        case when c_custkey % 4 = 0 then concat('<affiliation>', c_mktsegment, '</affiliation>') else '' end, case when c_custkey % 5 = 0 then concat('<idno type="ORCID">https://orcid.org/000-', c_custkey, '</idno>') else '' end, '</person>')""")
    lists = customer.groupBy(F.expr("c_custkey div 100").alias("k")).agg(F.concat(F.lit("<listPerson>"), F.array_join(F.array_sort(F.collect_list(person)), ""), F.lit("</listPerson>")).alias("x"))
    return readers.members(nodes.nodes(lists, "k", "x")).select("id", "print_name", "inverted_name", "affiliation", "orcid")


@query("""select conv_id as doc_id, 'r' || conv_id as ref, last_value(case when role = 'user' then 'at ' || turn end ignore nulls) over w as heading, last_value(case when turn % 3 = 0 then turn::varchar end ignore nulls) over w as page, 'i' || turn as text
          from conversations window w as (partition by conv_id order by turn)""")
def reports_read(spark, d):
    from glyphmill.sources import collections

    part = F.expr("""concat(case when role = 'user' then concat('<H2> at  ', turn, '</H2>') else '' end, case when turn % 3 = 0 then concat('<pb n="', turn, '"/>') else '' end, '<INSCRIPTION>i', turn, '</INSCRIPTION>')""")
    docs = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", part.alias("x")))).alias("l"))
    xml = F.concat(F.lit('<doc><arie n="1" ref="r'), "conv_id", F.lit('">'), F.array_join(F.transform("l", lambda x: x["x"]), ""), F.lit("</arie></doc>"))
    return collections.report_entries(nodes.nodes(docs.select("conv_id", xml.alias("x")), "conv_id", "x")).select("doc_id", "ref", "heading", "page", "text")


@query("""select conv_id as doc_id, row_number() over (partition by conv_id order by turn)::int as n, case when turn % 2 = 0 then role || '|' || role || '|' || turn else role || '||' || turn end as cells from conversations""")
def spreadsheets_read(spark, d):
    from glyphmill.sources import collections

    row = F.expr("""concat('<table-row><table-cell', case when turn % 2 = 0 then ' number-columns-repeated="2"' else '' end, '><p>', role, '</p></table-cell>', case when turn % 2 = 1 then '<table-cell/>' else '' end, '<table-cell><p>', turn, '</p></table-cell><table-cell number-columns-repeated="16000"/></table-row>')""")
    docs = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", row.alias("x")))).alias("l"))
    xml = F.concat(F.lit("<spreadsheet><table>"), F.array_join(F.transform("l", lambda x: x["x"]), ""), F.lit("</table></spreadsheet>"))
    rows = collections.spreadsheet_rows(nodes.kept(nodes.nodes(docs.select("conv_id", xml.alias("x")), "conv_id", "x")))
    return rows.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("row")).alias("n"), F.array_join("cells", "|").alias("cells"))


@query("""select (1000 * n_nationkey)::int as first, (1000 * n_nationkey + 255)::int as last, n_name as name from nation""")
def ranges_read(spark, d):
    from glyphmill.sources import readers

    at = _scratch(spark, "ranges")
    code = lambda c: F.lpad(F.hex(c), 4, "0")
    lines = table(spark, d, "nation").select(F.concat(code(1000 * F.col("n_nationkey")), F.lit(".."), code(1000 * F.col("n_nationkey") + 255), F.lit("; "), "n_name", F.lit("  # a remark")))
    lines.unionByName(spark.createDataFrame([("# all ranges",), ("",)], "s string").toDF(lines.columns[0])).write.text(at)
    return readers.unicode_ranges(spark, at)


@query("""with n as (select c_nationkey, c_custkey as key, case c_custkey % 4 when 0 then '<i>' || c_name || '</i>' when 1 then lower(c_name) when 2 then c_name end as name from customer)
          select key, row_number() over (partition by c_nationkey order by name is null, regexp_replace(lower(regexp_replace(coalesce(name, ''), '<[^>]*>', '', 'g')), '[^a-z0-9]', '', 'g'), key)::bigint as place from n""")
def collated_order(spark, d):
    name = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("<i>"), "c_name", F.lit("</i>"))).when(F.col("c_custkey") % 4 == 1, F.lower("c_name")).when(F.col("c_custkey") % 4 == 2, F.col("c_name"))
    rows = table(spark, d, "customer").select("c_nationkey", F.col("c_custkey").alias("key"), name.alias("name"))
    return rows.select("key", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(*sort_columns(F.col("name"), F.col("key"), markup=True))).cast("bigint").alias("place"))


@query("""select short_title as title, n from (select 'k' || json_extract_string(props, '$.k') as short_title, count(*) as n from events where event_id % 7 <> 0 group by 1) where n > 1""")
def bib_duplicates(spark, d):
    from glyphmill.operators import biblio

    titles = _records(spark, d).select(biblio.short_title(F.col("data")).alias("title")).where("title is not null")
    return relational.duplicates(titles, "title")


# ---- trees

def _nodes(spark, d) -> DataFrame:
    return nodes.kept(nodes.nodes(table(spark, d, "pages"), "page_id", "html", tolerant=True))


def _xpath(path: str) -> Query:
    def run(spark, d):
        return nodes.XPath(_nodes(spark, d)).find(path).select(F.col("doc_id").alias("page_id"), "pre", "name")

    return run


# The same trees in SQL: tokens of the page one after the other, with the stack of what is open; for pages without stray angle brackets.
_TREE_TOKENS = """t as (select page_id, regexp_extract_all(regexp_replace(html, '<script>.*?</script>', '<script>code</script>', 'g'), '<!--.*?-->|<[^>]*>|[^<]+') as ts from pages),
    n as (select page_id, list_transform(ts, lambda x: case when x like '<!--%' then 'c' when x like '<!%' then 'd' when x like '</%' then 'e' when x like '<%' then 's' else 't' end) as kinds, ts,
      list_transform(ts, lambda x: regexp_extract(x, '^</?([a-z0-9]+)', 1)) as names from t),
    w(page_id, i, pre, up, open, langs) as (
      select page_id, 0, 0, [0], ['']::varchar[], [null]::varchar[] from n
      union all
      select page_id, i + 1, pre + case when k in ('s', 't', 'c') then 1 else 0 end,
        case when k = 's' and not void then list_append(up, pre + 1) when k = 'e' and last > 0 then up[1:last - 1] else up end,
        case when k = 's' and not void then list_append(open, name) when k = 'e' and last > 0 then open[1:last - 1] else open end,
        case when k = 's' and not void then list_append(langs, coalesce(nullif(regexp_extract(tok, ' lang="([^"]*)"', 1), ''), langs[-1])) when k = 'e' and last > 0 then langs[1:last - 1] else langs end
      from (select w.*, kinds[i + 1] as k, names[i + 1] as name, ts[i + 1] as tok, names[i + 1] in ('br', 'meta', 'img', 'link', 'hr', 'input') as void,
              coalesce(list_max(list_transform(range(1, len(open) + 1), lambda j: case when open[j] = names[i + 1] then j end)), 0) as last
            from w join n using (page_id) where i < len(ts))),
    nodes as (select w.page_id, w.pre + 1 as pre, w.up, w.open, kinds[i + 1] as kind, names[i + 1] as name, ts[i + 1] as tok,
        coalesce(nullif(regexp_extract(ts[i + 1], ' lang="([^"]*)"', 1), ''), w.langs[-1]) as lang from w join n using (page_id) where i < len(ts) and kinds[i + 1] in ('s', 't', 'c')),
    tags as (select * from nodes where kind = 's')"""


def _tree_sql(select: str) -> str:
    return f"with recursive {_TREE_TOKENS} {select}"


PATHS = {
    "xpath_child": ("/html/head/title", "select page_id, pre, name from tags where name = 'title' and open = ['', 'html', 'head']"),
    "xpath_descendant": ("//p", "select page_id, pre, name from tags where name = 'p'"),
    "xpath_ancestor": ("//p/ancestor::body", "select page_id, pre, name from tags b where name = 'body' and exists (from tags p where p.page_id = b.page_id and p.name = 'p' and list_contains(p.up, b.pre))"),
    "xpath_sibling": ("//h1/following-sibling::p", "select distinct p.page_id, p.pre, p.name from tags p join tags h on h.page_id = p.page_id and h.name = 'h1' and h.up[-1] = p.up[-1] and p.pre > h.pre where p.name = 'p'"),
    "xpath_following": ("//title/following::p", "select distinct p.page_id, p.pre, p.name from tags p join tags h on h.page_id = p.page_id and h.name = 'title' and p.pre > h.pre and not list_contains(p.up, h.pre) where p.name = 'p'"),
    "xpath_stuck": ("//body/stuck-child::*", """select page_id, pre, name from tags t where open[-1] = 'body' and not exists
        (from nodes o where o.page_id = t.page_id and o.up[-1] = t.up[-1] and o.pre < t.pre and (o.kind = 's' or o.kind = 't' and trim(o.tok, ' ' || chr(9) || chr(10) || chr(13)) <> ''))"""),
    "xpath_predicate": ("//meta[@charset='utf-8']", """select page_id, pre, name from tags where name = 'meta' and tok like '% charset="utf-8"%'"""),
    "xpath_functions": ("//p[regex('tion') and not(empty())]", """select p.page_id, p.pre, p.name from tags p join nodes s on s.page_id = p.page_id and s.kind = 't' and list_contains(s.up, p.pre)
        where p.name = 'p' group by all having contains(string_agg(s.tok, '' order by s.pre), 'tion')"""),
}
for _name, (_path, _select) in PATHS.items():
    _QUERIES[_name] = _xpath(_path)
    _SQL[_name] = _tree_sql(_select)
_SQL["xpath_predicate_count"] = "select count(*) as n from pages where regexp_matches(html, '<meta charset=\"utf-8\">')"


@query(_SQL.pop("xpath_predicate_count"))
def xpath_predicate_count(spark, d):
    return _xpath("//meta[@charset='utf-8']")(spark, d).agg(F.count_distinct("page_id").alias("n"))


AXES = {
    "xpath_parent": ("//li/parent::ul", "select distinct u.page_id, u.pre, u.name from tags u join tags l on l.page_id = u.page_id and l.name = 'li' and l.up[-1] = u.pre where u.name = 'ul'"),
    "xpath_preceding": ("//h1/preceding::a", "select distinct p.page_id, p.pre, p.name from tags p join tags h on h.page_id = p.page_id and h.name = 'h1' and p.pre < h.pre and not list_contains(h.up, p.pre) where p.name = 'a'"),
    "xpath_self": ("//li/self::li[a]/ancestor-or-self::li", "select distinct l.page_id, l.pre, l.name from tags l join tags a on a.page_id = l.page_id and a.name = 'a' and a.up[-1] = l.pre where l.name = 'li'"),
    "xpath_preceding_sibling": ("//article/preceding-sibling::div", "select distinct p.page_id, p.pre, p.name from tags p join tags h on h.page_id = p.page_id and h.name = 'article' and p.up[-1] = h.up[-1] and p.pre < h.pre where p.name = 'div'"),
    "xpath_glob": ("//a[glob('*e', text()) or @href='/The']", "select a.page_id, a.pre, a.name from tags a left join nodes s on s.page_id = a.page_id and s.kind = 't' and list_contains(s.up, a.pre) where a.name = 'a' group by all having coalesce(string_agg(s.tok, '' order by s.pre), '') like '%e' or any_value(a.tok) = '<a href=\"/The\">'"),
}
for _name, (_path, _select) in AXES.items():
    _QUERIES[_name] = _xpath(_path)
    _SQL[_name] = _tree_sql(_select)


@query(_tree_sql("select page_id, pre, name from tags where name = 'title' and open = ['', 'html', 'head']"))
def xpath_locate(spark, d):
    return nodes.locate(_nodes(spark, d), "/html[1]/head[1]/title[1]").select(F.col("doc_id").alias("page_id"), "pre", "name")


@query(_tree_sql("select page_id, pre, name from tags where name in ('a', 'li') and open[-1] in ('li', 'ul')"))
def xpath_patterns(spark, d):
    found = nodes.XPath(_nodes(spark, d))
    return found.matches("ul/li").unionByName(found.matches("li/a")).select(F.col("doc_id").alias("page_id"), "pre", "name")


@query("""with l as (select conv_id, turn, trim(regexp_replace(replace(text, chr(39), '’'), '\\s+', ' ', 'g'), ' ') as t from conversations)
          select conv_id as doc_id, string_agg(t, chr(10) order by turn) filter (t <> '') as logical, count(*)::int as lines from l group by conv_id""")
def edition_displays(spark, d):
    # A conversation is an edition: a verse with a line for each turn, of which blank ones aren't shown.
    line = F.concat(F.lit("<l><lb n='"), "turn", F.lit("'/>"), T.quote_xml(F.col("text")), F.lit("</l>"))
    listed = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("x")))).alias("l"))
    whole = F.concat(F.lit("<TEI><text><body><div type='edition'><lg>"), F.array_join(F.transform("l", lambda x: x["x"]), ""), F.lit("</lg></div></body></text></TEI>"))
    found = cover.cells(nodes.nodes(listed.select("conv_id", whole.alias("x")), "conv_id", "x")).groupBy("doc_id", "line").agg(F.array_join(F.sort_array(F.collect_list(F.struct("cell", "text")))["text"], "").alias("text"))
    shown = found.withColumn("text", F.nullif(T.normalize_space(F.replace("text", F.lit("'"), F.lit("’"))), F.lit("")))
    return shown.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("line", "text"))))["text"], "\n").alias("logical"), F.count("*").cast("int").alias("lines"))


# Editions made of conversations: a verse with a line for each turn, and an apparatus; with notes, gaps, numbers and languages.
_TURNS_SQL = r"""turns as (select *, (row_number() over (partition by conv_id order by turn) - 1)::int as k from conversations)"""


def _editions(spark, d) -> DataFrame:
    turns = table(spark, d, "conversations").withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    line = F.expr("""concat('<l n="', case when conv_id % 7 = 0 then 'z' else char(97 + k) end, '"', case when k % 3 = 1 then ' enjamb="yes"' else '' end, case k % 4 when 1 then ' xml:lang="san"' when 2 then ' xml:lang="eng"' else '' end, '>',
        quoted, '<note>on ', turn, '</note><gap', case turn % 4 when 0 then ' reason="lost"' when 1 then ' reason="illegible"' when 2 then '' else ' reason="ellipsis"' end,
        case when conv_id % 5 > 0 then concat(' quantity="', conv_id % 5, '"') else '' end, case turn % 3 when 0 then '' when 1 then ' unit="component"' else ' unit="line"' end, case when conv_id % 2 = 0 then ' precision="low"' else '' end,
        '/><space/><num', case when turn % 4 = 0 then ' value="3" atLeast="2" atMost="5"' when turn % 4 = 1 then ' atMost="2"' else ' value="1"' end, '/>',
        case when turn % 5 = 0 then '<seg cert="low"/>' else '' end, '<foreign/></l>')""")
    app = F.expr("""concat('<app loc="', k div 2, '"><lem', case when k % 2 = 0 then ' source="bib:A bib:B bib:A"' else '' end, '>', case when k % 3 = 2 then ' ' else role end, '</lem>',
        case when k % 2 = 0 then concat('<rdg source="bib:C">r', turn, '</rdg><rdg>s</rdg>') else '' end, case when k % 4 = 3 then '<note>see there</note>' else '' end, '</app>')""")
    listed = turns.withColumn("quoted", T.quote_xml(F.col("text"))).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("k", line.alias("l"), app.alias("a")))).alias("x"))
    join = lambda f: F.array_join(F.transform("x", lambda x: x[f]), "")
    whole = F.concat(F.lit("<TEI><text><body><div type='edition' n='"), "conv_id", F.lit("'><div type='textpart'><lg n='v'>"), join("l"), F.lit("</lg></div></div><div type='apparatus'><listApp>"), join("a"), F.lit("</listApp></div></body></text></TEI>"))
    return nodes.kept(nodes.nodes(listed.select("conv_id", whole.alias("x")), "conv_id", "x"))


@query(rf"""with {_TURNS_SQL}, c as (select *, trim(regexp_replace(translate(replace(regexp_replace(text || ' ', '\[[0-9]+.*?\]', '', 'g'), '[]', ''), '_әʼ' || chr(39) || '◉◆“”.+\,|/"॥।*!', ' ə’’'), '\s+', ' ', 'g'), ' ') as t from turns where conv_id % 7 <> 0)
          select conv_id as doc_id, conv_id || '.v' as number, k::bigint as at, case when k % 3 = 1 and t not like '-%' then '-' || t else t end as text from c""")
def verse_lines(spark, d):
    return trees.verse_lines(_editions(spark, d)).select("doc_id", "number", "at", "text")


@query(rf"""with {_TURNS_SQL}, e as (select conv_id, k, k // 2 as loc, '⟨' || (k // 2) || '⟩ ' || role || case when k % 2 = 0 then ' A B ◇ r' || turn || ' C; s' else '' end || case when k % 4 = 3 then ' • see there' when k % 2 = 0 then '.' else '' end as entry from turns where k % 3 <> 2),
          g as (select *, case when lag(loc) over (partition by conv_id order by k) is not distinct from loc then 0 else 1 end as new from e), p as (select *, sum(new) over (partition by conv_id order by k) as paragraph from g)
          select conv_id as doc_id, paragraph::bigint as paragraph, string_agg(entry, ' — ' order by k) as text from p group by all""")
def apparatus_paragraphs(spark, d):
    return trees.apparatus(_editions(spark, d)).select("doc_id", F.col("paragraph").cast("bigint").alias("paragraph"), "text")


@query(rf"with {_TURNS_SQL} select conv_id as doc_id, (k + 1)::bigint as n, 'on ' || turn as text from turns")
def note_numbers(spark, d):
    return trees.numbered_notes(_editions(spark, d)).select("doc_id", "n", "text")


@query(rf"""with {_TURNS_SQL}, g as (select conv_id, k, turn % 4 = 3 as untold, case turn % 4 when 0 then 'lost' when 1 then 'illegible' else 'lost or illegible' end as why, nullif(conv_id % 5, 0) as n,
            case turn % 3 when 0 then 'character' when 1 then 'component' else 'line' end as unit, conv_id % 2 = 0 as low from turns),
          w as (select *, case unit when 'component' then 'character component' else unit end || case when n = 1 then '' else 's' end as units, case when low then 'ca. ' else '' end as about, case why when 'lost' then '+' when 'illegible' then '×' else '*' end as sign from g),
          v as (select *, case when n is null then case unit when 'character' then '[…]' else '[unknown number of ' || why || ' ' || units || ']' end when unit = 'character' then '[' || about || n || sign || ']'
                  when unit = 'component' then '[' || about || repeat('.', n) || ']' else '[' || about || n || ' ' || why || ' ' || units || ']' end as logical from w)
          select conv_id as doc_id, k::bigint as k, case when untold then '…' else logical end as logical, case when untold then '…' when n is not null and unit = 'character' then '[' || repeat('*', n) || ']' else logical end as physical,
            case when untold then '…' when n is null or unit = 'line' then '.....' when unit = 'character' then repeat('.', n) else '.' end as search,
            case when untold then '' when n is null then 'Unknown number of ' || why || ' ' || units else case when low then 'About ' else '' end || n || ' ' || why || ' ' || units end as tip from v""")
def gap_forms(spark, d):
    k = (F.row_number().over(Window.partitionBy("doc_id").orderBy("pre")) - 1).cast("bigint")
    return trees.gap_forms(_editions(spark, d)).select("doc_id", k.alias("k"), "logical", "physical", "search", "tip")


@query(rf"""with {_TURNS_SQL} select conv_id as doc_id, rule, count(*) as n from (
            select conv_id, 'value excludes a range' as rule from turns where turn % 4 = 0 union all select conv_id, 'atMost needs atLeast' from turns where turn % 4 = 1
            union all select conv_id, 'uncertain segments only in translations' from turns where turn % 5 = 0
            union all select conv_id, 'a lemma alone needs a source' from turns where k % 2 = 1 and k % 4 <> 3) group by all""")
def rule_report(spark, d):
    found = rules.violations(_editions(spark, d), rules.inscription_rules())
    return found.groupBy("doc_id", "rule").agg(F.count("*").alias("n"))


# Lines are no elements whose xml:lang counts; where no note of the apparatus is in English, its lemmas and readings make it a source.
@query(rf"""with {_TURNS_SQL}, l as (select conv_id, k from turns), c as (select conv_id, count(*) as n, count(*) filter (k % 4 = 3) as notes from l group by conv_id)
          select conv_id as doc_id, unnest(['l', 'note', 'foreign', 'lem']) as name, 'source_other' as language, 'source_other' as script, true as is_source, n from c
          union all select conv_id, 'note', 'eng', 'latin', false, notes from c where notes > 0
          union all select conv_id, 'div', 'source_other', 'source_other', true, case when notes = 0 then 3 else 2 end from c union all select conv_id, 'div', 'eng', 'latin', false, 1 from c where notes > 0""")
def edition_languages(spark, d):
    languages = spark.createDataFrame([("san", "sanskrit", True), ("eng", "english", False)], "code string, language string, is_source boolean")
    scripts = spark.createDataFrame([("x", "brahmi", True)], "code string, script string, script_is_source boolean")
    editions = _editions(spark, d)
    named = trees.assigned_languages(editions, languages, scripts).join(editions.select("doc_id", "pre", "name"), ["doc_id", "pre"]).where("name in ('l', 'note', 'foreign', 'lem', 'div')")
    return named.groupBy("doc_id", "name", "language", "script", "is_source").agg(F.count("*").alias("n"))


@query(r"""with t as (select page_id, replace(regexp_replace(replace(html, '="</p>"', '="' || chr(1) || '/p>"'), '<!--.*?-->|</?[a-zA-Z!][^>]*>', '', 'g'), chr(1), '<') as x from pages)
          select page_id, replace(replace(replace(replace(replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', chr(160)), '&amp;', '&') as text from t""")
def html_text(spark, d):
    rows = _nodes(spark, d)
    return nodes.texts(rows).join(rows.where("kind = 'tree'").select("doc_id", "pre"), ["doc_id", "pre"]).select(F.col("doc_id").alias("page_id"), "text")


_ISSUES_SQL = """l as (select doc_id, unnest(ls) as line, unnest(range(1, len(ls) + 1)) as line_no from (select doc_id, regexp_split_to_array(replace(replace(text, 'q', 'х'), 'z', 'z̊'), '[\r\n]') as ls from documents where text is not null))"""


@query(rf"""with {_ISSUES_SQL} select doc_id, line_no, (length(line) - length(replace(replace(line, 'х', ''), '̊', '')))::bigint as n from l where contains(line, 'х') or contains(line, '̊')""")
def grapheme_issues(spark, d):
    # Letters that are rare in the documents stand for odd ones: a Cyrillic letter, and a letter with a mark that it doesn't take.
    documents = table(spark, d, "documents").select("doc_id", F.replace(F.replace("text", F.lit("q"), F.lit("х")), F.lit("z"), F.lit("z̊")).alias("text"))
    return quality.odd_clusters(documents, "doc_id", "text")


@query(_tree_sql("""select t.page_id as doc_id, t.pre, 'an address occurs twice' as rule from (select *, regexp_extract(tok, ' href="([^"]*)"', 1) as href, count(*) over (partition by page_id, regexp_extract(tok, ' href="([^"]*)"', 1)) as n from tags) t where trim(href) <> '' and n > 1"""))
def rule_unique_href(spark, d):
    return quality.unique_attribute(_nodes(spark, d), "href", "an address occurs twice")


@query(_tree_sql("select page_id as doc_id, pre, 'a link within a link' as rule from tags where name = 'a' and list_contains(open, 'a')"))
def rule_nested_links(spark, d):
    return quality.forbidden(_nodes(spark, d), "//a//a", "a link within a link")


@query(_tree_sql("select page_id as doc_id, pre, 'a paragraph within a paragraph' as rule from tags where name = 'p' and list_contains(open, 'p')"))
def rule_nested_paragraphs(spark, d):
    return quality.forbidden(_nodes(spark, d), "//p//p", "a paragraph within a paragraph")


@query(_tree_sql("select page_id, pre, coalesce(lang, 'und') as lang from tags"))
def lang_inheritance(spark, d):
    return quality.inherited(_nodes(spark, d), "lang", "und").select(F.col("doc_id").alias("page_id"), "pre", F.col("value").alias("lang"))


@query("""select user_id as key, value from (select user_id, max_by(value, event_id) as value, max_by(event_type, event_id) as kind from events group by user_id) where kind <> 'purchase'""")
def stream_ingest(spark, d):
    from glyphmill.streaming.ingest import VersionedTable, ingest

    at = _scratch(spark, "stream")
    schema = table(spark, d, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    into = VersionedTable(spark, at, "user_id bigint, event_id bigint, value double")
    ingest(source.select("user_id", "event_id", "value", "event_type"), into, "user_id", "event_id", F.col("event_type") == "purchase", f"{at}-checkpoint")
    return into.read().select(F.col("user_id").alias("key"), "value")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a search, joined with the production of each document's language and source."""
    found = catalog.search(_index(spark, sf_dir), "repo:src1 tion", FIELDS).select("doc_id", F.col("repo").alias("source"), "lang")
    counted = found.join(lang_source_prod(spark, sf_dir), ["lang", "source"])
    return relational.page(counted, [*sort_columns(F.col("source"), F.col("doc_id"))], 1, catalog.PER_PAGE)


def _all() -> None:
    """The queries of the other modules add themselves when these are imported."""
    from glyphmill.plans import checks, passages, passes, reading, searching, streams  # noqa: F401


def queries() -> dict[str, Query]:
    _all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_SQL)
