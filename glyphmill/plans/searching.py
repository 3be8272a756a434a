"""Queries of the postings index: searches by trigrams, ranked pages, facets and snippets, over whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators import catalog, postings
from glyphmill.plans.registry import _FOLD_SQL, _index, FIELDS, query
from glyphmill.session import shared_folder, table

_SUMMARY = _FOLD_SQL.format("text")


def _trigram_index(spark, d) -> postings.Index:
    return postings.build(_index(spark, d), "doc_id", FIELDS, shared_folder(spark, "trigrams"))


_FIELDS_SQL = f"i as (select doc_id, doc_id::varchar as ident, source as repo, lang, {_SUMMARY} as summary from documents)"


@query(f"""with {_FIELDS_SQL}
           select doc_id, 'any field' as search from i where contains(ident, 'mentoi') or contains(repo, 'mentoi') or contains(lang, 'mentoi') or contains(summary, 'mentoi')
           union all select doc_id, 'in fields' from i where contains(repo, 'src1') and contains(summary, 'tion')
           union all select doc_id, 'alternatives' from i where contains(repo, 'src1') and (contains(summary, 'ation') or not contains(summary, 'ing'))
           union all select doc_id, 'phrase' from i where contains(summary, 'of the') or contains(summary, 'cion')
           union all select doc_id, 'number' from i where contains(ident, '123')""")
def indexed_search(spark, d):
    index = _trigram_index(spark, d)
    clauses = lambda q: catalog.Op("and", tuple(catalog.parse(q)))
    searches = {
        "any field": clauses("Mentoi"),
        "in fields": clauses('repo:src1 AND summary:"tion"'),
        "alternatives": catalog.parse_boolean("repo:src1 and (summary=ation or not summary:ing)"),
        "phrase": catalog.parse_boolean('summary:"of the " or summary:ción'),
        "number": clauses("ident:123"),
    }
    found = [postings.search(index, node).select("doc_id", F.lit(name).alias("search")) for name, node in searches.items()]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


#: Words that are searched for: frequent ones and rarer ones of several languages.
WANTED = ["lichlich", "keit", "heoron", "eroning", "tion", "the", "élement", "nothing-like-it"]
_WANTED = [T.fold_text(w) for w in WANTED]
_WORDS_SQL = f"""f as (select doc_id, {_SUMMARY} as t from documents),
  w as (select doc_id, unnest(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]+')) as w from f),
  c as (select doc_id, w, count(*) as tf from w where w in ({", ".join(f"'{w}'" for w in _WANTED)}) group by all),
  i as (select w, floor(1000 * ln((select count(*) from documents)::double / count(*)))::bigint as idf from c group by w),
  s as (select doc_id, sum(idf * (1000 + floor(1000 * ln(tf::double))::bigint))::bigint as score from c join i using (w) group by doc_id)"""


def _word_index(spark, d) -> postings.Index:
    folded = table(spark, d, "documents").select("doc_id", "lang", "source", T.fold(F.col("text")).alias("text"))
    return postings.build(folded, "doc_id", ["text"], shared_folder(spark, "words"), postings.words, carry=("lang", "source"))


@query(f"with {_WORDS_SQL} select doc_id, row_number() over (order by score desc, doc_id)::int as rank, score from s where score > 0 order by score desc, doc_id limit 50")
def ranked_search(spark, d):
    return postings.ranked(_word_index(spark, d), _WANTED, "text", catalog.PER_PAGE)


@query(f"""with {_WORDS_SQL}, m as (select distinct doc_id, lang, source from c join documents using (doc_id))
           select 'lang' as facet, lang as value, count(*) as n from m group by lang union all select 'source', source, count(*) from m group by source""")
def search_facets(spark, d):
    return postings.facets(postings.holding(_word_index(spark, d), _WANTED, "text"), ["lang", "source"])


_SNIPPET_WORDS = {"lichlich": 5, "keit": 3, "heoron": 5, "tion": 2, "the": 1, "and": 1}


@query(f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as t, unnest(range(0, len(string_split(text, chr(10))))) as line from documents),
  p as (select doc_id, line, length(t) as size, unnest(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+')) as part, unnest(range(0, len(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+')))) as k from l),
  a as (select *, sum(length(part)) over (partition by doc_id, line order by k) as stop, {_FOLD_SQL.format("part")} as f from p),
  m as (select doc_id, line, size, stop - length(part) as start, stop, case f {" ".join(f"when '{k}' then {v}" for k, v in _SNIPPET_WORDS.items())} end as w from a where f in ({", ".join(f"'{k}'" for k in _SNIPPET_WORDS)})),
  s as (select x.doc_id, x.line, x.start, x.size, count(*) as n_matches, sum(y.w) as weight from m x join m y on y.doc_id = x.doc_id and y.line = x.line and y.start >= x.start and (y.stop <= x.start + 120 or y.start = x.start) group by all),
  b as (select * from s qualify row_number() over (partition by doc_id order by weight desc, line, start) = 1),
  j as (select b.doc_id, b.line, b.start, b.size, n_matches, string_agg(part, '' order by k) as body from b join a on a.doc_id = b.doc_id and a.line = b.line and a.stop - length(part) >= b.start and (a.stop <= b.start + 120 or a.stop - length(part) = b.start) group by all)
  select doc_id, line::bigint as line, start::bigint as start, n_matches, case when start > 0 then '[...]' else '' end || body || case when start + length(body) < size then '[...]' else '' end as snippet from j""")
def search_snippets(spark, d):
    return postings.snippets(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", T.fold, _SNIPPET_WORDS)
