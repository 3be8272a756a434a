"""The rows of the quality query: base columns against SQL, the verdict against trees walked one by one."""

import duckdb
import numpy as np

from glyphmill.llm import qualityforest, queries

DATA = "/root/testdata/sf0.001"

BASE = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from d),
g as (select doc_id, i, count(*) over (partition by doc_id, x) as n from (select doc_id, i, array_to_string(w[i + 1:i + 5], ' ') as x from (select doc_id, w, unnest(range(0, len(w) - 4)) as i from w where len(w) >= 5))),
r as (select doc_id, count(distinct k) as n from (select doc_id, unnest(range(i, i + 5)) as k from g where n > 1) group by doc_id),
l as (select doc_id, count(*) - count(distinct line) as n from (select doc_id, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
       coalesce(l.n, 0)::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words, len(w) < 10 or 100 * coalesce(r.n, 0) > 20 * len(w) as base_failed
from w left join l using (doc_id) left join r using (doc_id)
"""


def path_length(tree, row):
    feature, value, child, length = tree
    node = 0
    while feature[node] >= 0:
        node = child[node] + (row[feature[node]] >= value[node])
    return length[node]


def test_quality_rows(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = con.sql(BASE)
    got = queries.op9_isolation_forest(spark, DATA)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    rules = qualityforest.learn(documents, spark.read.parquet(f"{DATA}/labels.parquet"))
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    for r in got.collect():
        beyond = np.maximum(0, np.array(qualityforest.statistics(texts[r.doc_id])[1]) - rules.limits)
        anomaly = 2 ** (-np.mean([path_length(t, beyond) for t in rules.forest.trees]) / rules.forest.usual)
        assert abs(r.anomaly - anomaly) < 1e-9 and r.kept == (not r.base_failed and anomaly < rules.threshold)
