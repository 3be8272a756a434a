"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm import bpe, fingerprints, langmix, lexical, licences, neardup, periodic, pfair, qualityforest, suffixes, tiff, tokenfiles, warc
from glyphmill.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langmix.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op2_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = tiff.store_texts(table(spark, sf_dir, "documents"))
    return tiff.features(tiff.pages(stored, keep=("row", "doc_id", "n_bytes", "media_bytes", "media_sha256")))


def op3_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"), licences.known(spark))


def op4_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op5_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    index = warc.CaptureIndex.build(warc.write_archives(pages))
    return warc.read_captures(warc.look_up(index, pages))


def op6_pfair_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op7_token_files(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    largest = tokenfiles.word_tokenizer(path).tokenizer.get_vocab_size(with_added_tokens=True) - 1
    manifest = tokenfiles.write(table(spark, sf_dir, "documents"), lambda: tokenfiles.word_tokenizer(path).encode, end_id=2, largest_id=largest)
    return tokenfiles.digest(manifest)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    rules = qualityforest.learn(documents, table(spark, sf_dir, "labels"))
    return qualityforest.judge(documents, rules)


def op10_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    path = vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op12_prefix_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edits(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.collapse(table(spark, sf_dir, "documents"), periodic.planted)


OP5_SQL = """
with p as (select page_id, sha256(coalesce(html, '')) as d, strlen(coalesce(html, ''))::bigint as n from pages),
f as (select d, min(page_id) as first from p where n >= 100 group by d)
select page_id, n as payload_bytes, p.d as payload_digest, case when page_id > first then 'revisit' else 'response' end as record_type,
       case when page_id > first then first end as refers_to
from p left join f on p.d = f.d
"""


#: Every 100-byte window of every text, its first place, and what is left between the runs of later ones.
OP4_SQL = r"""
with d as (select doc_id, encode(coalesce(text, '')) as b, strlen(coalesce(text, ''))::bigint as n from documents),
w as (select doc_id, p, array_slice(b, p + 1, p + 100) as x from (select doc_id, b, unnest(range(0, n - 99)) as p from d where n >= 100)),
f as (select doc_id, p, row_number() over (partition by x order by doc_id, p) as k from w),
m as (select doc_id, p, case when p - lag(p) over (partition by doc_id order by p) <= 100 then 0 else 1 end as new from f where k > 1),
s as (select doc_id, min(p) as a, max(p) + 100 as z from (select *, sum(new) over (partition by doc_id order by p) as span from m) group by doc_id, span),
g as (select doc_id, coalesce(lag(z) over (partition by doc_id order by a), 0) as a, a as z from s union all select doc_id, max(z), null from s group by doc_id),
k as (select g.doc_id, string_agg(hex(array_slice(b, a + 1, coalesce(g.z, n))), '' order by a) as h from g join d using (doc_id) where coalesce(g.z, n) > a group by g.doc_id)
select doc_id, n as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans, case when spans is null then sha256(b) else sha256(unhex(coalesce(h, ''))) end as kept_sha256
from d left join (select doc_id, sum(z - a) as gone, count(*) as spans from s group by doc_id) using (doc_id) left join k using (doc_id)
"""

#: Shared shingles of all pairs that have any, and what hangs together by those that share enough.
OP8_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, x from (select doc_id, unnest(case when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as x from w where len(w) > 0)),
n as (select doc_id, count(*)::bigint as n from s group by doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by all),
l as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 75 * (x.n + y.n - shared)),
e as (select a, b from l union all select b, a from l),
r(a, b) as (select doc_id, doc_id from documents union select r.a, e.b from r join e on e.a = r.b)
select w.doc_id, coalesce(n, 0) as n_shingles, m as component_id, m = w.doc_id as kept from w left join n using (doc_id) join (select a as doc_id, min(b) as m from r group by a) using (doc_id)
"""


def queries() -> dict[str, Query]:
    return {
        "op1_language_mixture": op1_language_mixture,
        "op2_tiff_pages": op2_tiff_pages,
        "op3_licence_digests": op3_licence_digests,
        "op4_repeat_removal": op4_repeat_removal,
        "op5_warc_index": op5_warc_index,
        "op6_pfair_mixture": op6_pfair_mixture,
        "op7_token_files": op7_token_files,
        "op8_near_duplicates": op8_near_duplicates,
        "op9_isolation_forest": op9_isolation_forest,
        "op10_byte_bpe": op10_byte_bpe,
        "op11_lexical_search": op11_lexical_search,
        "op12_prefix_hashes": op12_prefix_hashes,
        "op13_periodic_runs": op13_periodic_runs,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_licence_digests": licences.ORACLE,
        "op4_repeat_removal": OP4_SQL,
        "op5_warc_index": OP5_SQL,
        "op6_pfair_mixture": pfair.ORACLE,
        "op8_near_duplicates": OP8_SQL,
        "op11_lexical_search": lexical.ORACLE,
        "op13_periodic_runs": periodic.ORACLE,
    }
