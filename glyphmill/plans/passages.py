"""Queries of parallel passages: stored pairs that change, and texts as they are typed."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators import parallels
from glyphmill.plans.registry import _TRIGRAMS_SQL, query
from glyphmill.session import shared_folder, table


@query(f"""with t as (select conv_id * 1000 + turn as id, case when turn % 3 = 1 then substr(lower(text), 5) else lower(text) end as x from conversations where turn % 7 <> 6),
           s as (select id, {_TRIGRAMS_SQL.format('x')} as g from t),
           c as (select a.id as id1, b.id as id2, len(list_intersect(a.g, b.g)) as inter, len(a.g) + len(b.g) as n2 from s a join s b on a.id < b.id)
           select id1, id2, ((1000000 * inter) // (n2 - inter))::double / 1e6 as coeff from c where 10 * inter >= 3 * (n2 - inter)""")
def jaccard_updated(spark, d):
    """The pairs of all turns but some are stored; then some turns change, some go and some come."""
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "turn", F.lower("text").alias("x"))
    at = shared_folder(spark, "pairs")
    parallels.similar_pairs(turns.where("turn % 5 <> 0"), "id", F.col("x")).write.parquet(at)
    now = turns.where("turn % 7 <> 6").withColumn("x", F.when(F.col("turn") % 3 == 1, F.substr("x", F.lit(5))).otherwise(F.col("x")))
    changed = turns.where("turn % 7 = 6 or turn % 3 = 1 or turn % 5 = 0").select("id")
    pairs = parallels.updated_pairs(spark.read.schema("id1 long, id2 long, inter long, total long").parquet(at), now, changed, "id", F.col("x"))
    return pairs.select("id1", "id2", parallels.coefficient().alias("coeff"))


_CLEAN = r"""trim(regexp_replace(translate(replace(regexp_replace(nfc_normalize({0}), '\[[0-9]+.*?\]', '', 'g'), '[]', ''), '_әʼ' || chr(39) || '◉◆“”.+\,|/"॥।*!', ' ə’’'), '\s+', ' ', 'g'), ' ')"""
_FOLDED = r"trim(replace(regexp_replace(lower({0}), '[^\p{L}\p{M}\s’]', '', 'g'), '’', 'a'), ' ' || chr(10))"


def _searched_sql(text: str) -> str:
    return _FOLDED.replace("{0}", _CLEAN.replace("{0}", text))


@query(rf"""with q as (select item_id, replace(replace(substr(text, 1, 40), 'e', 'e' || chr(769)), 'n', 'n' || chr(771)) || case item_id % 3 when 0 then ' / ' when 1 then '। ' else ' ' end || substr(text, 41) || ' [12] | end' as typed from benchmark),
    h as (select item_id, regexp_extract(typed, '(?s)^(.*?[/|।])') as one, typed from q),
    n as (select item_id, regexp_replace(' ' || {_searched_sql("one")} || ' ' || {_searched_sql("substr(typed, length(one) + 1)")} || ' ', '\s{{2,}}', ' ', 'g') as t from h),
    qs as (select item_id, {_TRIGRAMS_SQL.format('t')} as g from n),
    x as (select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 as ix, count(*) over (partition by conv_id) as n, text from conversations),
    v as (select conv_id * 100 + ix // 4 as id, regexp_replace(' ' || string_agg(text, ' ' order by ix) || ' ', '\s{{2,}}', ' ', 'g') as t from x where (ix // 4 + 1) * 4 <= n group by conv_id, ix // 4),
    s as (select id, {_TRIGRAMS_SQL.format(r"regexp_replace(' ' || " + _searched_sql("t") + r" || ' ', '\s{2,}', ' ', 'g')")} as g from v),
    c as (select item_id, id, len(list_intersect(qs.g, s.g)) as inter, len(qs.g) + len(s.g) as n2 from qs, s),
    r as (select item_id, id, ((1000000 * inter) // (n2 - inter))::double / 1e6 as coeff from c where inter > 0)
    select item_id, id, coeff, total from (select *, count(*) over (partition by item_id) as total, row_number() over (partition by item_id order by coeff desc, id) as k from r) where k <= 50""")
def parallels_search_verses(spark, d):
    """Verses are looked for as they are typed: with marks apart from their letters, and a danda."""
    apart = lambda c: F.replace(F.replace(c, F.lit("e"), F.lit("é")), F.lit("n"), F.lit("ñ"))
    danda = F.when(F.col("item_id") % 3 == 0, " / ").when(F.col("item_id") % 3 == 1, "। ").otherwise(" ")
    typed = F.concat(apart(F.substr("text", F.lit(1), F.lit(40))), danda, F.substr("text", F.lit(41)), F.lit(" [12] | end"))
    queries = table(spark, d, "benchmark").select("item_id", typed.alias("typed"))
    found = parallels.passages(table(spark, d, "conversations"), "conv_id", "turn", "text").where(F.col("type") == parallels.VERSE)
    first = F.ascii(F.regexp_extract("number", r"([a-z])", 1))
    own = found.select("type", (F.col("conv_id") * 100 + F.when(first > 0, F.expr("(ascii(regexp_extract(number, '([a-z])', 1)) - 97) div 4")).otherwise(0)).alias("id"), parallels._spaced(T.fold_passage(T.clean_passage(F.col("text")))).alias("t"))
    return parallels.search_passages(queries, "item_id", "typed", own, "id", F.col("t"), parallels.VERSE)
