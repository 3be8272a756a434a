"""Queries of streams: the bibliography's versions, repositories' state, lines of chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.plans.registry import query
from glyphmill.session import shared_folder, table
from glyphmill.sources import library
from glyphmill.streaming import state
from glyphmill.streaming.ingest import VersionedTable, ingest


@query("""with l as (select user_id, max(event_id) as version, max_by(event_type, event_id) as kind, max_by(props, event_id) as props from events group by user_id)
          select 'U' || user_id as key, version, 'k' || json_extract_string(props, '$.k') as short_title from l where kind <> 'purchase'""")
def bib_sync(spark, d):
    """Each user's last event as a record, in a library that grows in three versions; a purchase deletes it."""
    at = shared_folder(spark, "library")
    title = F.concat(F.lit("k"), F.get_json_object("props", "$.k"))
    records = table(spark, d, "events").select(F.concat(F.lit("U"), "user_id").alias("key"), F.col("event_id").alias("version"), F.struct(F.lit("book").alias("itemType"), title.alias("shortTitle")).alias("data"), (F.col("event_type") == "purchase").alias("deleted"))
    (last,) = records.agg(F.coalesce(F.max("version"), F.lit(0))).first()
    into = VersionedTable(spark, f"{at}/table", f"key string, version bigint, data {library.RECORD[library.RECORD.index('data:') + 5 : -1]}")
    bounds = sorted({last // 3 + 1, 2 * last // 3 + 1, last + 1})
    for low, high in zip([0, *bounds], bounds):
        # Versions count from 1.
        library.write_version(records.withColumn("version", F.col("version") + 1).where((F.col("version") > low) & (F.col("version") <= high)), f"{at}/pages", high)
        ingest(library.change_stream(spark, f"{at}/pages"), into, "key", "version", F.col("deleted"), f"{at}/checkpoint")
    return into.read().select("key", (F.col("version") - 1).alias("version"), F.col("data.shortTitle").alias("short_title"))


def _events(spark, d):
    schema = table(spark, d, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    return events.select(F.concat(F.lit("r"), F.col("user_id") % 40).alias("repo"), F.col("event_id").alias("number"), F.concat(F.lit("c"), F.get_json_object("props", "$.k").cast("int") % 3).alias("commit_hash"), F.when(F.col("event_type") == "purchase", "new").otherwise("old").alias("code_hash"), F.col("ts").cast("timestamp").alias("at"))


@query("""with e as (select 'r' || (user_id % 40) as repo, event_id as number, 'c' || (json_extract_string(props, '$.k')::int % 3) as c, case when event_type = 'purchase' then 'new' else 'old' end as code, ts from events),
          l as (select *, lag(c) over w as old_c, lag(code) over w as old_code from e window w as (partition by repo order by ts, number)),
          t as (select repo, (epoch_ms((select max(ts) from e)) - epoch_ms(max(ts))) // 3600000 as periods from e group by repo)
          select repo, number, case when old_code is distinct from code then 'all' when old_c = c then 'skip' else 'changed' end as action, 0::bigint as periods from l
          union all select repo, null, 'refresh', periods::bigint from t where periods > 0""")
def repository_states(spark, d):
    return state.run_to_end(state.refreshed(_events(spark, d)), shared_folder(spark, "states"))


@query("""with c as (select conv_id, turn, replace(coalesce(text, ''), ' ', chr(10)) as chunk from conversations),
          t as (select conv_id, string_split(string_agg(chunk, '' order by turn), chr(10)) as x from c group by conv_id),
          l as (select conv_id, unnest(x[:len(x) - 1]) as name, unnest(range(0, len(x) - 1)) as line from t)
          select 'c' || conv_id as source, line::bigint as line, case when strlen(name) <= 12 then name end as name from l""")
def framed_names(spark, d):
    schema = table(spark, d, "conversations").schema
    turns = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/conversations.parquet*")
    chunks = turns.select(F.concat(F.lit("c"), "conv_id").alias("source"), F.col("turn").cast("long").alias("number"), F.replace("text", F.lit(" "), F.lit("\n")).alias("chunk"))
    return state.run_to_end(state.framed(chunks, most=12), shared_folder(spark, "frames"))
