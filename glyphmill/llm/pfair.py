"""Mixing sources to target weights by Pfair scheduling, with DataFrame and SQL functions alone.

Each source's documents are put in the order of a hash of their ids and cut
into blocks.  A cycle has as many slots as all sources have shares, so in a
cycle of W slots a source with c shares has c blocks; its block j is released
at slot floor(j W / c) and due before slot ceil((j + 1) W / c).  Slot by slot,
the released block with the earliest deadline goes next, which meets every
deadline; so at any slot each source is less than one block from its weight.
A source's later blocks follow in later cycles; when a source has ended, its
slots stay empty and the others keep their order.

Shares are the integer weights themselves, so nothing is rounded and the bound
holds for the target weights at any length; a cycle then has as many slots as
the weights' sum, for square roots of sizes at most sqrt(sources * documents).

The cycle is made once, from the shares alone; it is broadcast up to
BROADCAST_SLOTS slots and joined by shuffle beyond.  Positions within a source come
from ranks within buckets of the hash and running sums of bucket sizes, so a
source of any size is spread over tasks, as are rows without an id.

Defined results: a null source is a source of its own; null ids count as
empty texts; rows with equal ids take neighbouring places in the order of a
hash of all their columns, which leaves only rows that are alike without an
order; other columns stay, unless they are called block, slot or place, which
the made ones replace; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import DataType

from glyphmill.llm.common import materialise

BLOCK_DOCS = 8
#: Slots of a cycle that may be broadcast.
BROADCAST_SLOTS = 500_000
#: About so many rows share a bucket of the hash.
BUCKET_ROWS = 512
#: Slots whose picks are listed together, so that lists stay short while they grow.
STEP_SLOTS = 512
#: The hash of a null id.
NO_ID = hashlib.md5(b"").hexdigest()


def _has_map(kind: DataType) -> bool:
    return "map<" in kind.simpleString() or "variant" in kind.simpleString()


def shares(counts: DataFrame, weight: str) -> DataFrame:
    """One row: sorted source keys, the shares of each (its weight, at least 1), and their sum; ``weight`` is SQL over key and n."""
    return (
        counts.selectExpr("key", f"greatest(1L, cast({weight} as bigint)) as c")
        .agg(F.sort_array(F.collect_list(F.struct("key", "c"))).alias("s"))
        .selectExpr("s.key as keys", "s.c as c", "cast(size(s) as bigint) as n", "aggregate(s.c, 0L, (a, x) -> a + x) as cycle")
        .where("n > 0")
    )


def cycle(shared: DataFrame) -> DataFrame:
    """(key, j, c, cycle, slot_in_cycle): where in a cycle each source's block j goes, earliest deadline first."""
    sources = shared.selectExpr("posexplode(arrays_zip(keys, c)) as (pick, own)", "cycle").selectExpr("cast(pick as bigint) as pick", "own.keys as key", "own.c as c", "cycle")
    blocks = sources.selectExpr("pick", "c", "cycle", "explode(sequence(0L, c - 1)) as j")
    released = blocks.selectExpr("(j * cycle) div c as slot", "struct(((j + 1) * cycle + c - 1) div c as by, pick) as due")
    slots = shared.selectExpr("explode(sequence(0L, cycle - 1)) as slot", "cast(null as struct<by: bigint, pick: bigint>) as due").unionByName(released).groupBy("slot").agg(F.collect_list("due").alias("due"))
    steps = slots.groupBy(F.expr(f"slot div {STEP_SLOTS}").alias("step")).agg(F.sort_array(F.collect_list(F.struct("slot", "due"))).alias("s")).selectExpr("step", "s.due as due")
    # One row with a number for each slot; blocks that wait are kept as (due, pick), which differ as each source's dues do.
    none, empty = "cast(array() as array<bigint>)", "cast(array() as array<struct<by: bigint, pick: bigint>>)"
    picked = f"""
        aggregate(steps, named_struct('wait', {empty}, 'out', cast(array() as array<array<bigint>>)), (acc, step) -> transform(array(
          aggregate(step.due, named_struct('wait', acc.wait, 'out', {none}), (a, new) -> transform(array(concat(a.wait, new)),
            w -> named_struct('wait', array_remove(w, array_min(w)), 'out', concat(a.out, array(array_min(w).pick))))[0])),
          z -> named_struct('wait', z.wait, 'out', concat(acc.out, array(z.out))))[0]
        ).out
    """
    picks = steps.agg(F.sort_array(F.collect_list(F.struct("step", "due"))).alias("steps")).selectExpr(f"posexplode(flatten({picked})) as (slot_in_cycle, pick)")
    own = Window.partitionBy("pick").orderBy("slot_in_cycle")
    numbered = picks.select("pick", (F.row_number().over(own) - 1).cast("long").alias("j"), F.col("slot_in_cycle").cast("long").alias("slot_in_cycle"))
    return numbered.join(sources, "pick").select("key", "j", "c", "cycle", "slot_in_cycle")


def mix(df: DataFrame, weight: str = "floor(sqrt(n))", source_col: str = "source", id_col: str = "doc_id", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``df`` with block (of its source), slot and place (in the slot); the mixture is its rows by slot and place.

    ``weight`` is a source's target weight, as SQL over its key and its number of documents ``n``.
    """
    own = [c for c in df.columns if c.lower() not in ("block", "slot", "place")]
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    alike = F.xxhash64(*[F.col(f"`{c}`") for c in own if not _has_map(df.schema[c].dataType)])
    keyed = df.select(*[F.col(f"`{c}`").alias(f"own_{k}") for k, c in enumerate(own)], F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("key"), F.md5(text.cast("binary")).alias("hash"), F.col(id_col).alias("id"), alike.alias("alike"))
    digits = max(1, math.ceil(math.log(max(df.count(), 1) / BUCKET_ROWS, 16)))
    # Rows without an id share one hash: they go between the smaller and the larger ones of its bucket, dealt by the other hash.
    spread = F.when(F.col("id").isNull(), F.substring(F.lpad(F.hex("alike"), 16, "0"), 1, digits)).when(F.col("hash") < NO_ID, "").otherwise("~")
    keyed = keyed.withColumn("bucket", F.concat(F.substring("hash", 1, digits), spread))
    sizes = keyed.groupBy("key", "bucket").agg(F.count("*").alias("rows"))
    before = sizes.select("key", "bucket", F.coalesce(F.sum("rows").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    counts = materialise(sizes.groupBy("key").agg(F.sum("rows").alias("n")))  # a row for each source
    length = counts.selectExpr(f"sum(greatest(1L, cast({weight} as bigint)))").first()[0] or 0
    small = F.broadcast if length <= BROADCAST_SLOTS else lambda df: df
    slots = cycle(shares(counts, weight))
    rank = F.row_number().over(Window.partitionBy("key", "bucket").orderBy("hash", "id", F.lpad(F.hex("alike"), 16, "0")))
    placed = (
        keyed.withColumn("rank", rank.cast("long")).join(before, ["key", "bucket"])
        .withColumn("seq", F.col("before") + F.col("rank") - 1)
        .withColumn("block", F.expr(f"seq div {block_docs}"))
    )
    shared = slots.groupBy("key").agg(F.first("c").alias("c"), F.first("cycle").alias("cycle"))
    numbered = placed.join(small(shared), "key").withColumn("j", F.expr("block % c"))
    return numbered.join(small(slots.select("key", "j", "slot_in_cycle")), ["key", "j"]).select(
        *[F.col(f"own_{k}").alias(c) for k, c in enumerate(own)],
        "block", F.expr("(block div c) * cycle + slot_in_cycle").alias("slot"), F.expr(f"seq % {block_docs}").alias("place"),
    )


#: The query over ``documents``, for DuckDB.
ORACLE = f"""
with recursive counts as (select source, count(*) as n from documents group by source),
shared as (select coalesce('=' || source, '') as key, source, greatest(1, cast(floor(sqrt(n)) as bigint))::bigint as c from counts),
numbered as (select key, source, c, row_number() over (order by key) as i from shared),
lists as (select list(c order by i) as cs, count(*) as n, sum(c)::bigint as w from numbered),
steps as (
  select 0::bigint as t, (select list_transform(range(1, n + 1), lambda i: 0::bigint) from lists) as xs, 0::bigint as pick
  union all
  select t + 1, list_transform(range(1, n + 1), lambda i: xs[i] + case when i = m % 1000000 then 1 else 0 end), (m % 1000000)::bigint
  from (
    select t, xs, n, list_min(list_transform(list_filter(range(1, n + 1), lambda i: xs[i] < cs[i] and (xs[i] * w) // cs[i] <= t),
                                             lambda i: (((xs[i] + 1) * w + cs[i] - 1) // cs[i]) * 1000000 + i)) as m
    from steps, lists where t < w)
),
slots as (select pick, t - 1 as slot_in_cycle, row_number() over (partition by pick order by t) - 1 as j from steps where t > 0),
seqs as (select doc_id, d.source, i, c, row_number() over (partition by d.source order by md5(coalesce(doc_id::varchar, '')), doc_id) - 1 as seq
         from documents d join numbered s on d.source is not distinct from s.source)
select doc_id, source, (seq // {BLOCK_DOCS})::bigint as block,
       (((seq // {BLOCK_DOCS}) // c) * (select w from lists) + slot_in_cycle)::bigint as slot, (seq % {BLOCK_DOCS})::bigint as place
from seqs join slots on pick = i and j = (seq // {BLOCK_DOCS}) % c
"""
