"""Licence scans by canonical digests of entire texts, with DataFrame and SQL functions alone.

A text is put in canonical form: letters in lower case, copyright lines gone,
runs of white space, punctuation and symbols one space, equivalent spellings
made one.  The SHA-256 of that joins the digests of known licences made the
same way.

Defined results: a null text is an empty one; a text without a word is no
licence; of licences with one digest the first id in alphabetical order
counts; repeated rows give repeated rows; other columns are ignored; an empty
table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.licence_texts import EQUIVALENT, LICENCES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line's start, comment signs, and a copyright notice or reservation of rights.
NOTICE = r"(^|\n)[ \t#*/;%-]*((copyright|\(c\)|©)[ \t]*(\(c\)|©|[0-9]{4}|<year>|\[year\]|by )[^\n]*|all rights reserved)"
GAP = r"[\x00-\x20\x7F\p{P}\p{S}\p{Z}]+"
#: Up to so many known licences are broadcast; beyond it, the join shuffles by digest.
BROADCAST_ROWS = 20_000


def canonical(df: DataFrame, text_col: str, into: str) -> DataFrame:
    """``df`` with the canonical form of a text; a projection for each step, as its result is used more than once in the next."""
    out = F.col(into)
    notice = out.contains("copyright") | out.contains("(c)") | out.contains("©") | out.contains("all rights reserved")
    df = df.withColumn(into, F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER))
    df = df.withColumn(into, F.when(notice, F.regexp_replace(out, NOTICE, "\n")).otherwise(out))
    out = F.trim(F.regexp_replace(out, GAP, " "))
    for spelling, chosen in EQUIVALENT:
        out = F.replace(out, F.lit(spelling), F.lit(chosen))
    return df.withColumn(into, out)


def known(spark: SparkSession) -> DataFrame:
    """(licence_id, text) of the licences that this package knows."""
    return spark.createDataFrame(sorted(LICENCES.items()), "licence_id string, text string")


def known_in(spark: SparkSession, folder: str) -> DataFrame:
    """(licence_id, text) of the licences in a folder's files (as ``Apache-2.0`` or ``GPL-3.0.txt``), beside those of ``known``; long licences come this way.

    A file's name is its licence's id; a file with the text of a known licence
    gives that text a second id, of which the first in alphabetical order counts.
    """
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True)
    name = F.regexp_replace(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1), r"\.(txt|md)$", "")
    return files.select(name.alias("licence_id"), F.col("value").alias("text")).unionByName(known(spark))


def scan(df: DataFrame, licences: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, canonical_chars, canonical_sha256, licence_id) of every text; the last is null if no licence has its digest."""
    digest = F.sha2(F.col("c").cast("binary"), 256).alias("canonical_sha256")
    known = canonical(licences.select("licence_id", "text"), "text", "c").where("c <> ''")
    by_digest = known.groupBy(digest).agg(F.min("licence_id").alias("licence_id"))
    if licences.count() <= BROADCAST_ROWS:
        by_digest = F.broadcast(by_digest)
    forms = canonical(df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), "t", "c")
    return forms.select("i", F.length("c").cast("long").alias("canonical_chars"), digest).join(by_digest, "canonical_sha256", "left").select(F.col("i").alias(id_col), "canonical_chars", "canonical_sha256", "licence_id")


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    out = f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"
    out = f"trim(regexp_replace(regexp_replace({out}, {_sql(NOTICE)}, chr(10), 'g'), {_sql(GAP)}, ' ', 'g'), ' ')"
    for spelling, chosen in EQUIVALENT:
        out = f"replace({out}, {_sql(spelling)}, {_sql(chosen)})"
    return out


#: The query over ``documents``, for DuckDB.
ORACLE = f"""
with known(licence_id, text) as (values {", ".join(f"({_sql(k)}, {_sql(v)})" for k, v in sorted(LICENCES.items()))}),
by_digest as (select sha256({_canonical_sql("text")}) as canonical_sha256, min(licence_id) as licence_id from known group by 1),
forms as (select doc_id, {_canonical_sql("text")} as c from documents)
select doc_id, length(c)::bigint as canonical_chars, sha256(c) as canonical_sha256, licence_id
from forms left join by_digest on sha256(c) = canonical_sha256
"""
