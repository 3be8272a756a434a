"""The corpus pipeline: language, near-duplicates, repeats, mixture, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import bpe, langmix, neardup, pfair, suffixes
from glyphmill.llm.common import discard, in_written_order, kept_from, table

#: Rows of the result that one task puts in order.
ORDERED_ROWS = 20_000

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that are learnt, or in a mixture of them; the one with the largest part becomes their ``lang``.

    Texts that fit no mixture go: foreign ones and gibberish.  Languages are
    learnt from four folds of the labelled texts, the least fit from the fifth.
    Null and empty texts and texts without a letter go; repeated rows and rows
    of a null id are judged like any other; if no row has a language, all go.
    """
    model = langmix.learn(docs.where(~langmix.held_out()))
    least = langmix.least_fit(docs.where(langmix.held_out()), model)
    found = langmix.predict(docs.select(*COLUMNS), model)
    return found.where((F.col("lang_pred") != "und") & (F.col("fit") >= least)).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates.

    Repeated rows leave one; texts under one id are documents of their own;
    texts without words and rows of a null id all stay.
    """
    return neardup.unlike(docs.select(*COLUMNS))


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that repeat what stands earlier.

    Null texts stay null, with a null ``n_chars``; rows of a null id stay whole;
    of texts under one id only the least is searched, the others stay whole.
    """
    cut = suffixes.remove_repeats(docs, carry=("lang", "source"))
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture, which is that of the parts written from it and of the rows in them.

    A null source is a source of its own; rows alike in all columns have no order among themselves.
    """
    return pfair.mix(docs.select(*COLUMNS)).repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's ids and of what they decode to, in the mixture's order, with each one's position in it.

    A null text counts as an empty one; every row has its own row in the result.
    """
    mixed, total = in_written_order(docs)
    done = bpe.round_trip(mixed, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, number_col="position")
    # Not orderBy, which would encode twice to sample the positions.
    parts = max(1, -(-total // ORDERED_ROWS))
    return done.repartitionById(parts, F.expr(f"cast(position div {ORDERED_ROWS} as int)")).sortWithinPartitions("position")


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", remove_repeats),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: SQL can't express these stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; a stage's input and its intermediate folders are deleted when its output is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs, at = kept_from(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        discard(spark, before)
        before = [at]
    return STAGES[-1][1](spark, docs, sf_dir)
