"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes
each result as Parquet and hands the reread table to the next.  All but the
last return the columns of `documents`.

Defined results: an empty table gives an empty table with the same columns.
Other columns of any name, also those that the operators use inside, stay with
their rows through the first four stages.  Rows of null texts have no language
and go in the first stage; given to a later one they stay.  Null ids and
sources are values of their own; repeated rows are judged alike, but of them
the near-duplicate stage keeps one.  Whole texts count, however long.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dimweave.llm.common import Scratch, table
from dimweave.llm.jaccard_join import jaccard_components
from dimweave.llm.language_id import fit_on_documents, identify_language
from dimweave.llm.line_dedup import dedup_lines
from dimweave.llm.mixing import WEIGHTS, mix_sources
from dimweave.llm.packing import pack


#: The columns that stages work on.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def sets_others_aside(stage: Stage) -> Stage:
    """`stage` with columns other than COLUMNS under names that no operator uses."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain = docs.toDF(*(c if c in COLUMNS else f"aside_{i}" for i, c in enumerate(docs.columns)))
        return stage(spark, plain, sf_dir).toDF(*docs.columns)

    return run


@sets_others_aside
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that are rejected go."""
    return identify_language(docs, fit_on_documents(docs)).where("not rejected").select(*docs.columns)


@sets_others_aside
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less their duplicate lines; those of which nothing is left go."""
    cut = dedup_lines(docs).where("n_kept > 0 or n_lines = 0")
    return cut.withColumn("n_chars", F.when(F.col("n_kept") < F.col("n_lines"), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


@sets_others_aside
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest id, rows without an id last, then by the text's hash.

    Rows are told apart by a number of their own, so of repeated rows one
    stays, and rows that share an id stand for themselves.  Rows without
    words are in no group, and all stay.
    """
    scratch = Scratch(spark)
    numbered = scratch.keep(docs.withColumn("row_", F.monotonically_increasing_id()))
    groups = jaccard_components(numbered, "row_").where("n_shingles > 0").select("row_", "component_id")
    rank = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", F.xxhash64("text").alias("hash"), "row_")
    named = scratch.keep(groups.join(numbered.select("row_", rank.alias("rank")), "row_"))
    several = named.where("row_ <> component_id").select("component_id").distinct()
    members = named.join(several, "component_id", "left_semi")
    best = members.groupBy("component_id").agg(F.min("rank").alias("best"))
    copies = scratch.keep(members.join(best, "component_id").where("row_ <> best.row_").select("row_"))
    return numbered.join(scratch.small(copies), "row_", "left_anti").select(*docs.columns)


@sets_others_aside
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights, in random order."""
    return mix_sources(docs, WEIGHTS).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("jaccard_join", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Language centroids, tokens and MinHash cannot be stated in SQL; tests/llm compares some operators with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole of `documents`."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
