"""A training corpus from documents: quality rules, line and near de-duplication, source mixing, packing.

Every stage reads what its predecessor wrote and works on all of it.  All stages take an empty table (and return one), texts
of any length as a whole, and further columns under any names; what they do with nulls, ties and repeated rows they say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import line_dedup, mixing, near_dedup, packing, quality
from graphloom.llm.common import Workspace, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects.

    Null, empty and blank texts are rejected for their few words; nulls elsewhere don't matter.  Equal rows are kept or
    rejected together.  Rows and columns stay as they are.
    """
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go; the documents stay, with n_chars of the text that is left.

    A null text stays null, with a null n_chars; blank lines stay.  Rows with a null source are one source.  Equal rows count
    as a page each and stay equal.  A line at exactly the ratio stays.
    """
    out = line_dedup.drop_boilerplate(docs)
    return out.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else c for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, a similarity of 0.8 or more.

    The one with the smallest id stays.  Null and blank texts and rows with a null id are no duplicates and all stay.  Of
    rows with one id and one text one stays; rows with one id and different texts stay if one of them would.
    """
    return near_dedup.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Null, empty and blank texts have no words and are never taken.  A null source is a source of its own, a null id an id
    like others.  Rows with one id and one text are taken alike; ties of keys fall to smaller ids, then hashes of texts.
    """
    return mixing.Mix(docs).documents()


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences with their ids.

    A null text is empty, so every row has its end id at least.  Rows with equal or null ids are documents of their own.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Packing needs a tokenizer, which SQL doesn't have; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder before the next stage reads it."""
    work, docs = Workspace(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
