"""A training corpus from raw documents: filter, deduplicate and pack, one operator per stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmine.llm import jaccard, packing, quality, substrings, toxicity
from shelfmine.llm.common import table
from shelfmine.session import cut_lineage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half; learned from the labelled ones among ``docs``."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_repetitive(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one of the smallest id."""
    return jaccard.keep_one(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that another document keeps."""
    return substrings.cut_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of fixed capacity."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_repetitive),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", cut_passages),
    ("best-fit packing", pack),
]

# a nearest-neighbour classifier and minimal hashing are not SQL; tests compare run() with a plain version of each stage
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is a table before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
