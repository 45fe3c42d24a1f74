"""Persistent keyword index: bucketed parquet tables.

Postings are bucketed by chunk and sorted by term inside a bucket. The score of a (query, chunk) pair is then
summed without an exchange. Vocabularies of up to 1,000 terms are pushed to the reader, where the statistics of the
sorted terms skip pages and row groups; larger ones read all postings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from shelfmine.operators.catalog import without_slugs
from shelfmine.operators.lexical import LexicalIndex, build_index, index_of_tokens, term_stats
from shelfmine.session import cut_lineage

BUCKETS = 64
PARTS = ("lengths", "postings", "term_stats")


class IndexNotFound(FileNotFoundError):
    """No index was written at the given place."""


def write_index(index: LexicalIndex, name: str, path: str, buckets: int = BUCKETS) -> LexicalIndex:
    """Write the three tables under ``path`` and register them as ``{name}_{part}``."""
    spark = index.postings.sparkSession
    folder = path.rstrip("/")
    if index.tokens is not None:
        index = index_of_tokens(cut_lineage(index.tokens, "tokens"))  # the texts are tokenised once
    bucketed = index.postings.repartition(buckets, "chunk_id")
    (
        bucketed.write.mode("overwrite")
        .bucketBy(buckets, "chunk_id")
        .sortBy("term")
        .option("path", f"{folder}/postings")
        .saveAsTable(f"{name}_postings")
    )
    index.lengths.write.mode("overwrite").option("path", f"{folder}/lengths").saveAsTable(f"{name}_lengths")
    stored = LexicalIndex(spark.table(f"{name}_lengths"), spark.table(f"{name}_postings"))
    term_stats(stored).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").option(
        "path", f"{folder}/term_stats"
    ).saveAsTable(f"{name}_term_stats")
    return open_index(spark, name)


def open_index(spark: SparkSession, name: str) -> LexicalIndex:
    if not all(spark.catalog.tableExists(f"{name}_{part}") for part in PARTS):
        raise IndexNotFound(f"no index named {name}")
    return LexicalIndex(
        lengths=spark.table(f"{name}_lengths"),
        postings=spark.table(f"{name}_postings"),
        term_stats=spark.table(f"{name}_term_stats"),
    )


def attach_index(spark: SparkSession, name: str, path: str, buckets: int = BUCKETS) -> LexicalIndex:
    """Register tables written by another session."""
    folder = path.rstrip("/")
    for part in PARTS:
        try:
            schema = spark.read.parquet(f"{folder}/{part}").schema
        except AnalysisException as error:
            raise IndexNotFound(f"no index at {path}") from error
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        layout = f" CLUSTERED BY (chunk_id) SORTED BY (term) INTO {buckets} BUCKETS" if part == "postings" else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name}_{part} ({columns}) USING parquet{layout} LOCATION '{folder}/{part}'")
    return open_index(spark, name)


def drop_index(spark: SparkSession, name: str) -> None:
    for part in PARTS:
        spark.sql(f"DROP TABLE IF EXISTS {name}_{part}")


def index_without(index: LexicalIndex, slugs: DataFrame) -> LexicalIndex:
    """The index without some documents; statistics follow from what is left."""
    return LexicalIndex(without_slugs(index.lengths, slugs), without_slugs(index.postings, slugs))


def index_replacing(index: LexicalIndex, chunks: DataFrame, slugs: DataFrame | None = None) -> LexicalIndex:
    """Re-ingestion: the chunks of the incoming slugs replace all their earlier ones. ``slugs`` names the incoming ones
    where some may have no chunks."""
    fresh = build_index(chunks)
    kept = index_without(index, chunks.select("slug") if slugs is None else slugs)
    return LexicalIndex(
        kept.lengths.unionByName(fresh.lengths.select(*kept.lengths.columns)),
        kept.postings.unionByName(fresh.postings.select(*kept.postings.columns)),
    )


def empty_index(spark: SparkSession) -> LexicalIndex:
    nothing = spark.createDataFrame([], "chunk_id string, slug string, text string")
    return build_index(nothing)

