"""Document catalogue: upserts, lookups, listings and deletes as keyed joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmine.operators.skew import join_small

# Default result limits by document type, for one document and for several.
SINGLE_LIMITS = {"conversation": 15, "other": 5}
MULTI_LIMITS = {"conversation": 8, "other": 3}


def upsert_documents(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert or overwrite by slug; a known document keeps its ``book_id`` and ``added_at``.

    The slug is a unique key: of several incoming rows of one slug the last by ``added_at``, then ``book_id``, counts.
    """
    row = F.struct(*incoming.columns)
    incoming = incoming.groupBy("slug").agg(F.max_by(row, F.struct("added_at", "book_id")).alias("_row")).select("_row.*")
    old = stored.select("slug", F.col("book_id").alias("_id"), F.col("added_at").alias("_added"))
    merged = (
        incoming.join(old, "slug", "left")
        .withColumn("book_id", F.coalesce("_id", "book_id"))
        .withColumn("added_at", F.coalesce("_added", "added_at"))
        .drop("_id", "_added")
    )
    untouched = stored.join(incoming.select("slug"), "slug", "left_anti")
    return untouched.unionByName(merged).select(*stored.columns)


def upsert_summaries(stored: DataFrame, incoming: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows of ``incoming`` replace rows with the same keys.

    One row per key stays: of several incoming rows the last by ``created_at``, if there is one, then the one of the
    largest other values. Null keys are equal to each other, so a row of a null key is replaced as well.
    """
    facts = [c for c in stored.columns if c not in keys]
    order = F.struct(*sorted(facts, key=lambda c: c != "created_at"))
    row = F.struct(*stored.columns)
    latest = incoming.groupBy(*keys).agg(F.max_by(row, order).alias("_row")).select("_row.*")
    same = [F.col(f"_old.{k}").eqNullSafe(F.col(f"_new.{k}")) for k in keys]
    kept = stored.alias("_old").join(latest.alias("_new"), same, "left_anti")
    return kept.unionByName(latest).select(*stored.columns)


def delete_documents(ids: DataFrame, documents: DataFrame, *dependents: DataFrame) -> tuple[DataFrame, ...]:
    """Documents and all dependent tables without the given ``book_id`` values."""
    return tuple(t.join(ids.select("book_id"), "book_id", "left_anti") for t in (documents, *dependents))


def without_slugs(table: DataFrame, slugs: DataFrame) -> DataFrame:
    return join_small(table, slugs.select("slug").distinct(), ["slug"], table.columns[0], "left_anti").select(*table.columns)


def resolve(identifiers: DataFrame, documents: DataFrame) -> DataFrame:
    """``(identifier, book_id)``: the document of that slug, else of that title ignoring case, else of that id.

    A text of digits may be a title, so it counts as an id only after both, and only if a document has it. Texts that
    are no 64-bit number are no id.
    """
    by_slug = documents.groupBy(F.col("slug").alias("identifier")).agg(F.min("book_id").alias("_slug_id"))
    by_title = documents.groupBy(F.lower("title").alias("_title")).agg(F.min("book_id").alias("_title_id"))
    ids = documents.select(F.col("book_id").alias("_number")).distinct()
    number = F.when(F.col("identifier").rlike("^[0-9]+$"), F.col("identifier").try_cast("long"))
    wanted = identifiers.select("identifier", F.lower("identifier").alias("_title"), number.alias("_asked"))
    return (
        wanted.join(by_slug, "identifier", "left")
        .join(by_title, "_title", "left")
        .join(ids, F.col("_asked") == F.col("_number"), "left")
        .select("identifier", F.coalesce("_slug_id", "_title_id", "_number").alias("book_id"))
    )


def has_summaries(documents: DataFrame, document_summaries: DataFrame) -> DataFrame:
    return documents.join(document_summaries.select("book_id"), "book_id", "left_semi")


def library(documents: DataFrame) -> DataFrame:
    """Listing by newest with display defaults."""
    return documents.orderBy(F.desc("added_at"), "slug").select(
        "slug",
        "title",
        F.coalesce(F.nullif("author", F.lit("")), F.lit("Unknown")).alias("author"),
        F.coalesce("num_chunks", F.lit(0)).alias("num_chunks"),
        F.coalesce(F.date_format("added_at", "yyyy-MM-dd HH:mm"), F.lit("Unknown")).alias("added_at"),
    )


def agent_lines(documents: DataFrame) -> DataFrame:
    """One display line per document, by title."""
    author = F.coalesce(F.concat(F.lit(" by "), F.nullif("author", F.lit(""))), F.lit(""))
    return documents.orderBy("title", "slug").select(
        "slug",
        F.lower("title").alias("title_key"),
        F.coalesce("doc_type", F.lit("book")).alias("doc_type"),
        F.concat(F.lit("- ["), F.col("slug"), F.lit("] "), F.col("title"), author).alias("line"),
    )


def slug_check(candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """``(slug, message)``, an empty message for a usable slug."""
    wanted = candidates.select(F.col("slug").alias("given"), F.lower(F.btrim("slug")).alias("slug"))
    taken = documents.select("slug", F.lit(True).alias("_taken")).distinct()
    joined = wanted.join(taken, "slug", "left")
    message = (
        F.when(F.coalesce("slug", F.lit("")) == "", F.lit("no slug given"))
        .when(
            ~F.col("slug").rlike("^[a-z0-9_-]+$"),
            F.lit("a slug has only the characters a-z, 0-9, _ and -"),
        )
        .when(~F.length("slug").between(2, 20), F.lit("a slug has 2 to 20 characters"))
        .when(
            F.col("_taken"),
            F.concat(F.lit("another document has the slug "), F.col("slug")),
        )
        .otherwise(F.lit(""))
    )
    return joined.select("given", message.alias("message"))


def chapter_info(chunks: DataFrame) -> DataFrame:
    """Chunk and section counts, first and last chunk, and section range of each document."""
    position = F.struct("section", "chunk")
    return chunks.groupBy("slug").agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.countDistinct("section").alias("total_chapters"),
        F.min_by("chunk_id", position).alias("first_chunk"),
        F.max_by("chunk_id", position).alias("last_chunk"),
        F.format_string("%02d to %02d", F.min("section"), F.max("section")).alias("chapter_range"),
    )


def chunks_per_section(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("slug", "section").agg(F.count(F.lit(1)).alias("chunks"))


def result_limit(doc_type: Column, several: bool = False) -> Column:
    """Results to return by document type: conversations need more."""
    limits = MULTI_LIMITS if several else SINGLE_LIMITS
    return F.when(doc_type == "conversation", F.lit(limits["conversation"])).otherwise(F.lit(limits["other"]))


def with_title(messages: DataFrame, documents: DataFrame) -> DataFrame:
    """Message with the title of the selected document appended, unless it is already mentioned."""
    titles = documents.select("slug", F.col("title").alias("_title"))
    joined = join_small(messages, titles, ["slug"], "message", "left")
    absent = F.col("_title").isNotNull() & ~F.contains(F.lower("message"), F.lower("_title"))
    extended = F.concat(F.col("message"), F.lit(" (for the document '"), F.col("_title"), F.lit("')"))
    return joined.withColumn("message", F.when(absent, extended).otherwise(F.col("message"))).drop("_title")
