"""Ingestion of a batch of documents: parse, summarise, store, index, verify.

All documents of a batch go through one plan per type. Re-ingesting a slug replaces everything stored for it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmine import schema
from shelfmine.operators import catalog, models, parsers
from shelfmine.operators.chunking import chunk_totals, section_texts
from shelfmine.operators.lexical import LexicalIndex
from shelfmine.operators.models import Embedder, ExtractiveSummarizer, HashingEmbedder, Summarizer
from shelfmine.plans.search import Library, embedded
from shelfmine.session import RELEASED, cut_lineage, drop_steps, settings
from shelfmine.sources.index_store import BUCKETS, attach_index, empty_index, index_replacing, index_without, write_index
from shelfmine.sources.segments import CODEC, SegmentedLibrary, index_tables, written_tokens

TABLES = ("documents", "chunks", "section_summaries", "document_summaries", "vectors")

CHUNK_TYPES = {
    "chunk_id": "string", "slug": "string", "doc_type": "string", "section": "int", "chunk": "int", "text": "string",
    "hash": "string", "num_tokens": "int", "num_chars": "int", "heading": "string", "speakers": "array<string>",
    "timestamp_start": "string", "timestamp_end": "string",
}


@dataclass(frozen=True)
class Stores:
    """The tables of a library. Frames are lazy; write them when a batch is complete."""

    documents: DataFrame
    chunks: DataFrame
    section_summaries: DataFrame
    document_summaries: DataFrame
    vectors: DataFrame
    index: LexicalIndex

    def library(self, embedder: Embedder | None = None) -> Library:
        return Library(self.chunks, self.vectors, self.index, embedder or HashingEmbedder())


def empty_stores(spark: SparkSession) -> Stores:
    nothing = lambda ddl: spark.createDataFrame([], ddl)
    return Stores(
        documents=nothing(schema.DOCUMENTS),
        chunks=nothing(", ".join(f"{name} {kind}" for name, kind in CHUNK_TYPES.items())),
        section_summaries=nothing("slug string, section int, summary string"),
        document_summaries=nothing("slug string, summary string"),
        vectors=nothing("chunk_id string, slug string, vector array<double>"),
        index=empty_index(spark),
    )


def acceptable_slug(slug: Column) -> Column:
    """Letters and digits once ``_`` and ``-`` are removed."""
    return F.regexp_replace(slug, "[_-]", "").rlike(r"(?U)^[\p{L}\p{N}]+$")


def checked(incoming: DataFrame, stored: DataFrame, replace_known: bool) -> DataFrame:
    """The incoming documents; fails on a bad slug or type, a slug that comes twice, or a known one that may not be
    replaced."""
    bad = incoming.where(~acceptable_slug(F.col("slug")) | ~F.col("doc_type").isin(*schema.DOC_TYPES)).select("slug")
    sample = [r[0] for r in bad.limit(5).collect()]
    if sample:
        raise ValueError(f"invalid slug or document type: {sample}")
    twice = [r[0] for r in incoming.groupBy("slug").count().where("count > 1").select("slug").limit(5).collect()]
    if twice:
        raise ValueError(f"slugs come more than once: {twice}")
    if not replace_known:
        known = [r[0] for r in incoming.select("slug").join(stored.select("slug"), "slug", "left_semi").limit(5).collect()]
        if known:
            raise ValueError(f"already stored, pass replace_known=True to overwrite: {known}")
    return incoming


def parsed_chunks(incoming: DataFrame, max_tokens: int = 500, overlap: int = 100) -> DataFrame:
    """One chunk table for all document types."""
    chunks = parsers.chunks_of_all_types(incoming, max_tokens, overlap)
    return chunks.select(*[F.col(name).cast(kind).alias(name) for name, kind in CHUNK_TYPES.items()])


def metadata_of(incoming: DataFrame) -> DataFrame:
    """``(slug, metadata)`` as JSON, without null characters. Books carry none."""
    out = None
    for doc_type in ("script", "conversation", "tech_doc", "report"):
        rows = parsers.document_metadata(incoming.where(F.col("doc_type") == doc_type), doc_type)
        fields = [c for c in rows.columns if c != "slug"]
        as_json = F.replace(F.to_json(F.struct(*fields)), F.lit("\\u0000"), F.lit(""))
        part = rows.select("slug", as_json.alias("metadata"))
        out = part if out is None else out.unionByName(part)
    return out


def ingest(
    incoming: DataFrame,
    stores: Stores,
    max_tokens: int = 500,
    overlap: int = 100,
    replace_known: bool = False,
    summarizer: Summarizer | None = None,
    embedder: Embedder | None = None,
) -> Stores:
    """Stores with the batch ``(slug, title, author, doc_type, text)`` added or replaced."""
    checked(incoming, stores.documents, replace_known)
    highest = stores.documents.agg(F.coalesce(F.max("book_id"), F.lit(0))).first()[0]
    batch = batch_tables(incoming, highest, max_tokens, overlap, summarizer, embedder)
    chunks, others = batch["chunks"], ("chunks", "section_summaries", "document_summaries", "vectors")
    return replace(
        stores,
        documents=catalog.upsert_documents(stores.documents, batch["documents"]),
        index=index_replacing(stores.index, chunks, incoming.select("slug")),
        **{name: catalog.without_slugs(getattr(stores, name), incoming).unionByName(batch[name]) for name in others},
    )


def batch_tables(
    incoming: DataFrame,
    highest: int,
    max_tokens: int = 500,
    overlap: int = 100,
    summarizer: Summarizer | None = None,
    embedder: Embedder | None = None,
) -> dict[str, DataFrame]:
    """The tables of one batch of documents, numbered from ``highest + 1`` on."""
    summarizer, embedder = summarizer or ExtractiveSummarizer(), embedder or HashingEmbedder()
    # five tables follow from the chunks, so they are parsed and written once
    chunks = cut_lineage(parsed_chunks(incoming, max_tokens, overlap))
    sections = sections_of(chunks, summarizer)
    return {
        "documents": documents_of(incoming, chunks, numbers_of(incoming), highest),
        "chunks": chunks,
        "section_summaries": sections,
        "document_summaries": summaries_of(sections, incoming, summarizer),
        "vectors": embedded(chunks, embedder),
    }


def sections_of(chunks: DataFrame, summarizer: Summarizer) -> DataFrame:
    sections = models.section_summaries(section_texts(chunks), summarizer)
    return sections.withColumn("section", F.col("section").cast("int"))


def summaries_of(sections: DataFrame, incoming: DataFrame, summarizer: Summarizer) -> DataFrame:
    """Summaries of documents from those of their sections."""
    kinds = incoming.select("slug", "doc_type")
    overall = None
    for doc_type in schema.DOC_TYPES:
        own = sections.join(kinds.where(F.col("doc_type") == doc_type).select("slug"), "slug", "left_semi")
        part = models.document_summaries(own, summarizer, doc_type)
        overall = part if overall is None else overall.unionByName(part)
    return overall


def numbers_of(incoming: DataFrame) -> DataFrame:
    """``(slug, _n)``, written once, so that every later use sees the same identifiers."""
    return cut_lineage(incoming.select("slug", F.monotonically_increasing_id().alias("_n")))


def documents_of(incoming: DataFrame, chunks: DataFrame, numbered: DataFrame, highest: int) -> DataFrame:
    """Catalogue rows of a batch, numbered from ``highest + 1`` on."""
    return (
        incoming.select("slug", "title", "author", "doc_type")
        .join(numbered, "slug")
        .join(chunk_totals(chunks).select("slug", "num_chunks", F.col("num_chars").alias("_chars")), "slug", "left")
        .join(metadata_of(incoming), "slug", "left")
        .select(
            (F.lit(highest) + F.col("_n") + 1).alias("book_id"),
            "slug",
            "title",
            "author",
            F.coalesce("num_chunks", F.lit(0)).cast("int").alias("num_chunks"),
            F.coalesce("_chars", F.lit(0)).cast("long").alias("num_chars"),
            "doc_type",
            F.coalesce("metadata", F.lit("{}")).alias("metadata"),
            F.localtimestamp().alias("added_at"),
        )
    )


def append(
    incoming: DataFrame,
    library: SegmentedLibrary,
    replace_known: bool = False,
    max_tokens: int = 500,
    overlap: int = 100,
    summarizer: Summarizer | None = None,
    embedder: Embedder | None = None,
) -> SegmentedLibrary:
    """The stored library with a batch ``(slug, title, author, doc_type, text)`` added or replaced; only the batch is
    written. A known document keeps its number and the time at which it was added. The other tables follow from the stored
    chunks, so no copy of the batch stays beside the library."""
    summarizer, embedder = summarizer or ExtractiveSummarizer(), embedder or HashingEmbedder()
    empty = not library.segments
    with settings(incoming.sparkSession, RELEASED):
        stored = empty_stores(incoming.sparkSession).documents if empty else library.table("documents")
        checked(incoming, stored, replace_known)
        parsed = cut_lineage(parsed_chunks(incoming, max_tokens, overlap), "chunks", CODEC)
        segment = library.begin(None if empty else incoming.select("slug"))
        segment.write({"chunks": parsed})
        drop_steps(parsed)
        chunks = segment.stored("chunks")
        segment.write({"section_summaries": sections_of(chunks, summarizer)})
        sections = segment.stored("section_summaries").drop("bucket")
        segment.write({"document_summaries": summaries_of(sections, incoming, summarizer)})
        # numbers grow with every batch; the highest so far is noted in the library, so that no batch looks for it
        noted, numbers = library.manifest["notes"].get("highest_book_id", 0), numbers_of(incoming)
        known = stored.join(incoming.select("slug"), "slug", "left_semi")
        segment.write({"documents": catalog.upsert_documents(known, documents_of(incoming, chunks, numbers, noted))})
        drop_steps(numbers)
        highest = segment.stored("documents").agg(F.max("book_id")).first()[0] or 0
        # vectors of hashed terms come from the terms that are written for the index
        tokens = written_tokens(chunks, "bucket")
        if isinstance(embedder, HashingEmbedder):
            segment.follow({"vectors": embedder.of_runs(tokens.select("chunk_id", "slug", "bucket", "runs"), "runs")})
        else:
            segment.write({"vectors": embedded(chunks, embedder)})
        segment.follow(index_tables(chunks, tokens))
        drop_steps(tokens)
        return segment.commit({"highest_book_id": max(highest, noted)})


def stores_of(library: SegmentedLibrary) -> Stores:
    """The tables of a stored library, for searches and the tool service."""
    return Stores(**{name: library.table(name) for name in TABLES}, index=library.index())


def save(stores: Stores, folder: str, name: str, buckets: int = BUCKETS) -> Stores:
    """Write all tables to a fresh folder and return the stores that read them."""
    root = folder.rstrip("/")
    for part in TABLES:
        getattr(stores, part).write.mode("errorifexists").parquet(f"{root}/{part}")
    write_index(stores.index, name, f"{root}/index", buckets)
    return load(stores.documents.sparkSession, root, name, buckets)


def load(spark: SparkSession, folder: str, name: str, buckets: int = BUCKETS) -> Stores:
    """Stores written by ``save``, by this session or another one."""
    root = folder.rstrip("/")
    tables = {part: spark.read.parquet(f"{root}/{part}") for part in TABLES}
    return Stores(**tables, index=attach_index(spark, name, f"{root}/index", buckets))


def delete(slugs: DataFrame, stores: Stores) -> Stores:
    """Stores without the documents and everything derived from them."""
    return Stores(
        documents=catalog.without_slugs(stores.documents, slugs),
        chunks=catalog.without_slugs(stores.chunks, slugs),
        section_summaries=catalog.without_slugs(stores.section_summaries, slugs),
        document_summaries=catalog.without_slugs(stores.document_summaries, slugs),
        vectors=catalog.without_slugs(stores.vectors, slugs),
        index=index_without(stores.index, slugs),
    )


def verification(slugs: DataFrame, stores: Stores) -> DataFrame:
    """``(slug, sections, problem)``: an empty problem for a document that is stored, summarised and complete."""
    expected = stores.chunks.groupBy("slug").agg(F.countDistinct("section").alias("_expected"))
    actual = stores.section_summaries.groupBy("slug").agg(F.count(F.lit(1)).alias("sections"))
    joined = (
        slugs.select("slug")
        .join(stores.documents.select("slug", "book_id"), "slug", "left")
        .join(stores.document_summaries.select("slug", "summary"), "slug", "left")
        .join(expected, "slug", "left")
        .join(actual, "slug", "left")
    )
    problem = (
        F.when(F.col("book_id").isNull(), F.lit("not found in the catalogue"))
        .when(F.col("summary").isNull(), F.lit("no summaries found"))
        .when(~F.col("_expected").eqNullSafe(F.col("sections")), F.lit("section count mismatch"))
        .otherwise(F.lit(""))
    )
    return joined.select("slug", F.coalesce("sections", F.lit(0)).alias("sections"), problem.alias("problem"))


def not_yet_summarised(incoming: DataFrame, stores: Stores) -> DataFrame:
    """Documents of a batch that have no summary, for runs that skip finished ones."""
    return incoming.join(stores.document_summaries.select("slug"), "slug", "left_anti")
