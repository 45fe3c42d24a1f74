"""Search over a library: keyword and vector candidates, fusion, passages.

Every plan takes a table of queries ``(qid, query)``, optionally with ``slug``, and answers all of them at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmine.functions.text import citation, dynamic_alpha, parse_timestamp, preprocess_query, snippet
from shelfmine.operators.catalog import result_limit
from shelfmine.operators.diversify import diversify
from shelfmine.operators.fusion import ALPHA, weighted_fusion
from shelfmine.operators.lexical import LexicalIndex, bm25_topk
from shelfmine.operators.models import Embedder, HashingEmbedder, KeywordRephraser, Rephraser
from shelfmine.operators.skew import join_small
from shelfmine.session import cut_lineage
from shelfmine.operators.vectors import cosine_topk

TOP_K = 7
BASELINE_MULTIPLIER = 2
ADAPTIVE_MULTIPLIER = 3
DIVERSIFY_ABOVE = 5


@dataclass(frozen=True)
class Library:
    """Chunks with their two indexes.

    ``chunks`` holds ``chunk_id, slug, text`` and any metadata columns, ``vectors`` holds ``chunk_id, slug,
    vector``. Without an ``index`` searches use vectors alone.
    """

    chunks: DataFrame
    vectors: DataFrame
    index: LexicalIndex | None
    embedder: Embedder = field(default_factory=HashingEmbedder)


def embedded(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """Vector table of a chunk table."""
    return embedder.embed(chunks.select("chunk_id", "slug", "text"), "text").drop("text")


def vector_search(queries: DataFrame, library: Library, k: int) -> DataFrame:
    """Cosine candidates for the raw query text, within the slug of the query when it has one."""
    points = library.vectors.select("chunk_id", F.col("slug").alias("group_key"), "vector")
    group = F.col("slug") if "slug" in queries.columns else F.lit(None).cast("string")
    wanted = library.embedder.embed(queries.select("qid", group.alias("group_key"), "query"), "query")
    return cosine_topk(wanted, points, k)


def hybrid_search(
    queries: DataFrame,
    library: Library,
    k: int = TOP_K,
    preprocess: bool = True,
    dynamic: bool = False,
    multiplier: int = ADAPTIVE_MULTIPLIER,
    alpha: float = ALPHA,
) -> DataFrame:
    """``(qid, rank, chunk_id, score)``: both candidate lists are ``k * multiplier`` long before the fusion.

    Only the keyword side sees the preprocessed query. Without a keyword index the vector list is returned.
    Queries with a ``limit`` column have their own limit, at most ``k``, and pools to match.
    """
    limits = queries.select("qid", "limit") if "limit" in queries.columns else None
    if library.index is None:
        return _within(vector_search(queries, library, k), limits, 1)
    depth = k * multiplier
    text = preprocess_query(F.col("query")) if preprocess else F.col("query")
    keyword = _within(bm25_topk(queries.withColumn("query", text), library.index, depth), limits, multiplier)
    vector = _within(vector_search(queries, library, depth), limits, multiplier)
    weight = queries.select("qid", dynamic_alpha(F.col("query"), alpha).alias("alpha")) if dynamic else alpha
    return _within(weighted_fusion(keyword, vector, k, weight), limits, 1)


def _within(ranked: DataFrame, limits: DataFrame | None, multiplier: int) -> DataFrame:
    """Ranked lists cut to the limit of each query."""
    if limits is None:
        return ranked
    return ranked.join(limits, "qid").where(F.col("rank") <= F.col("limit") * multiplier).drop("limit")


def baseline_search(queries: DataFrame, library: Library, k: int = TOP_K, alpha: float = ALPHA) -> DataFrame:
    """Raw query on both sides and the smaller candidate pools."""
    return hybrid_search(queries, library, k, preprocess=False, multiplier=BASELINE_MULTIPLIER, alpha=alpha)


def passages(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Results with the text and metadata of their chunks; texts are fetched for the winners only.

    The list is written first, so that the search behind it runs once, and its size is counted on the written rows.
    """
    return join_small(chunks, cut_lineage(results, "hits"), ["chunk_id"], "chunk_id")


def with_snippets(hits: DataFrame, limit: int = 800) -> DataFrame:
    return hits.withColumn("text", snippet(F.col("text"), limit))


def spread_conversations(hits: DataFrame) -> DataFrame:
    """Diversified hits where the document is a conversation and there are more than five of them.

    ``hits`` carries ``qid, rank, doc_type, speaker, timestamp``. Other lists keep their order. The new order is
    in ``position``.
    """
    own = W.partitionBy("qid")  # a list has at most as many rows as its limit
    sized = hits.withColumns(
        {"_n": F.count(F.lit(1)).over(own), "_talk": F.max(F.col("doc_type") == "conversation").over(own)}
    )
    sized = cut_lineage(sized, "sized")
    spread = F.col("_talk") & (F.col("_n") > DIVERSIFY_ABOVE)
    chosen = diversify(
        sized.where(spread).select("qid", "rank", "speaker", parse_timestamp(F.col("timestamp")).alias("ts"))
    )
    kept = sized.where(spread).join(chosen, ["qid", "rank"])
    plain = sized.where(~spread).withColumn("position", F.col("rank"))
    return kept.unionByName(plain).drop("_n", "_talk")


def cited(hits: DataFrame) -> DataFrame:
    """Hits with a ``citation`` from whatever metadata columns they have."""
    text = lambda name: F.col(name) if name in hits.columns else F.lit(None).cast("string")
    speakers = F.col("speakers") if "speakers" in hits.columns else F.lit(None).cast("array<string>")
    said_at = F.coalesce(
        *[F.nullif(text(c), F.lit("")) for c in ("timestamp", "created_at", "timestamp_start")]
    )
    speaker = F.coalesce(F.nullif(text("speaker"), F.lit("")), text("author"))
    section = F.col("section") if "section" in hits.columns else None
    return hits.withColumn(
        "citation",
        citation(F.col("chunk_id").cast("string"), speakers, speaker, text("heading"), said_at, section),
    )


def search_documents(requests: DataFrame, library: Library, documents: DataFrame, several: bool = False, **options) -> DataFrame:
    """One search per (qid, slug), each with its own limit.

    ``requests`` is ``(qid, query, slug)`` with an optional ``limit``; the default limit follows the document
    type. All requests are answered by one plan, which searches to the largest limit and cuts each list.
    """
    kinds = documents.select("slug", "doc_type")
    limit = F.col("limit") if "limit" in requests.columns else F.lit(None).cast("int")
    asked = requests.join(kinds, "slug", "left").withColumn(
        "limit", F.coalesce(limit, result_limit(F.col("doc_type"), several))
    )
    keyed = asked.withColumn("request", F.concat_ws("|", F.col("qid").cast("string"), "slug"))
    queries = keyed.select(F.col("request").alias("qid"), "query", "slug", "limit")
    deepest = keyed.agg(F.max("limit")).first()[0] or TOP_K
    found = hybrid_search(queries, library, deepest, **options)
    return (
        found.withColumnRenamed("qid", "request")
        .join(keyed.select("request", "qid", "slug", "doc_type", "limit"), "request")
        .drop("request")
    )


def retry_empty(
    queries: DataFrame, counts: DataFrame, rephraser: Rephraser | None = None
) -> tuple[DataFrame, DataFrame]:
    """Queries to run again and the retry record of every query.

    A query without results is rephrased once. When there is no other phrasing it falls back to the model's
    own knowledge. ``counts`` is ``(qid, num_results)``.
    """
    rephraser = rephraser or KeywordRephraser()
    state = queries.join(counts, "qid", "left").withColumn("num_results", F.coalesce("num_results", F.lit(0)))
    other = rephraser.rephrase(F.col("query"))
    empty = F.col("num_results") == 0
    usable = empty & (other != "") & (other != F.col("query"))
    record = state.select(
        "qid",
        "query",
        "num_results",
        F.when(usable, other).alias("rephrased_query"),
        usable.alias("retry_attempted"),
        (empty & ~usable).alias("fallback_to_context"),
    )
    again = record.where(F.col("retry_attempted")).select("qid", F.col("rephrased_query").alias("query"))
    return again, record


def retried(record: DataFrame, retry_counts: DataFrame) -> DataFrame:
    """Retry record completed with the second result counts; a second empty result sets the fallback flag."""
    second = retry_counts.select("qid", F.col("num_results").alias("_second"))
    tried = F.col("retry_attempted")
    results = F.when(tried, F.coalesce("_second", F.lit(0)))
    return (
        record.join(second, "qid", "left")
        .withColumn("retry_results", results)
        .withColumn("fallback_to_context", F.col("fallback_to_context") | (tried & (F.col("retry_results") == 0)))
        .withColumn("num_results", F.when(tried & (F.col("retry_results") > 0), F.col("retry_results")).otherwise(F.col("num_results")))
        .drop("_second")
    )
