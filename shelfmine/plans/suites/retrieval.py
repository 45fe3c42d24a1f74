"""Tokens, index, keyword search, vector search, fusion and evaluation over the given tables.

Benchmark passages are the queries, documents the chunks, and the source of a document its slug.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmine.functions import text as tx
from shelfmine.operators import evaluation as ev
from shelfmine.operators import blockmax, cells, fusion, lexical, vectors
from shelfmine.operators.models import HashingEmbedder
from shelfmine.operators.rows import unfolded_values
from shelfmine.plans import search
from shelfmine.plans import sqltext as sq
from shelfmine.plans.registry import register, table
from shelfmine.session import cut_lineage, fresh_table_path
from shelfmine.sources.points import page_bounds, write_points
from shelfmine.sources.segments import SegmentedLibrary, index_tables

K = 7


def document_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("slug"), "text"
    )


def benchmark_queries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def document_index(spark: SparkSession, folder: str) -> lexical.LexicalIndex:
    return lexical.build_index(document_chunks(spark, folder))


def document_library(spark: SparkSession, folder: str) -> search.Library:
    """Both indexes over texts that are tokenised once: the terms of each chunk are written and read by either."""
    chunks = document_chunks(spark, folder)
    embedder = HashingEmbedder()
    tokens = cut_lineage(lexical.build_index(chunks).tokens, "tokens")
    vectors = embedder.of_runs(tokens.select("chunk_id", "slug", "runs"), "runs")
    return search.Library(chunks, vectors, lexical.index_of_tokens(tokens), embedder)


Q = "q AS (SELECT item_id AS qid, text AS query FROM benchmark)"
PROCESSED = f"p AS (SELECT qid, {sq.preprocessed('query')} AS query FROM q)"
RESULT = "SELECT qid, rank, chunk_id, score FROM "


# ---------------------------------------------------------------- tokens and index


@register(
    "token_counts",
    f"SELECT doc_id, len(t) AS terms, len(list_distinct(t)) AS distinct_terms FROM (SELECT doc_id, {sq.terms('text')} AS t FROM documents)",
)
def token_counts(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", tx.index_terms(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").alias("terms"), F.size(F.array_distinct("t")).alias("distinct_terms"))


@register("postings", f"WITH {sq.index_ctes()} SELECT doc_id, dl, term, tf FROM post JOIN lens USING (doc_id)")
def postings(spark, folder):
    return document_index(spark, folder).postings.select(F.col("chunk_id").alias("doc_id"), "dl", "term", "tf")


@register("vocab_df", f"WITH {sq.index_ctes()} SELECT term, df FROM idf")
def vocab_df(spark, folder):
    return lexical.document_frequency(document_index(spark, folder).postings)


@register("corpus_stats", f"WITH {sq.index_ctes()} SELECT n, round(avgdl, 6) AS avgdl FROM stats")
def corpus_stats(spark, folder):
    return lexical.corpus_stats(document_index(spark, folder).lengths).select("n", F.round("avgdl", 6).alias("avgdl"))


@register("idf_table", f"WITH {sq.index_ctes()} SELECT term, df, round(idf, 6) AS idf FROM idf")
def idf_table(spark, folder):
    return lexical.term_stats(document_index(spark, folder)).select("term", "df", F.round("idf", 6).alias("idf"))


# ---------------------------------------------------------------- keyword search


@register(
    "bm25_topk",
    f"WITH {Q}, {sq.index_ctes()}, {sq.score_ctes('q', 's')}, {sq.padded_ctes('q', 's', 'r', K)} {RESULT} r",
)
def bm25_topk(spark, folder):
    return lexical.bm25_topk(benchmark_queries(spark, folder), document_index(spark, folder), K)


# the library that three batches and a removal leave: some documents replaced by their first half, some removed, some back
FINAL = """documents AS (
  SELECT doc_id, 'd' || doc_id AS source, CASE WHEN doc_id % 14 <> 0 AND doc_id % 5 = 0 THEN left(text, length(text) // 2) ELSE text END AS text
  FROM main.documents WHERE doc_id % 7 <> 0 OR doc_id % 14 = 0)"""


def grown_library(spark: SparkSession, folder: str) -> SegmentedLibrary:
    """All documents in segments: two batches, the second of which replaces a part of the first, a removal, a batch of
    documents that come back, and a merge of segments of like size."""
    rows = document_chunks(spark, folder).withColumn("slug", F.concat(F.lit("d"), F.col("chunk_id").cast("string")))
    d = F.col("chunk_id")
    half = F.left("text", F.floor(F.length("text") / 2).cast("int"))
    library = SegmentedLibrary.create(spark, fresh_table_path(spark, "library"))
    first = rows.where(d % 3 != 0)
    library = library.append(index_tables(first))
    second = rows.where((d % 3 == 0) | (d % 5 == 0)).withColumn("text", F.when(d % 5 == 0, half).otherwise(F.col("text")))
    library = library.append(index_tables(second), second.select("slug"))
    library = library.delete(rows.where(d % 7 == 0).select("slug"))
    back = rows.where(d % 14 == 0)
    return library.append(index_tables(back), back.select("slug")).merged(2)


@register(
    "segmented_index_topk",
    f"WITH {FINAL}, {Q}, {sq.index_ctes()}, {sq.score_ctes('q', 's')}, {sq.padded_ctes('q', 's', 'r', K)} {RESULT} r",
)
def segmented_index_topk(spark, folder):
    """BM25 over a library that grew, lost documents and was merged, as over an index built anew."""
    return lexical.bm25_topk(benchmark_queries(spark, folder), grown_library(spark, folder).index(), K)


@register(
    "segmented_vocab_df",
    f"WITH {FINAL}, {sq.index_ctes()} SELECT term, df, round(idf, 9) AS idf FROM idf",
)
def segmented_vocab_df(spark, folder):
    """Statistics of that library, merged from its segments and delete files."""
    return grown_library(spark, folder).index().term_stats.select("term", "df", F.round("idf", 9).alias("idf"))


@register(
    "blockmax_topk",
    f"WITH {Q}, {sq.index_ctes()}, {sq.score_ctes('q', 's')}, {sq.padded_ctes('q', 's', 'r', K)} {RESULT} r",
)
def blockmax_topk(spark, folder):
    """The same lists as the full search; blocks of chunks that cannot reach them are not scored."""
    blocks = blockmax.blocked(document_index(spark, folder))
    return blockmax.blockmax_topk(benchmark_queries(spark, folder), blocks, K)


@register(
    "bm25_topk_by_source",
    f"""WITH {Q}, {sq.index_ctes()}, {sq.score_ctes('q', 's')}
SELECT qid, source AS slug, rank, doc_id AS chunk_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 3""",
)
def bm25_topk_by_source(spark, folder):
    best = lexical.bm25_best(benchmark_queries(spark, folder), document_index(spark, folder), 3, by_slug=True)
    return best.select("qid", "slug", "rank", "chunk_id", "score")


@register(
    "bm25_topk_one_slug",
    f"""WITH q AS (SELECT item_id AS qid, text AS query, 'src' || (item_id % 20) AS slug FROM benchmark),
{sq.index_ctes()}, {sq.score_ctes('q', 's')}
SELECT qid, rank, chunk_id, score FROM (
  SELECT qid, doc_id AS chunk_id, coalesce(score, 0.0) AS score,
         row_number() OVER (PARTITION BY qid ORDER BY coalesce(score, 0.0) DESC, doc_id) AS rank
  FROM (SELECT qid, doc_id FROM q JOIN documents ON source = slug) LEFT JOIN s USING (qid, doc_id)) WHERE rank <= {K}""",
)
def bm25_topk_one_slug(spark, folder):
    slug = F.concat(F.lit("src"), (F.col("qid") % 20).cast("string"))
    queries = benchmark_queries(spark, folder).withColumn("slug", slug)
    return lexical.bm25_topk(queries, document_index(spark, folder), K)


LONGEST_SQL = f"list_sort(list_transform({sq.words('text')}, lambda w: {{'n': -length(w), 'w': w}}))[1].w"


@register(
    "bm25_topk_padded",
    f"""WITH q AS (SELECT item_id AS qid, {LONGEST_SQL} AS query FROM benchmark),
{sq.index_ctes()}, {sq.score_ctes('q', 's')}, {sq.padded_ctes('q', 's', 'r', K)} {RESULT} r""",
)
def bm25_topk_padded(spark, folder):
    longest = F.get(
        F.sort_array(F.transform(tx.words(F.col("query")), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))),
        F.lit(0),
    )["w"]
    queries = benchmark_queries(spark, folder).withColumn("query", longest)
    return lexical.bm25_topk(queries, document_index(spark, folder), K)


@register("keyword_scan", "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'tion') ORDER BY doc_id LIMIT 5")
def keyword_scan(spark, folder):
    docs = table(spark, folder, "documents")
    return lexical.keyword_scan(docs, "tion", 5, "doc_id").select("doc_id", "source")


@register(
    "query_preprocess",
    f"""SELECT conv_id, turn, {sq.preprocessed('text')} AS processed,
CASE WHEN contains(text, '?') THEN 0.5 WHEN n <= 3 THEN 0.8 WHEN n <= 8 THEN 0.7 ELSE 0.6 END::DOUBLE AS alpha,
(contains(l, 'compare') OR contains(l, 'contrast') OR contains(l, 'versus') OR contains(l, 'vs.') OR contains(l, 'vs ')
 OR contains(l, 'differ') OR (contains(l, 'between') AND contains(l, ' and '))) AS complex
FROM (SELECT *, lower(text) AS l, len(regexp_extract_all(text, '{sq.NO_SPACE}+')) AS n FROM conversations)""",
)
def query_preprocess(spark, folder):
    text = F.col("text")
    return table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        tx.preprocess_query(text).alias("processed"),
        tx.dynamic_alpha(text).alias("alpha"),
        tx.is_comparison(text).alias("complex"),
    )


# ---------------------------------------------------------------- vectors

COSINE_SQL = """SELECT qid, rank, chunk_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT a.vec_id AS qid, b.vec_id AS chunk_id,
           round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)), 6) AS score
    FROM v a, v b WHERE a.vec_id <> b.vec_id {and_})) WHERE rank <= 7"""
V = "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) "


def _points(spark: SparkSession, folder: str, *extra) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "embeddings").withColumn("group_key", F.col("label").cast("string"))
    columns = [*extra, F.col("embedding").alias("vector")]
    return rows.select(F.col("vec_id").alias("qid"), *columns), rows.select(F.col("vec_id").alias("chunk_id"), *columns)


@register("cosine_topk", V + COSINE_SQL.format(and_=""))
def cosine_topk(spark, folder):
    return vectors.cosine_topk(*_points(spark, folder), k=K, skip_self=True)


@register("cosine_topk_cells", V + COSINE_SQL.format(and_=""))
def cosine_topk_cells(spark, folder):
    queries, points = _points(spark, folder)
    return cells.cells_topk(queries, cells.celled(points), k=K, skip_self=True)


@register("cosine_topk_same_label", V + COSINE_SQL.format(and_="AND a.label = b.label"))
def cosine_topk_same_label(spark, folder):
    return vectors.cosine_topk(*_points(spark, folder, "group_key"), k=K, skip_self=True)


@register(
    "points_by_ids",
    "SELECT l.doc_id AS vec_id, l.quality, e.label, round(CAST(e.embedding[1] AS double), 6) AS first FROM labels l JOIN embeddings e ON e.vec_id = l.doc_id",
)
def points_by_ids(spark, folder):
    """Stored vectors of the labelled documents' numbers; those without a vector disappear."""
    store = write_points(table(spark, folder, "embeddings"), fresh_table_path(spark, "points"), "vec_id")
    ids = table(spark, folder, "labels").select(F.col("doc_id").alias("vec_id"), "quality")
    return store.by_ids(ids).select("vec_id", "quality", "label", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


@register(
    "scroll_pages",
    """SELECT row // 100 AS page, min(vec_id) AS first_id, max(vec_id) AS last_id, count(*) AS n
FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS row FROM embeddings WHERE label % 2 = 0) GROUP BY 1""",
)
def scroll_pages(spark, folder):
    """Pages of 100 of a filtered scan in the order of identifiers."""
    return page_bounds(table(spark, folder, "embeddings").where(F.col("label") % 2 == 0), "vec_id")


@register(
    "latest_points",
    """SELECT label AS chunk_id, max(vec_id) AS version, 
round(list_sum(list_transform(arg_max(embedding, vec_id), lambda x, i: x::DOUBLE * i)), 6) AS digest
FROM embeddings GROUP BY label""",
)
def latest_points(spark, folder):
    points = table(spark, folder, "embeddings").select(F.col("label").alias("chunk_id"), F.col("vec_id").alias("version"), "embedding")
    latest = vectors.latest_points(points, "version")
    weighted = F.transform("embedding", lambda x, i: x.cast("double") * (i + 1))
    total = F.aggregate(weighted, F.lit(0.0), lambda done, x: done + x)
    return latest.select("chunk_id", "version", F.round(total, 6).alias("digest"))


@register(
    "point_id",
    """SELECT doc_id, (('0x' || substr(md5(source || '_' || doc_id), 1, 16))::UBIGINT % 1000000000)::BIGINT AS point
FROM documents""",
)
def point_id(spark, folder):
    key = F.concat_ws("_", "source", F.col("doc_id").cast("string"))
    return table(spark, folder, "documents").select("doc_id", tx.point_id(key).alias("point"))


@register(
    "text_embedding",
    f"""WITH {sq.index_ctes()},
d AS (SELECT doc_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS b, sum(tf)::DOUBLE AS v FROM post GROUP BY ALL)
SELECT doc_id, b AS dimension, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS value FROM d""",
)
def text_embedding(spark, folder):
    embedded = HashingEmbedder().embed(table(spark, folder, "documents").select("doc_id", "text"), "text")
    rows = embedded.select("doc_id", F.posexplode_outer("vector").alias("dimension", "value"))
    return rows.where(F.col("value") != 0).select(
        "doc_id", F.col("dimension").cast("long").alias("dimension"), F.round("value", 6).alias("value")
    )


# ---------------------------------------------------------------- fusion

BASE_CTES = f"WITH {Q}, {PROCESSED}, {sq.index_ctes()}"


def hybrid_sql(query_table: str, depth: int, prefix: str = "") -> str:
    """CTEs of the keyword list and the vector list, both ``depth`` long."""
    x = prefix
    return (
        f"{sq.score_ctes(query_table, x + 's')}, {sq.padded_ctes(query_table, x + 's', x + 'kw', depth)}, "
        f"{sq.hashed_ctes('q', x + 'vec', depth)}"
    )


ALPHA_SQL = f"""CASE WHEN contains(query, '?') THEN 0.5
  WHEN len(regexp_extract_all(query, '{sq.NO_SPACE}+')) <= 3 THEN 0.8
  WHEN len(regexp_extract_all(query, '{sq.NO_SPACE}+')) <= 8 THEN 0.7 ELSE 0.6 END"""


def candidate_lists(spark: SparkSession, folder: str, depth: int) -> tuple[DataFrame, DataFrame]:
    library = document_library(spark, folder)
    queries = benchmark_queries(spark, folder)
    return lexical.bm25_topk(queries, library.index, depth), search.vector_search(queries, library, depth)


@register(
    "rrf_fusion",
    f"{BASE_CTES}, {hybrid_sql('q', 14)}, {sq.fused_ctes('kw', 'vec', 'f', '1.0 / (60 + rank)', '1.0 / (60 + rank)', K)} {RESULT} f",
)
def rrf_fusion(spark, folder):
    return fusion.rrf_fusion(*candidate_lists(spark, folder, 2 * K), k=K)


@register(
    "weighted_fusion",
    f"{BASE_CTES}, {hybrid_sql('q', 14)}, {sq.fused_ctes('kw', 'vec', 'f', '0.7 / rank', '0.3 / rank', K)} {RESULT} f",
)
def weighted_fusion(spark, folder):
    return search.baseline_search(benchmark_queries(spark, folder), document_library(spark, folder), K)


@register(
    "adaptive_fusion",
    f"{BASE_CTES}, {hybrid_sql('p', 21)}, {sq.fused_ctes('kw', 'vec', 'f', '0.7 / rank', '0.3 / rank', K)} {RESULT} f",
)
def adaptive_fusion(spark, folder):
    return search.hybrid_search(benchmark_queries(spark, folder), document_library(spark, folder), K)


@register(
    "dynamic_alpha_fusion",
    f"""{BASE_CTES}, {hybrid_sql('p', 21)}, al AS (SELECT qid, {ALPHA_SQL} AS alpha FROM q),
kwa AS (SELECT * FROM kw JOIN al USING (qid)), veca AS (SELECT * FROM vec JOIN al USING (qid)),
{sq.fused_ctes('kwa', 'veca', 'f', 'alpha / rank', '(1 - alpha) / rank', K)} {RESULT} f""",
)
def dynamic_alpha_fusion(spark, folder):
    return search.hybrid_search(benchmark_queries(spark, folder), document_library(spark, folder), K, dynamic=True)


@register("vector_only_search", f"{BASE_CTES}, {sq.hashed_ctes('q', 'vec', K)} {RESULT} vec")
def vector_only_search(spark, folder):
    library = document_library(spark, folder)
    without_keywords = search.Library(library.chunks, library.vectors, None, library.embedder)
    return search.hybrid_search(benchmark_queries(spark, folder), without_keywords, K)


# ---------------------------------------------------------------- evaluation

GOLD_CTE = """gold AS (SELECT item_id AS qid, min(doc_id) AS gold_id FROM benchmark b
  JOIN documents d ON contains(d.text, b.text) GROUP BY item_id)"""
METRICS_SQL = """round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate_at_5,
round(avg(CASE WHEN rank <= 5 THEN 1.0 / rank ELSE 0.0 END), 6) AS mrr_at_5,
round(avg(CASE WHEN rank <= 7 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate_at_7,
round(avg(CASE WHEN rank <= 7 THEN 1.0 / rank ELSE 0.0 END), 6) AS mrr_at_7, count(*) AS total_queries"""
RANKS_CTE = "ranks AS (SELECT qid, gold_id, rank FROM gold LEFT JOIN f ON f.qid = gold.qid AND f.chunk_id = gold.gold_id)"
RANKS_CTE = RANKS_CTE.replace("SELECT qid,", "SELECT gold.qid,")
ADAPTIVE_CTES = f"{BASE_CTES}, {hybrid_sql('p', 21)}, {sq.fused_ctes('kw', 'vec', 'f', '0.7 / rank', '0.3 / rank', K)}, {GOLD_CTE}, {RANKS_CTE}"


def golden(spark: SparkSession, folder: str) -> DataFrame:
    passages = table(spark, folder, "benchmark").select(F.col("item_id").alias("passage_id"), F.col("text").alias("passage"))
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return ev.golden_from_passages(passages, texts).withColumnRenamed("passage_id", "qid")


def adaptive_ranks(spark: SparkSession, folder: str) -> DataFrame:
    return ev.gold_ranks(golden(spark, folder), adaptive_fusion(spark, folder))


@register(
    "passages_in_documents",
    "SELECT item_id AS passage_id, doc_id AS text_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
)
def passages_in_documents(spark, folder):
    passages = table(spark, folder, "benchmark").select(F.col("item_id").alias("passage_id"), F.col("text").alias("passage"))
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return ev.passages_in_texts(passages, texts)


@register("hit_mrr_at_k", f"{ADAPTIVE_CTES} SELECT {METRICS_SQL} FROM ranks")
def hit_mrr_at_k(spark, folder):
    return ev.evaluate(adaptive_ranks(spark, folder))


@register(
    "hit_mrr_by_source",
    f"""{ADAPTIVE_CTES} SELECT coalesce(source, 'ALL') AS source, {METRICS_SQL}
FROM ranks JOIN documents ON doc_id = gold_id GROUP BY ROLLUP (source)""",
)
def hit_mrr_by_source(spark, folder):
    sources = table(spark, folder, "documents").select(F.col("doc_id").alias("gold_id"), "source")
    return ev.evaluate_by(adaptive_ranks(spark, folder).join(sources, "gold_id"), "source")


@register("gold_misses", f"{ADAPTIVE_CTES} SELECT qid, gold_id FROM ranks WHERE rank IS NULL OR rank > 1")
def gold_misses(spark, folder):
    return ev.misses(adaptive_ranks(spark, folder), 1).select("qid", "gold_id")


def _tall(source: str) -> str:
    return f"SELECT unnest(['hit_rate_at_5', 'mrr_at_5', 'hit_rate_at_7', 'mrr_at_7']) AS metric, unnest([hit_rate_at_5, mrr_at_5, hit_rate_at_7, mrr_at_7]) AS v FROM {source}"


@register(
    "search_improvement",
    f"""{BASE_CTES}, {hybrid_sql('q', 14, 'b')}, {sq.fused_ctes('bkw', 'bvec', 'bf', '0.7 / rank', '0.3 / rank', K)},
{hybrid_sql('p', 21)}, {sq.fused_ctes('kw', 'vec', 'f', '0.7 / rank', '0.3 / rank', K)}, {GOLD_CTE}, {RANKS_CTE},
branks AS (SELECT gold.qid, rank FROM gold LEFT JOIN bf ON bf.qid = gold.qid AND bf.chunk_id = gold.gold_id),
a AS (SELECT {METRICS_SQL} FROM ranks), b AS (SELECT {METRICS_SQL} FROM branks),
ta AS ({_tall('a')}), tb AS ({_tall('b')})
SELECT metric, tb.v AS baseline, ta.v AS adaptive, round((ta.v - tb.v) / nullif(tb.v, 0) * 100, 6) AS change_percent
FROM ta JOIN tb USING (metric)""",
)
def search_improvement(spark, folder):
    gold = cut_lineage(golden(spark, folder), "gold")
    queries, library = benchmark_queries(spark, folder), document_library(spark, folder)
    base = ev.evaluate(ev.gold_ranks(gold, search.baseline_search(queries, library, K)))
    return ev.improvement(base, ev.evaluate(ev.gold_ranks(gold, search.hybrid_search(queries, library, K))))


# rows of one source have no source: a null group is a group like others
NUMBERED_SQL = "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS p, count(*) OVER (PARTITION BY source) AS n FROM (SELECT doc_id, nullif(source, 'src3') AS source FROM documents)"


def _by_source(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.nullif("source", F.lit("src3")).alias("source"))



@register(
    "every_nth_sample",
    f"""SELECT doc_id, source FROM ({NUMBERED_SQL}) WHERE p > 3 AND
(n - 3 <= 4 OR ((p - 4) % ((n - 3) // 4) = 0 AND (p - 4) // ((n - 3) // 4) < 4))""",
)
def every_nth_sample(spark, folder):
    return ev.sample_evenly(_by_source(spark, folder), "source", "doc_id", size=4, skip_first=3).select("doc_id", "source")


@register("skip_preface", f"SELECT doc_id, source FROM ({NUMBERED_SQL}) WHERE p > 5")
def skip_preface(spark, folder):
    return ev.sample_evenly(_by_source(spark, folder), "source", "doc_id", size=2**40, skip_first=5).select("doc_id", "source")


SEEDS_SQL = f"""seeds AS (SELECT doc_id, source, term AS query FROM (
  SELECT doc_id, source, term, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, term) AS r FROM (
    SELECT doc_id, source, term, count(*) AS c FROM (SELECT doc_id, source, unnest({sq.words('text')}) AS term FROM documents)
    WHERE length(term) > 4 GROUP BY ALL)) WHERE r <= 5)"""


def seeded(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return unfolded_values(docs, ev.query_seeds(F.col("text")), "query", "doc_id", "source")


@register("generated_queries", f"WITH {SEEDS_SQL} SELECT doc_id, query FROM seeds")
def generated_queries(spark, folder):
    return seeded(spark, folder).select("doc_id", "query")


@register(
    "golden_stats",
    f"""WITH {SEEDS_SQL} SELECT sum(c)::BIGINT AS total_queries, count(*) AS chunks, round(avg(c), 6) AS avg_per_chunk
FROM (SELECT doc_id, count(*) AS c FROM seeds GROUP BY doc_id)""",
)
def golden_stats(spark, folder):
    return ev.golden_stats(seeded(spark, folder).withColumnRenamed("doc_id", "gold_id"))


@register("queries_per_slug", f"WITH {SEEDS_SQL} SELECT source AS slug, count(*) AS queries FROM seeds GROUP BY source")
def queries_per_slug(spark, folder):
    from shelfmine.operators.telemetry import queries_per_slug as per_slug

    return per_slug(seeded(spark, folder).withColumnRenamed("source", "slug"))


@register("golden_rows", f"WITH {SEEDS_SQL} SELECT doc_id::VARCHAR AS gold_id, query FROM seeds")
def golden_rows(spark, folder):
    from shelfmine.sources.readers import golden_lines
    from shelfmine.sources.readers import golden_rows as parse

    chunks = seeded(spark, folder).select(F.col("doc_id").cast("string").alias("gold_id"), "query")
    return parse(golden_lines(chunks))
