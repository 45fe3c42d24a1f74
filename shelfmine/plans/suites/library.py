"""Catalogue maintenance, index maintenance, cited passages and model-backed steps over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmine.functions import text as tx
from shelfmine.operators import catalog, lexical, models
from shelfmine.plans import search
from shelfmine.plans import sqltext as sq
from shelfmine.plans.registry import register, table
from shelfmine.plans.suites.parsing import md5
from shelfmine.plans.suites.retrieval import (
    BASE_CTES,
    K,
    benchmark_queries,
    document_index,
    document_library,
    hybrid_sql,
)
from shelfmine.session import cut_lineage
from shelfmine.sources import index_store

LF = sq.LF


def books(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a catalogue row."""
    d = F.col("doc_id")
    kinds = F.array(*[F.lit(t) for t in ("book", "script", "conversation", "tech_doc", "report")])
    return table(spark, folder, "documents").select(
        (d + 1).alias("book_id"),
        F.concat(F.lit("d"), d.cast("string")).alias("slug"),
        F.left(F.split("text", "\n", -1)[0], F.lit(60)).alias("title"),
        F.when(F.col("lang") == "en", F.lit("Ann")).when(F.col("lang") == "fr", F.lit("")).alias("author"),
        F.when(d % 9 != 0, F.floor(F.col("n_chars") / 400).cast("int")).alias("num_chunks"),
        F.col("n_chars").alias("num_chars"),
        F.get(kinds, (d % 5).cast("int")).alias("doc_type"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id * 37 as int), 0)").alias("added_at"),
    )


BOOKS = f"""books AS (SELECT doc_id + 1 AS book_id, 'd' || doc_id AS slug, left(string_split(text, {LF})[1], 60) AS title,
CASE lang WHEN 'en' THEN 'Ann' WHEN 'fr' THEN '' END AS author, CASE WHEN doc_id % 9 <> 0 THEN n_chars // 400 END AS num_chunks,
n_chars AS num_chars, ['book', 'script', 'conversation', 'tech_doc', 'report'][doc_id % 5 + 1] AS doc_type,
TIMESTAMP '2024-01-01' + to_minutes(doc_id * 37) AS added_at FROM documents)"""


@register(
    "library_listing",
    f"""WITH {BOOKS} SELECT slug, title, coalesce(nullif(author, ''), 'Unknown') AS author, coalesce(num_chunks, 0) AS num_chunks,
strftime(added_at, '%Y-%m-%d %H:%M') AS added_at FROM books""",
)
def library_listing(spark, folder):
    return catalog.library(books(spark, folder)).withColumn("num_chunks", F.col("num_chunks").cast("long"))


@register(
    "agent_catalog",
    f"""WITH {BOOKS} SELECT slug, lower(title) AS title_key, doc_type,
'- [' || slug || '] ' || title || coalesce(' by ' || nullif(author, ''), '') AS line FROM books""",
)
def agent_catalog(spark, folder):
    return catalog.agent_lines(books(spark, folder))


IDENTIFIER_SQL = "CASE doc_id % 4 WHEN 0 THEN slug WHEN 1 THEN upper(replace(title, 'ß', '')) WHEN 2 THEN (doc_id * CASE WHEN doc_id % 8 = 2 THEN 1 ELSE 1000000 END)::VARCHAR ELSE '99999999999999999999' || doc_id END"


@register(
    "resolve_identifier",
    f"""WITH {BOOKS}, named AS (SELECT * REPLACE (CASE WHEN book_id % 10 = 0 THEN (book_id + 7)::VARCHAR ELSE title END AS title) FROM books),
ids AS (SELECT {IDENTIFIER_SQL} AS identifier FROM labels JOIN named ON slug = 'd' || doc_id),
t AS (SELECT lower(title) AS k, min(book_id) AS id FROM named GROUP BY 1)
SELECT identifier, coalesce(b.book_id, t.id, n.book_id) AS book_id
FROM ids LEFT JOIN named b ON b.slug = identifier LEFT JOIN t ON t.k = lower(identifier)
LEFT JOIN named n ON n.book_id = CASE WHEN regexp_matches(identifier, '^[0-9]+$') THEN try_cast(identifier AS BIGINT) END""",
)
def resolve_identifier(spark, folder):
    d = F.col("doc_id")
    b = F.col("book_id")
    # titles made of digits, and numbers that no document has or that exceed 64 bits
    own = books(spark, folder).withColumn("title", F.when(b % 10 == 0, (b + 7).cast("string")).otherwise(F.col("title")))
    labelled = table(spark, folder, "labels").withColumn("slug", F.concat(F.lit("d"), d.cast("string"))).join(own, "slug")
    identifier = (
        F.when(d % 4 == 0, F.col("slug"))
        .when(d % 4 == 1, F.upper(F.replace("title", F.lit("ß"), F.lit(""))))
        .when(d % 4 == 2, (d * F.when(d % 8 == 2, F.lit(1)).otherwise(F.lit(1000000))).cast("string"))
        .otherwise(F.concat(F.lit("99999999999999999999"), d.cast("string")))
    )
    return catalog.resolve(labelled.select(identifier.alias("identifier")), own)


INCOMING = """inc AS (SELECT 10000000 + doc_id AS book_id, CASE WHEN quality = 1 THEN 'd' ELSE 'n' END || doc_id AS slug, 'Label ' || toxic AS title,
TIMESTAMP '2025-01-01' AS added_at FROM labels)"""


def incoming(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").select(
        (F.lit(10000000) + F.col("doc_id")).alias("book_id"),
        F.concat(F.when(F.col("quality") == 1, F.lit("d")).otherwise(F.lit("n")), F.col("doc_id").cast("string")).alias("slug"),
        F.concat(F.lit("Label "), F.col("toxic").cast("string")).alias("title"),
        F.lit("").alias("author"),
        F.lit(0).alias("num_chunks"),
        F.lit(0).cast("long").alias("num_chars"),
        F.lit("book").alias("doc_type"),
        F.expr("timestamp_ntz'2025-01-01 00:00:00'").alias("added_at"),
    )


@register(
    "doc_upsert",
    f"""WITH {BOOKS}, {INCOMING} SELECT coalesce(b.book_id, i.book_id) AS book_id, coalesce(i.slug, b.slug) AS slug,
coalesce(i.title, b.title) AS title, coalesce(b.added_at, i.added_at) AS added_at FROM books b FULL JOIN inc i ON i.slug = b.slug""",
)
def doc_upsert(spark, folder):
    """The batch holds an older row of every slug as well, which the newer one replaces."""
    batch = incoming(spark, folder)
    older = batch.withColumns({"title": F.lit("older"), "added_at": F.expr("added_at - interval 1 day")})
    merged = catalog.upsert_documents(books(spark, folder), batch.unionByName(older))
    return merged.select("book_id", "slug", "title", "added_at")


SUMMARIES = f"""sums AS (SELECT doc_id + 1 AS book_id, c::INT AS chapter_id, left(text, 20) || c AS summary FROM documents, range(1, 4) r(c))"""


def summaries(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("chapter_id"))
    return rows.select(
        (F.col("doc_id") + 1).alias("book_id"), "chapter_id",
        F.concat(F.left("text", F.lit(20)), F.col("chapter_id").cast("string")).alias("summary"),
    )


@register(
    "summary_upsert",
    f"""WITH {SUMMARIES}, inc AS (
  SELECT doc_id + 1 AS book_id, 2 + quality AS chapter_id, CASE max(toxic) WHEN 1 THEN 'newest' ELSE 'new' END AS summary
  FROM labels GROUP BY ALL)
SELECT book_id, chapter_id, coalesce(i.summary, s.summary) AS summary FROM sums s FULL JOIN inc i USING (book_id, chapter_id)""",
)
def summary_upsert(spark, folder):
    fresh = table(spark, folder, "labels").select(
        (F.col("doc_id") + 1).alias("book_id"),
        (F.col("quality") + 2).alias("chapter_id"),
        # a toxic document has two rows in the batch, and keeps the last
        F.explode(F.when(F.col("toxic") == 1, F.array(F.lit("newest"), F.lit("new"))).otherwise(F.array(F.lit("new")))).alias("summary"),
    )
    return catalog.upsert_summaries(summaries(spark, folder), fresh, ("book_id", "chapter_id"))


@register(
    "cascade_delete",
    f"""WITH {SUMMARIES}, gone AS (SELECT doc_id + 1 AS book_id FROM labels WHERE toxic = 1)
SELECT book_id, count(*) AS sections FROM sums WHERE book_id NOT IN (SELECT book_id FROM gone) GROUP BY book_id""",
)
def cascade_delete(spark, folder):
    gone = table(spark, folder, "labels").where(F.col("toxic") == 1).select((F.col("doc_id") + 1).alias("book_id"))
    kept, sections = catalog.delete_documents(gone, books(spark, folder), summaries(spark, folder))
    return kept.select("book_id").join(sections, "book_id").groupBy("book_id").agg(F.count(F.lit(1)).alias("sections"))


@register(
    "documents_with_summaries",
    f"WITH {BOOKS} SELECT slug FROM books WHERE book_id IN (SELECT doc_id + 1 FROM labels)",
)
def documents_with_summaries(spark, folder):
    known = table(spark, folder, "labels").select((F.col("doc_id") + 1).alias("book_id"))
    return catalog.has_summaries(books(spark, folder), known).select("slug")


@register(
    "not_yet_summarised",
    f"WITH {BOOKS} SELECT slug FROM books WHERE book_id NOT IN (SELECT doc_id + 1 FROM labels)",
)
def not_yet_summarised(spark, folder):
    from dataclasses import replace

    from shelfmine.plans import ingest

    known = table(spark, folder, "labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("slug"))
    stores = replace(ingest.empty_stores(spark), document_summaries=known.withColumn("summary", F.lit("x")))
    return ingest.not_yet_summarised(books(spark, folder), stores).select("slug")


CANDIDATE_SQL = "CASE doc_id % 5 WHEN 0 THEN ' D' || (doc_id + 1) || ' ' WHEN 1 THEN left(text, 12) WHEN 2 THEN 'x' WHEN 3 THEN 'fresh_' || doc_id ELSE '' END"


@register(
    "slug_check",
    f"""WITH {BOOKS}, c AS (SELECT {CANDIDATE_SQL} AS given FROM documents), s AS (SELECT given, lower(trim(given)) AS slug FROM c)
SELECT given, CASE WHEN s.slug = '' THEN 'no slug given'
WHEN NOT regexp_matches(s.slug, '^[a-z0-9_-]+$') THEN 'a slug has only the characters a-z, 0-9, _ and -'
WHEN length(s.slug) NOT BETWEEN 2 AND 20 THEN 'a slug has 2 to 20 characters'
WHEN b.slug IS NOT NULL THEN 'another document has the slug ' || s.slug ELSE '' END AS message
FROM s LEFT JOIN books b USING (slug)""",
)
def slug_check(spark, folder):
    d = F.col("doc_id")
    candidate = (
        F.when(d % 5 == 0, F.concat(F.lit(" D"), (d + 1).cast("string"), F.lit(" ")))
        .when(d % 5 == 1, F.left("text", F.lit(12)))
        .when(d % 5 == 2, F.lit("x"))
        .when(d % 5 == 3, F.concat(F.lit("fresh_"), d.cast("string")))
        .otherwise(F.lit(""))
    )
    return catalog.slug_check(table(spark, folder, "documents").select(candidate.alias("slug")), books(spark, folder))


@register(
    "title_injection",
    f"""WITH {BOOKS} SELECT conv_id, turn, CASE WHEN title IS NOT NULL AND NOT contains(lower(text), lower(title))
THEN text || ' (for the document ''' || title || ''')' ELSE text END AS message
FROM (SELECT *, CASE WHEN turn % 3 = 0 THEN 'none' ELSE 'd' || conv_id END AS slug FROM conversations) LEFT JOIN books USING (slug)""",
)
def title_injection(spark, folder):
    slug = F.when(F.col("turn") % 3 == 0, F.lit("none")).otherwise(F.concat(F.lit("d"), F.col("conv_id").cast("string")))
    messages = table(spark, folder, "conversations").withColumn("slug", slug).withColumnRenamed("text", "message")
    return catalog.with_title(messages, books(spark, folder)).select("conv_id", "turn", "message")


@register(
    "result_limits",
    f"""WITH {BOOKS} SELECT slug, CASE WHEN doc_type = 'conversation' THEN 15 ELSE 5 END AS one,
CASE WHEN doc_type = 'conversation' THEN 8 ELSE 3 END AS several FROM books""",
)
def result_limits(spark, folder):
    kind = F.col("doc_type")
    return books(spark, folder).select(
        "slug", catalog.result_limit(kind).alias("one"), catalog.result_limit(kind, several=True).alias("several")
    )


# ---------------------------------------------------------------- index maintenance


@register(
    "index_without_slug",
    f"""WITH {sq.index_ctes()}, kept AS (SELECT doc_id FROM lens WHERE source NOT IN ('src3', 'src13')),
p AS (SELECT term, count(*) AS df FROM post JOIN kept USING (doc_id) GROUP BY term), n AS (SELECT count(*) AS n FROM kept)
SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM p, n""",
)
def index_without_slug(spark, folder):
    gone = table(spark, folder, "documents").where(F.col("source").isin("src3", "src13")).select(F.col("source").alias("slug"))
    kept = index_store.index_without(document_index(spark, folder), gone)
    return lexical.term_stats(kept).select("term", "df", F.round("idf", 6).alias("idf"))


@register(
    "index_replace_slug",
    f"""WITH {sq.index_ctes()}, inc AS (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
SELECT doc_id AS chunk_id, dl FROM lens WHERE source NOT IN (SELECT source FROM inc)
UNION ALL SELECT 1000000 + doc_id, len({sq.terms('upper(text)')}) FROM documents JOIN labels USING (doc_id) WHERE toxic = 1""",
)
def index_replace_slug(spark, folder):
    toxic = table(spark, folder, "labels").where(F.col("toxic") == 1).select("doc_id")
    fresh = table(spark, folder, "documents").join(toxic, "doc_id").select(
        (F.col("doc_id") + 1000000).alias("chunk_id"), F.col("source").alias("slug"), F.upper("text").alias("text")
    )
    replaced = index_store.index_replacing(document_index(spark, folder), fresh)
    return replaced.lengths.select("chunk_id", F.col("dl").cast("long").alias("dl"))


# ---------------------------------------------------------------- passages


def request_sql(depth: str, limit: str) -> str:
    """Hybrid search of req(qid, query, slug, lim) within the slug, pools three times the limit."""
    bucket = "('0x' || substr(md5(term), 1, 8))::BIGINT % 64"
    return f"""{sq.index_ctes()}, rp AS (SELECT qid, {sq.preprocessed('query')} AS query FROM req),
{sq.score_ctes('rp', 's')},
cand AS (SELECT r.qid, r.lim, d.doc_id FROM req r JOIN documents d ON d.source = r.slug),
kw AS (SELECT * FROM (SELECT qid, lim, doc_id AS chunk_id, row_number() OVER (PARTITION BY qid ORDER BY coalesce(score, 0.0) DESC, doc_id) AS rank
  FROM cand LEFT JOIN s USING (qid, doc_id)) WHERE rank <= 3 * lim),
dv AS (SELECT doc_id, {bucket} AS b, sum(tf)::DOUBLE AS v FROM post GROUP BY ALL),
dn AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM dv GROUP BY doc_id),
qv AS (SELECT qid, {bucket} AS b, count(*)::DOUBLE AS v FROM (SELECT qid, unnest({sq.terms('query')}) AS term FROM req) GROUP BY ALL),
qn AS (SELECT qid, sqrt(sum(v * v)) AS norm FROM qv GROUP BY qid),
dots AS (SELECT qv.qid, dv.doc_id, sum(qv.v * dv.v) AS dot FROM qv JOIN dv USING (b) GROUP BY ALL),
vec AS (SELECT * FROM (SELECT qid, lim, doc_id AS chunk_id, row_number() OVER (PARTITION BY qid
  ORDER BY round(coalesce(dot / qn.norm / dn.norm, 0), 6) DESC, doc_id) AS rank
  FROM cand LEFT JOIN dots USING (qid, doc_id) LEFT JOIN qn USING (qid) LEFT JOIN dn USING (doc_id)) WHERE rank <= 3 * lim),
f AS (SELECT * FROM (SELECT qid, lim, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first) AS rank FROM (
  SELECT qid, lim, chunk_id, round(sum(w), 6) AS score, min(src * 1000000 + rank) AS first FROM (
    SELECT *, 0 AS src, 0.7 / rank AS w FROM kw UNION ALL SELECT *, 1 AS src, 0.3 / rank AS w FROM vec) GROUP BY ALL)) WHERE rank <= lim)"""


SLUGS_SQL = "['src' || (item_id % 20), 'src' || ((item_id + 7) % 20), 'src' || ((item_id + 12) % 20)]"


@register(
    "search_several",
    f"""WITH req0 AS (SELECT item_id, text AS query, unnest({SLUGS_SQL}) AS slug FROM benchmark),
req AS (SELECT item_id || '|' || slug AS qid, item_id, query, slug, CASE WHEN substr(slug, 4)::INT % 2 = 0 THEN 8 ELSE 3 END AS lim FROM req0),
{request_sql('3 * lim', 'lim')}
SELECT item_id AS qid, slug, rank, chunk_id, score FROM f JOIN req USING (qid)""",
)
def search_several(spark, folder):
    """Every passage in three sources at once, with more results from the sources that are conversations."""
    item = F.col("qid")
    name = lambda n: F.concat(F.lit("src"), ((item + n) % 20).cast("string"))
    requests = benchmark_queries(spark, folder).withColumn("slug", F.explode(F.array(name(0), name(7), name(12))))
    sources = table(spark, folder, "documents").select(F.col("source").alias("slug")).distinct()
    even = F.substring("slug", 4, 10).cast("int") % 2 == 0
    kinds = sources.withColumn("doc_type", F.when(even, F.lit("conversation")).otherwise(F.lit("book")))
    found = search.search_documents(requests, document_library(spark, folder), kinds, several=True)
    return found.select("qid", "slug", "rank", "chunk_id", "score")


CITED_SQL = f"""'[' || CASE WHEN doc_id % 4 = 0 THEN 'Speakers: ' || lang || ', ' || source WHEN doc_id % 4 = 1 THEN 'Speaker: ' || source
WHEN length(head) > 0 AND length(head) < 50 THEN head ELSE 'Section ' || (doc_id % 7) END
|| CASE WHEN doc_id % 3 = 0 THEN ', Time: 10:' || lang ELSE '' END || ', Source: ' || doc_id || ']'"""


@register(
    "cited_passages",
    f"""{BASE_CTES}, {hybrid_sql('p', 21)}, {sq.fused_ctes('kw', 'vec', 'f', '0.7 / rank', '0.3 / rank', K)},
d AS (SELECT *, string_split(text, {LF})[1] AS head FROM documents)
SELECT qid, rank, {CITED_SQL} AS citation, md5(CASE WHEN length(text) > 800 THEN left(text, 800) || '...' ELSE text END) AS digest
FROM f JOIN d ON d.doc_id = f.chunk_id""",
)
def cited_passages(spark, folder):
    d = F.col("doc_id")
    details = table(spark, folder, "documents").select(
        d.alias("chunk_id"),
        "text",
        F.when(d % 4 == 0, F.array("lang", "source")).alias("speakers"),
        F.when(d % 4 == 1, F.col("source")).alias("speaker"),
        F.split("text", "\n", -1)[0].alias("heading"),
        (d % 7).alias("section"),
        F.when(d % 3 == 0, F.concat(F.lit("10:"), F.col("lang"))).alias("timestamp"),
    )
    found = search.hybrid_search(benchmark_queries(spark, folder), document_library(spark, folder), K)
    hits = search.cited(search.with_snippets(search.passages(found, details)))
    return hits.select("qid", "rank", "citation", md5("text").alias("digest"))


@register(
    "section_labels",
    """SELECT doc_id, coalesce(nullif(regexp_replace(lpad((doc_id % 12)::VARCHAR, 2, '0'), '^0+', ''), ''), '0') AS label FROM documents""",
)
def section_labels(spark, folder):
    identifier = tx.chunk_id(F.col("source"), F.col("doc_id") % 12, F.lit(1), F.col("text"))
    return table(spark, folder, "documents").select("doc_id", tx.section_label(identifier).alias("label"))


# ---------------------------------------------------------------- model-backed steps



@register(
    "judge_parse",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'EXCELLENT' WHEN 1 THEN 'POOR' ELSE 'NOT_JUDGED' END AS score,
CASE event_id % 4 WHEN 2 THEN 'Could not parse assessment JSON' WHEN 3 THEN '' ELSE event_type END AS reasoning FROM events""",
)
def judge_parse(spark, folder):
    kind = F.col("event_id") % 4
    answer = (
        F.when(kind == 0, F.concat(F.lit('{"score": "excellent", "reasoning": "'), F.col("event_type"), F.lit('"}')))
        .when(kind == 1, F.concat(F.lit('Sure! {"score": "POOR", "reasoning": "'), F.col("event_type"), F.lit('"} Done.')))
        .when(kind == 2, F.concat(F.lit("no json for "), F.col("event_type")))
        .otherwise(F.lit('{"score": "superb"}'))
    )
    rows = table(spark, folder, "events").select("event_id", models.parsed_assessment(answer).alias("a"))
    return rows.select("event_id", "a.score", "a.reasoning")


REPHRASED_SQL = f"array_to_string(list_sort(list_distinct({sq.kept_words('query')})), ' ')"


@register(
    "rephrase_and_retry",
    f"""WITH q AS (SELECT item_id AS qid, CASE item_id % 3 WHEN 0 THEN text WHEN 1 THEN 'zzqx' || item_id ELSE 'what about the zzqx' || item_id END AS query FROM benchmark),
{sq.index_ctes()}, {sq.score_ctes('q', 's0')}, n0 AS (SELECT qid, least(count(*), 7) AS n FROM s0 GROUP BY qid),
c AS (SELECT q.qid, coalesce(n, 0) AS n, query, {REPHRASED_SQL} AS other FROM q LEFT JOIN n0 ON n0.qid = q.qid),
r AS (SELECT qid, query AS original, n, n = 0 AND other <> '' AND other <> query AS again, other FROM c),
rq AS (SELECT qid, other AS query FROM r WHERE again),
{sq.score_ctes('rq', 's')}, sc AS (SELECT qid, least(count(*), 7) AS m FROM s GROUP BY qid)
SELECT r.qid, CASE WHEN again AND coalesce(m, 0) > 0 THEN m ELSE n END AS num_results, CASE WHEN again THEN other END AS rephrased_query,
again AS retry_attempted, CASE WHEN again THEN coalesce(m, 0) END AS retry_results,
(n = 0 AND NOT again) OR (again AND coalesce(m, 0) = 0) AS fallback_to_context FROM r LEFT JOIN sc ON sc.qid = r.qid""",
)
def rephrase_and_retry(spark, folder):
    item = F.col("qid")
    query = (
        F.when(item % 3 == 0, F.col("query"))
        .when(item % 3 == 1, F.concat(F.lit("zzqx"), item.cast("string")))
        .otherwise(F.concat(F.lit("what about the zzqx"), item.cast("string")))
    )
    queries = benchmark_queries(spark, folder).withColumn("query", query)
    # the terms of the chunks are written once for both searches
    index = lexical.index_of_tokens(cut_lineage(document_index(spark, folder).tokens, "tokens"))

    def counted(asked: DataFrame) -> DataFrame:
        found = lexical.bm25_topk(asked, index, K, pad=False)
        return found.groupBy("qid").agg(F.count(F.lit(1)).cast("int").alias("num_results"))

    first = counted(queries)
    again, record = search.retry_empty(queries, first)
    return search.retried(record, counted(again)).select(
        "qid", F.col("num_results").cast("long").alias("num_results"), "rephrased_query", "retry_attempted",
        F.col("retry_results").cast("long").alias("retry_results"), "fallback_to_context",
    )


@register(
    "result_count_parse",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id % 17 WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE -1 END AS n FROM events""",
)
def result_count_parse(spark, folder):
    e = F.col("event_id")
    text = (
        F.when(e % 4 == 0, F.concat(F.lit("Found "), (e % 17).cast("string"), F.lit(" results for x")))
        .when(e % 4 == 1, F.lit("No results found for x"))
        .when(e % 4 == 2, F.lit("There were 0 results"))
        .otherwise(F.col("event_type"))
    )
    return table(spark, folder, "events").select("event_id", tx.result_count(text).cast("long").alias("n"))


@register(
    "ungrounded_phrases",
    """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'likely|suggests that' WHEN turn % 3 = 1 THEN 'i couldn''t find' ELSE '' END AS phrases
FROM conversations""",
)
def ungrounded_phrases(spark, folder):
    turn = F.col("turn")
    text = F.concat(
        "text",
        F.when(turn % 3 == 0, F.lit(" This suggests that it is LIKELY."))
        .when(turn % 3 == 1, F.lit(" I couldn't find it."))
        .otherwise(F.lit("")),
    )
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", F.array_join(tx.ungrounded_phrases(text), "|").alias("phrases")
    )


@register(
    "token_cost",
    f"""SELECT conv_id, turn, round(len({sq.pieces('text')}) / 1000.0 * 1.5 * CASE role WHEN 'user' THEN 0.00015 WHEN 'assistant' THEN 0.03 ELSE 0.001 END, 9) AS cost
FROM conversations""",
)
def token_cost(spark, folder):
    role = F.col("role")
    model = F.when(role == "user", F.lit("gpt-4o-mini")).when(role == "assistant", F.lit("gpt-4")).otherwise(F.lit("other"))
    tokens = F.size(tx.pieces(F.col("text")))
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", F.round(tokens / F.lit(1000.0) * models.price_per_thousand(model), 9).alias("cost")
    )


@register(
    "rule_judge",
    f"""WITH q AS (SELECT item_id AS qid, text AS query FROM benchmark), {sq.index_ctes()}, {sq.score_ctes('q', 's')},
best AS (SELECT qid, doc_id FROM (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS r FROM s) WHERE r = 1),
w AS (SELECT q.qid AS item_id, list_distinct({sq.kept_words('q.query')}) AS wanted, {sq.terms('d.text')} AS t
  FROM best JOIN q ON q.qid = best.qid JOIN documents d ON d.doc_id = best.doc_id)
SELECT item_id, CASE WHEN share >= 0.75 THEN 'EXCELLENT' WHEN share >= 0.4 THEN 'ADEQUATE' ELSE 'POOR' END AS score
FROM (SELECT item_id, len(list_intersect(wanted, list_distinct(t))) / greatest(len(wanted), 1) AS share FROM w)""",
)
def rule_judge(spark, folder):
    """Every query is judged against the first document that the keyword search returns for it."""
    queries = benchmark_queries(spark, folder)
    best = lexical.bm25_topk(queries, document_index(spark, folder), 1, pad=False).select("qid", "chunk_id")
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    rows = queries.join(best, "qid").join(texts, "chunk_id")
    return rows.select(F.col("qid").alias("item_id"), models.rule_judgement(F.col("query"), F.col("text")).alias("score"))
