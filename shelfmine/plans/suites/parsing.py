"""Parsing and chunking over the whole texts of the documents table.

The texts are plain prose. Headings, turns, fences and markers are put in by rule of line number, by Spark and
by the SQL alike, so each parser meets its structure in every document.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmine.functions import patterns as pt
from shelfmine.functions import text as tx
from shelfmine.functions.arrays import lines_of
from shelfmine.functions.bpe import BytePairs
from shelfmine.operators import catalog, chunking, models, parsers
from shelfmine.operators.rows import numbered, unfolded
from shelfmine.plans import ingest
from shelfmine.plans import sqltext as sq
from shelfmine.plans.registry import register, table
from shelfmine.session import fresh_table_path
from shelfmine.sources.segments import SegmentedLibrary

LF = sq.LF


def relined(text: Column, line: Callable[[Column, Column], Column]) -> Column:
    return F.array_join(F.transform(lines_of(text), lambda l, i: line(l, i + 1)), "\n")


def _every(i: Column, n: int, r: int) -> Column:
    return i % n == r


def _two(i: Column) -> Column:
    return F.lpad((i % 60).cast("string"), 2, "0")


TWO_SQL = "lpad((i % 60)::VARCHAR, 2, '0')"

MARKED: dict[str, tuple[Callable[[Column, Column], Column], str]] = {
    "chapters": (
        lambda l, i: F.when(_every(i, 6, 0), F.concat(F.lit("CHAPTER "), F.repeat(F.lit("I"), (i % 3 + 1).cast("int")), F.lit("."))).otherwise(l),
        "CASE WHEN i % 6 = 0 THEN 'CHAPTER ' || repeat('I', i % 3 + 1) || '.' ELSE l END",
    ),
    "wrapped": (
        lambda l, i: F.when(i == 2, F.concat(F.lit("*** START OF "), l, F.lit(" ***"))).when(_every(i, 9, 0), F.lit("*** END OF THE TEXT ***")).otherwise(l),
        "CASE WHEN i = 2 THEN '*** START OF ' || l || ' ***' WHEN i % 9 = 0 THEN '*** END OF THE TEXT ***' ELSE l END",
    ),
    "endings": (
        lambda l, i: F.when(_every(i, 5, 0), F.lit("  HERE ENDETH CHAPTER IV. OF THE BOOK,")).when(_every(i, 5, 1), F.upper(F.replace(F.left(l, F.lit(40)), F.lit("ß"), F.lit("ss")))).otherwise(l),
        "CASE WHEN i % 5 = 0 THEN '  HERE ENDETH CHAPTER IV. OF THE BOOK,' WHEN i % 5 = 1 THEN upper(replace(left(l, 40), 'ß', 'ss')) ELSE l END",
    ),
    "parts": (
        lambda l, i: F.when(_every(i, 6, 0), F.lit("PART IV")).when(_every(i, 6, 3), F.concat(i.cast("string"), F.lit(". Title"))).otherwise(l),
        "CASE WHEN i % 6 = 0 THEN 'PART IV' WHEN i % 6 = 3 THEN i || '. Title' ELSE l END",
    ),
    "script": (
        lambda l, i: F.when(_every(i, 7, 2), F.concat(F.lit("INT. "), l)).when(_every(i, 14, 3), F.concat(F.lit("  ext. "), l)).otherwise(l),
        "CASE WHEN i % 7 = 2 THEN 'INT. ' || l WHEN i % 14 = 3 THEN '  ext. ' || l ELSE l END",
    ),
    "turns": (
        lambda l, i: F.when(_every(i, 5, 1), F.concat(F.lit("[00:"), _two(i), F.lit(":30] Ann Lee: "), l))
        .when(_every(i, 5, 2), F.concat(F.lit("Bob (14:"), _two(i), F.lit("): "), l))
        .when(_every(i, 5, 3), F.concat(F.lit("[29/5/2024, 10:52:23 am] Cy: "), l))
        .when(_every(i, 5, 4), F.concat(F.lit("Dee> "), l))
        .otherwise(l),
        f"CASE i % 5 WHEN 1 THEN '[00:' || {TWO_SQL} || ':30] Ann Lee: ' || l WHEN 2 THEN 'Bob (14:' || {TWO_SQL} || '): ' || l "
        "WHEN 3 THEN '[29/5/2024, 10:52:23 am] Cy: ' || l WHEN 4 THEN 'Dee> ' || l ELSE l END",
    ),
    "markdown": (
        lambda l, i: F.when(_every(i, 6, 1), F.concat(F.lit("## "), l)).when(_every(i, 6, 4), F.concat(F.lit("### "), l))
        .when(_every(i, 12, 2), F.lit("```sql")).when(_every(i, 12, 6), F.lit("```")).when(_every(i, 12, 9), F.concat(F.lit("import "), l)).otherwise(l),
        "CASE WHEN i % 6 = 1 THEN '## ' || l WHEN i % 6 = 4 THEN '### ' || l WHEN i % 12 = 2 THEN '```sql' WHEN i % 12 = 6 THEN '```' "
        "WHEN i % 12 = 9 THEN 'import ' || l ELSE l END",
    ),
    "numbered": (
        lambda l, i: F.when(_every(i, 8, 3), F.concat_ws("", F.floor(i / 8).cast("string"), F.lit("."), (i % 4).cast("string"), F.lit(" "), F.left(l, F.lit(60)))).otherwise(l),
        "CASE WHEN i % 8 = 3 THEN (i // 8) || '.' || (i % 4) || ' ' || left(l, 60) ELSE l END",
    ),
    "report": (
        lambda l, i: F.when(_every(i, 7, 2), F.concat(F.lit("Results and "), F.left(l, F.lit(50)))).when(_every(i, 14, 3), F.lit("METHODOLOGY"))
        .when(_every(i, 11, 0), F.lit("Executive Summary")).when(_every(i, 7, 4), F.concat(F.lit("10 20 30 "), l)).otherwise(l),
        "CASE WHEN i % 7 = 2 THEN 'Results and ' || left(l, 50) WHEN i % 14 = 3 THEN 'METHODOLOGY' WHEN i % 11 = 0 THEN 'Executive Summary' "
        "WHEN i % 7 = 4 THEN '10 20 30 ' || l ELSE l END",
    ),
}


def marked(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """``(doc_id, slug, text)`` with the structure of one document type."""
    docs = table(spark, folder, "documents")
    slug = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    return docs.select("doc_id", slug.alias("slug"), relined(F.col("text"), MARKED[kind][0]).alias("text"))


def marked_cte(kind: str, name: str = "src") -> str:
    return f"{name} AS (SELECT doc_id, 'd' || doc_id AS slug, {sq.relined('text', MARKED[kind][1])} AS t FROM documents)"


PLAIN = "src AS (SELECT doc_id, 'd' || doc_id AS slug, text AS t FROM documents)"


def plain(spark: SparkSession, folder: str) -> DataFrame:
    slug = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    return table(spark, folder, "documents").select("doc_id", slug.alias("slug"), "text")


def whole_sections(docs: DataFrame) -> DataFrame:
    return docs.select("slug", F.lit(1).alias("section"), "text")


def md5(column: str) -> Column:
    return F.md5(F.col(column).cast("binary"))


# ---------------------------------------------------------------- windows


@register(
    "sliding_chunks",
    f"WITH {PLAIN} SELECT slug, c + 1 AS chunk, n::BIGINT AS num_tokens, length(body) AS num_chars, md5(body) AS digest "
    f"FROM ({sq.window_rows('src', 't', 'slug', 500, 400)})",
)
def sliding_chunks(spark, folder):
    chunks = chunking.section_chunks(whole_sections(plain(spark, folder)))
    return chunks.select(
        "slug", F.col("chunk").cast("long").alias("chunk"), F.col("num_tokens").cast("long").alias("num_tokens"),
        F.col("num_chars").cast("long").alias("num_chars"), md5("text").alias("digest"),
    )


VOCABULARY = os.environ.get("SHELFMINE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


@register(
    "bpe_token_counts",
    f"""WITH RECURSIVE {PLAIN}, {sq.byte_pair_ctes("src", "t", "slug", VOCABULARY)}
SELECT slug, count(id) AS num_tokens, md5(coalesce(string_agg(id, ',' ORDER BY p), '')) AS ids FROM src LEFT JOIN tokens USING (slug) GROUP BY slug""",
)
def bpe_token_counts(spark, folder):
    """Tokens of every document in the public vocabulary."""
    ids = BytePairs(spark, VOCABULARY).ids(F.col("text"))
    return plain(spark, folder).select("slug", ids.alias("ids")).select(
        "slug", F.size("ids").cast("long").alias("num_tokens"), _listed("ids").alias("ids")
    )


@register(
    "bpe_chunks",
    f"""WITH RECURSIVE {PLAIN}, {sq.byte_pair_ctes("src", "t", "slug", VOCABULARY)},
spans AS (
  SELECT *, h[1:1] IN ('8', '9', 'A', 'B') AS inside, {sq.characters_started("h")} AS n FROM tokens),
ends AS (SELECT *, sum(n) OVER (PARTITION BY slug ORDER BY p) AS until FROM spans),
starts AS (SELECT slug, p AS low FROM tokens WHERE p % 400 = 0),
cut AS (
  SELECT slug, low // 400 + 1 AS chunk, count(*) AS num_tokens, md5(string_agg(id, ',' ORDER BY p)) AS ids,
    CAST(arg_min(until - n - CAST(inside AS int), p) AS bigint) AS from_char, CAST(max(until) AS bigint) AS to_char
  FROM starts JOIN ends USING (slug) WHERE p BETWEEN low AND low + 499 GROUP BY slug, low)
SELECT cut.*, md5(substr(t, from_char + 1, to_char - from_char)) AS digest FROM cut JOIN src USING (slug)""",
)
def bpe_chunks(spark, folder):
    """Windows of 500 tokens, a new one every 400, with the characters that they cover."""
    cut = BytePairs(spark, VOCABULARY).windows(F.col("text"), 500, 100)
    rows = unfolded(plain(spark, folder), cut, "chunk", "slug", F.col("text").alias("source"))
    covered = F.substring(F.col("source"), F.col("start") + 1, F.col("end") - F.col("start"))
    return rows.select(
        "slug", F.col("chunk").cast("long").alias("chunk"), F.col("num_tokens").cast("long").alias("num_tokens"),
        _listed("ids").alias("ids"), F.col("start").cast("long").alias("from_char"), F.col("end").cast("long").alias("to_char"),
        F.md5(covered.cast("binary")).alias("digest"),
    )


def _listed(ids: str) -> Column:
    return F.md5(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary"))


@register(
    "chunk_ids",
    f"WITH {PLAIN} SELECT {sq.identifier('slug', '1', 'c + 1', 'body')} AS chunk_id, substr(md5(body), 1, 7) AS hash "
    f"FROM ({sq.window_rows('src', 't', 'slug', 500, 400)})",
)
def chunk_ids(spark, folder):
    return chunking.section_chunks(whole_sections(plain(spark, folder))).select("chunk_id", "hash")


@register(
    "chunk_profile",
    f"""WITH {PLAIN}, c AS ({sq.window_rows('src', 't', 'slug', 500, 400)})
SELECT count(*) AS chunks, min(length(body)) AS min_chars, max(length(body)) AS max_chars,
round(avg(length(body)), 6) AS avg_chars, round(avg(n), 6) AS avg_tokens, max(n)::BIGINT AS max_tokens FROM c""",
)
def chunk_profile(spark, folder):
    return chunking.chunk_profile(chunking.section_chunks(whole_sections(plain(spark, folder))))


@register(
    "chunk_histogram",
    f"""WITH {PLAIN}, c AS ({sq.window_rows('src', 't', 'slug', 500, 400)})
SELECT (length(body) // 500 * 500)::BIGINT AS from_chars, count(*) AS chunks FROM c GROUP BY 1""",
)
def chunk_histogram(spark, folder):
    return chunking.length_histogram(chunking.section_chunks(whole_sections(plain(spark, folder))))


@register(
    "chunk_totals",
    f"""WITH {PLAIN}, c AS ({sq.window_rows('src', 't', 'slug', 500, 400)})
SELECT slug, count(*) AS num_chunks, sum(length(body))::BIGINT AS num_chars, sum(n)::BIGINT AS num_tokens FROM c GROUP BY slug""",
)
def chunk_totals(spark, folder):
    return chunking.chunk_totals(chunking.section_chunks(whole_sections(plain(spark, folder))))


@register(
    "word_chunks",
    f"""SELECT doc_id, c // 700 AS c, md5(array_to_string(tk[c + 1 : c + 800], ' ')) AS digest FROM (
SELECT doc_id, tk, unnest(range(0, len(tk), 700)) AS c FROM (
SELECT doc_id, regexp_extract_all(text, '{sq.NO_SPACE}+')[2:] AS tk FROM documents))""",
)
def word_chunks(spark, folder):
    rows = unfolded(plain(spark, folder), chunking.word_chunks(F.col("text")), "chunk", "doc_id")
    return rows.select("doc_id", (F.col("chunk") - 1).cast("long").alias("c"), md5("text").alias("digest"))


# ---------------------------------------------------------------- books

READER_SPLIT = r"regexp_split_to_array(t, '(?im)^(?:CHAPTER [IVXLCDM]+\.)\s*\n')"
BOOK_SPLIT = r"regexp_split_to_array(t, '(?im)^(?:CHAPTER [IVXLCDM]+\.?|Chapter \d+)\s*\n')"


@register(
    "section_split",
    f"""WITH {marked_cte('chapters')} SELECT doc_id, section, md5(part) AS digest FROM (
SELECT doc_id, unnest({READER_SPLIT}) AS part, generate_subscripts({READER_SPLIT}, 1) AS section FROM src)""",
)
def section_split(spark, folder):
    rows = unfolded(marked(spark, folder, "chapters"), chunking.reader_sections(F.col("text")), "section", "doc_id")
    return rows.select("doc_id", F.col("section").cast("long").alias("section"), md5("text").alias("digest"))


BOOK_PARTS = f"""parts AS (SELECT doc_id, slug, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS section, part FROM (
SELECT doc_id, slug, o, {sq.strip('part')} AS part FROM (
SELECT doc_id, slug, unnest({BOOK_SPLIT}) AS part, generate_subscripts({BOOK_SPLIT}, 1) AS o FROM src)) WHERE part <> '')"""


@register(
    "book_chapters",
    f"""WITH {marked_cte('chapters')}, {BOOK_PARTS}
SELECT doc_id, section, left(string_split(part, {LF})[1], 100) AS title, md5(part) AS digest FROM parts""",
)
def book_chapters(spark, folder):
    rows = unfolded(marked(spark, folder, "chapters"), chunking.book_sections(F.col("text")), "section", "doc_id")
    return rows.select("doc_id", F.col("section").cast("long").alias("section"), "title", md5("text").alias("digest"))


@register(
    "book_chunks",
    f"""WITH {marked_cte('chapters')}, parts AS (
SELECT slug, unnest({READER_SPLIT}) AS part, generate_subscripts({READER_SPLIT}, 1) AS section FROM src)
SELECT {sq.identifier('slug', 'section', 'c + 1', 'body')} AS chunk_id, n::BIGINT AS num_tokens
FROM ({sq.window_rows('parts', 'part', 'slug, section', 60, 50)})""",
)
def book_chunks(spark, folder):
    chunks = chunking.book_chunks(marked(spark, folder, "chapters"), max_tokens=60, overlap=10)
    return chunks.select("chunk_id", F.col("num_tokens").cast("long").alias("num_tokens"))


@register(
    "append_then_replace",
    f"""WITH {marked_cte('chapters')}, numbered AS (SELECT *, CAST(substr(slug, 2) AS bigint) AS n FROM src),
final AS (
  SELECT slug, CASE WHEN n % 14 <> 0 AND n % 5 = 0 THEN left(t, length(t) // 2) ELSE t END AS t FROM numbered
  WHERE n % 7 <> 0 OR n % 14 = 0),
parts AS (SELECT slug, unnest({READER_SPLIT}) AS part, generate_subscripts({READER_SPLIT}, 1) AS section FROM final),
cut AS (SELECT slug, section, length(body) AS chars FROM ({sq.window_rows('parts', 'part', 'slug, section', 60, 50)}))
SELECT slug, count(section) AS chunks, count(DISTINCT section) AS sections, CAST(coalesce(sum(chars), 0) AS bigint) AS chars,
  count(section) AS points, count(section) AS indexed
FROM final LEFT JOIN cut USING (slug) GROUP BY slug""",
)
def append_then_replace(spark, folder):
    """A stored library after two batches, the second of which replaces documents, a removal and a batch that brings some
    back: what the catalogue says of every document, and what its tables hold."""
    rows = marked(spark, folder, "chapters").select(
        "slug", F.lit("t").alias("title"), F.lit("").alias("author"), F.lit("book").alias("doc_type"), "text"
    )
    n = F.substring("slug", 2, 20).cast("long")
    half = F.left("text", F.floor(F.length("text") / 2).cast("int"))
    library = SegmentedLibrary.create(spark, fresh_table_path(spark, "library"))
    add = lambda library, batch: ingest.append(batch, library, replace_known=True, max_tokens=60, overlap=10)
    library = add(library, rows.where(n % 3 != 0))
    library = add(library, rows.where((n % 3 == 0) | (n % 5 == 0)).withColumn("text", F.when(n % 5 == 0, half).otherwise(F.col("text"))))
    library = library.delete(rows.where(n % 7 == 0).select("slug"))
    library = add(library, rows.where(n % 14 == 0))
    stores = ingest.stores_of(library)
    held = lambda df, name: df.groupBy("slug").agg(F.count(F.lit(1)).alias(name))
    out = stores.documents.select("slug", F.col("num_chunks").cast("long").alias("chunks"), F.col("num_chars").alias("chars"))
    for df, name in ((stores.section_summaries, "sections"), (stores.vectors, "points"), (stores.index.lengths, "indexed")):
        out = out.join(held(df, name), "slug", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    return out


@register(
    "parsed_book_chunks",
    f"""WITH {marked_cte('chapters')}, {BOOK_PARTS}
SELECT {sq.identifier('slug', 'section', 'c + 1', 'body')} AS chunk_id,
row_number() OVER (PARTITION BY slug ORDER BY section, c) AS chunk_index
FROM ({sq.window_rows('parts', 'part', 'slug, section', 60, 50)})""",
)
def parsed_book_chunks(spark, folder):
    chunks = chunking.parsed_book_chunks(marked(spark, folder, "chapters"), max_tokens=60, overlap=10)
    return chunks.select("chunk_id", F.col("chunk_index").cast("long").alias("chunk_index"))


CHAPTER_CHUNKS = f"""{marked_cte('chapters')}, parts AS (
SELECT slug, unnest({READER_SPLIT}) AS part, generate_subscripts({READER_SPLIT}, 1) AS section FROM src),
chunks AS (SELECT slug, section, c + 1 AS chunk, body, {sq.identifier('slug', 'section', 'c + 1', 'body')} AS chunk_id
FROM ({sq.window_rows('parts', 'part', 'slug, section', 60, 50)}))"""


@register(
    "chapter_info",
    f"""WITH {CHAPTER_CHUNKS} SELECT slug, count(*) AS total_chunks, count(DISTINCT section) AS total_chapters,
arg_min(chunk_id, section * 100000 + chunk) AS first_chunk, arg_max(chunk_id, section * 100000 + chunk) AS last_chunk,
format('{{:02d}} to {{:02d}}', min(section), max(section)) AS chapter_range FROM chunks GROUP BY slug""",
)
def chapter_info(spark, folder):
    return catalog.chapter_info(chunking.book_chunks(marked(spark, folder, "chapters"), max_tokens=60, overlap=10))


@register(
    "chunks_per_section",
    f"WITH {CHAPTER_CHUNKS} SELECT slug, section, count(*) AS chunks FROM chunks GROUP BY slug, section",
)
def chunks_per_section(spark, folder):
    chunks = chunking.book_chunks(marked(spark, folder, "chapters"), max_tokens=60, overlap=10)
    return catalog.chunks_per_section(chunks).withColumn("section", F.col("section").cast("long"))


SECTION_TEXTS = f"{CHAPTER_CHUNKS}, st AS (SELECT slug, section, string_agg(body, {LF} ORDER BY chunk) AS t FROM chunks GROUP BY slug, section)"
SUMMARY_SQL = "CASE WHEN len(string_split({t}, '.')) > 2 THEN string_split({t}, '.')[2] ELSE string_split({t}, '.')[1] END"


@register("section_texts", f"WITH {SECTION_TEXTS} SELECT slug, section, md5(t) AS digest FROM st")
def section_texts(spark, folder):
    chunks = chunking.book_chunks(marked(spark, folder, "chapters"), max_tokens=60, overlap=10)
    return chunking.section_texts(chunks).select("slug", F.col("section").cast("long").alias("section"), md5("text").alias("digest"))


@register(
    "section_summaries",
    f"WITH {SECTION_TEXTS} SELECT slug, section, {SUMMARY_SQL.format(t='t')} AS summary FROM st",
)
def section_summaries(spark, folder):
    chunks = chunking.book_chunks(marked(spark, folder, "chapters"), max_tokens=60, overlap=10)
    return models.section_summaries(chunking.section_texts(chunks)).withColumn("section", F.col("section").cast("long"))


@register(
    "section_summaries_in_parts",
    f"""WITH {SECTION_TEXTS}, tk AS (SELECT slug, section, t, {sq.pieces('t')} AS tk FROM st),
sz AS (SELECT *, len(tk) // (len(tk) // 40 + 1) AS size FROM tk WHERE len(tk) > 40),
ps AS (SELECT slug, section, o // size + 1 AS part, array_to_string(tk[o + 1 : o + size], '') AS b FROM (
  SELECT *, unnest(range(0, len(tk), size)) AS o FROM sz)),
js AS (SELECT slug, section, string_agg('Part ' || part || ': ' || {SUMMARY_SQL.format(t='b')}, {LF} || {LF} ORDER BY part) AS j
  FROM ps GROUP BY slug, section)
SELECT slug, section, {SUMMARY_SQL.format(t='j')} AS summary FROM js
UNION ALL SELECT slug, section, {SUMMARY_SQL.format(t='t')} FROM tk WHERE len(tk) <= 40""",
)
def section_summaries_in_parts(spark, folder):
    chunks = chunking.book_chunks(marked(spark, folder, "chapters"), max_tokens=60, overlap=10)
    sections = chunking.section_texts(chunks)
    return models.section_summaries(sections, max_tokens=40).withColumn("section", F.col("section").cast("long"))


@register(
    "document_summaries",
    f"""WITH {SECTION_TEXTS}, ss AS (SELECT slug, section, {SUMMARY_SQL.format(t='t')} AS s FROM st),
j AS (SELECT slug, string_agg('Chapter ' || section || ': ' || s, {LF} || {LF} ORDER BY section) AS j FROM ss GROUP BY slug)
SELECT slug, {SUMMARY_SQL.format(t='j')} AS summary FROM j""",
)
def document_summaries(spark, folder):
    chunks = chunking.book_chunks(marked(spark, folder, "chapters"), max_tokens=60, overlap=10)
    return models.document_summaries(models.section_summaries(chunking.section_texts(chunks)))


@register(
    "boilerplate_strip",
    f"""WITH {marked_cte('wrapped')}, m AS (SELECT doc_id, t, regexp_extract(t, '\\*\\*\\* START OF.*\\*\\*\\*') AS a,
regexp_extract(t, '\\*\\*\\* END OF.*\\*\\*\\*') AS b FROM src),
s AS (SELECT doc_id, CASE WHEN a <> '' AND b <> '' THEN
  substr(t, position(a IN t) + length(a), greatest(position(b IN t) - position(a IN t) - length(a), 0)) ELSE t END AS body,
  a <> '' AND b <> '' AS cut FROM m)
SELECT doc_id, md5(body) AS kept, md5(CASE WHEN cut THEN {sq.strip('body')} ELSE body END) AS trimmed, length(body) AS n FROM s""",
)
def boilerplate_strip(spark, folder):
    text = F.col("text")
    rows = marked(spark, folder, "wrapped").select(
        "doc_id", chunking.strip_boilerplate(text).alias("kept"), chunking.strip_boilerplate(text, trim=True).alias("trimmed")
    )
    return rows.select(
        "doc_id", md5("kept").alias("kept"), md5("trimmed").alias("trimmed"), F.length("kept").cast("long").alias("n")
    )


ENDING = r"^\s*HERE ENDETH CHAPTER [IVXLCDM]+\. OF THE.*$"
ENDING_SPLIT = f"regexp_split_to_array(t, '(?m){ENDING}')"


@register(
    "ending_marker_chapters",
    f"""WITH {marked_cte('endings')}, parts AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS section, part FROM (
SELECT doc_id, o, {sq.strip('part')} AS part FROM (
SELECT doc_id, unnest({ENDING_SPLIT}) AS part, generate_subscripts({ENDING_SPLIT}, 1) AS o FROM src)) WHERE length(part) >= 100),
titles AS (SELECT doc_id, section, part, list_filter(list_transform(string_split(part, {LF})[1:10], lambda l: {sq.strip('l')}),
  lambda l: length(l) > 5 AND length(l) < 100 AND (upper(l) = l OR (regexp_matches(l, '[\\p{{Lu}}\\p{{Lt}}\\p{{Ll}}]')
  AND NOT regexp_matches(l, '(^|[^\\p{{Lu}}\\p{{Lt}}\\p{{Ll}}])\\p{{Ll}}|[\\p{{Lu}}\\p{{Lt}}\\p{{Ll}}][\\p{{Lu}}\\p{{Lt}}]')))) AS ts FROM parts)
SELECT doc_id, section, coalesce(left(ts[1], 80), 'Chapter ' || section) AS title, md5(part) AS digest FROM titles""",
)
def ending_marker_chapters(spark, folder):
    rows = unfolded(
        marked(spark, folder, "endings"), chunking.ending_marker_sections(F.col("text"), ENDING), "section", "doc_id"
    )
    return rows.select("doc_id", F.col("section").cast("long").alias("section"), "title", md5("text").alias("digest"))


CHAPTER_LINE = r"^CHAPTER\ [IVXLCDM]+\.(?:\s+.+)?$"


@register(
    "pattern_check",
    f"""WITH {marked_cte('chapters')}, fl AS (SELECT doc_id, CASE WHEN a[len(a)] = '' THEN a[:len(a) - 1] ELSE a END AS a FROM (
  SELECT doc_id, string_split(regexp_replace(t, '\\r\\n?', chr(10), 'g'), chr(10)) AS a FROM src)),
l2 AS (SELECT doc_id, len(a) AS total, unnest(a) AS l, generate_subscripts(a, 1) AS i FROM fl),
m AS (SELECT doc_id, count(*) AS hits, min(i) AS first, max(i) AS last FROM l2
  WHERE i > least(50, total // 10) AND regexp_matches({sq.strip('l')}, '^CHAPTER [IVXLCDM]+\\.(?:\\s+.+)?$') GROUP BY doc_id)
SELECT fl.doc_id, coalesce(hits, 0) AS hits, coalesce(hits >= 2 AND last - first >= len(a) * 0.1, false) AS ok
FROM fl LEFT JOIN m USING (doc_id)""",
)
def pattern_check(spark, folder):
    pattern, _ = pt.pattern_from_example("CHAPTER I.")
    rows = marked(spark, folder, "chapters").select("doc_id", pt.pattern_check(F.col("text"), pattern).alias("c"))
    return rows.select("doc_id", F.size("c.matches").cast("long").alias("hits"), "c.ok")


@register(
    "pattern_detection",
    f"""WITH {marked_cte('parts')}, h AS (SELECT doc_id, [{', '.join(f"len(regexp_extract_all(t, '(?m){p}'))" for p, _ in pt.DETECTABLE)}] AS n FROM src)
SELECT doc_id, list_position(list_transform(n, lambda x: x >= 2), true) AS which,
n[list_position(list_transform(n, lambda x: x >= 2), true)] AS hits FROM h WHERE list_contains(list_transform(n, lambda x: x >= 2), true)""",
)
def pattern_detection(spark, folder):
    known = F.array(*[F.lit(p) for p, _ in pt.DETECTABLE])
    rows = marked(spark, folder, "parts").select("doc_id", pt.detected_pattern(F.col("text")).alias("d"))
    return rows.where(F.col("d").isNotNull()).select(
        "doc_id", F.array_position(known, F.col("d.pattern")).cast("int").alias("which"), F.col("d.hits").cast("long").alias("hits")
    )


# ---------------------------------------------------------------- scripts

SCENE_SQL = f"regexp_matches({sq.strip('l')}, '(?i)^(INT\\.|EXT\\.|INT/EXT\\.|I/E\\.|INT |EXT )')"
SCENES = f"{marked_cte('script')}, {sq.island_ctes('src', SCENE_SQL, True)}"


@register(
    "script_scenes",
    f"WITH {SCENES} SELECT doc_id, k AS scene_number, {sq.strip('head')} AS heading, md5({sq.strip('body')}) AS digest FROM isl",
)
def script_scenes(spark, folder):
    rows = unfolded(marked(spark, folder, "script"), parsers.script_scenes(F.col("text")), "scene_number", "doc_id")
    return rows.select("doc_id", F.col("scene_number").cast("long").alias("scene_number"), "heading", md5("text").alias("digest"))


@register(
    "script_chunks",
    f"""WITH {SCENES}, full_text AS (SELECT 'd' || doc_id AS slug, k,
'SCENE ' || k || ': ' || {sq.strip('head')} || {LF} || {LF} || {sq.strip('body')} AS x FROM isl)
SELECT {sq.identifier('slug', 'k', '1', 'x')} AS chunk_id, len({sq.pieces('x')}) AS num_tokens, length(x) AS num_chars FROM full_text""",
)
def script_chunks(spark, folder):
    return parsers.script_chunks(marked(spark, folder, "script")).select(
        "chunk_id", F.col("num_tokens").cast("long").alias("num_tokens"), F.col("num_chars").cast("long").alias("num_chars")
    )


@register(
    "scenes_with_keyword",
    f"WITH {SCENES} SELECT doc_id, k AS scene_number FROM isl WHERE contains(lower(head), 'tion') OR contains(lower(body), 'tion')",
)
def scenes_with_keyword(spark, folder):
    rows = unfolded(marked(spark, folder, "script"), parsers.script_scenes(F.col("text")), "scene_number", "doc_id")
    return parsers.scenes_with(rows, "TION").select("doc_id", F.col("scene_number").cast("long").alias("scene_number"))


# ---------------------------------------------------------------- transcripts

TURN_SQL = [p.replace("(?:", "(?:") for p in parsers.TURN_PATTERNS]


def _turn_field(n: int) -> str:
    """CASE over the patterns, first match wins."""
    return "CASE " + " ".join(f"WHEN regexp_matches(l, '{p}') THEN {_group(i, p, n)}" for i, p in enumerate(TURN_SQL)) + " END"


def _group(i: int, pattern: str, n: int) -> str:
    g = lambda k: f"regexp_extract(l, '{pattern}', {k})"
    timed = f"(contains({g(1)}, ':') AND length({g(1)}) > 5)"
    if i < parsers.TIMED_PATTERNS:
        return {
            1: f"trim(CASE WHEN {timed} THEN {g(2)} ELSE {g(1)} END, {sq.STRIP})",
            2: f"CASE WHEN {timed} THEN {g(1)} ELSE {g(2)} END",
            3: g(3),
        }[n]
    return {1: f"trim({g(1)}, {sq.STRIP})", 2: "NULL", 3: g(2)}[n]


ANY_TURN = " OR ".join(f"regexp_matches(l, '{p}')" for p in TURN_SQL)
TURNS = f"""{marked_cte('turns')}, l0 AS (SELECT doc_id, unnest({sq.lines('t')}) AS l, generate_subscripts({sq.lines('t')}, 1) AS i FROM src),
ln AS (SELECT doc_id, i, {sq.strip('l')} AS l FROM l0 WHERE {sq.strip('l')} <> ''),
hd AS (SELECT *, ({ANY_TURN}) AS h FROM ln),
gr AS (SELECT *, sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM hd),
pr AS (SELECT *, CASE WHEN h THEN {_turn_field(3)} ELSE l END AS said, CASE WHEN h THEN {_turn_field(1)} END AS who,
  CASE WHEN h THEN {_turn_field(2)} END AS ts FROM gr WHERE g > 0),
turns AS (SELECT doc_id, g::BIGINT AS turn, max(who) AS speaker, max(ts) AS timestamp, {sq.strip(f"string_agg(said, {LF} ORDER BY i)")} AS text
  FROM pr GROUP BY doc_id, g)"""


@register(
    "conversation_turns",
    f"WITH {TURNS} SELECT doc_id, turn, speaker, timestamp, md5(text) AS digest FROM turns",
)
def conversation_turns(spark, folder):
    rows = unfolded(marked(spark, folder, "turns"), parsers.conversation_turns(F.col("text")), "turn", "doc_id")
    return rows.select("doc_id", F.col("turn").cast("long").alias("turn"), "speaker", "timestamp", md5("text").alias("digest"))


def packing_ctes(turns: str, key: str, size: int, overlap: int) -> str:
    """Recursive packing over {turns}(key, turn, tok, line): packed(key, section, first, past)."""
    return f"""pos AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY turn) - 1 AS p, turn, tok, line,
  sum(tok) OVER (PARTITION BY {key} ORDER BY turn) AS upto, count(*) OVER (PARTITION BY {key}) AS n FROM {turns}),
ends AS (SELECT a.{key}, a.p, greatest(a.p + 1, max(b.p) + 1) AS past, any_value(a.n) AS n FROM pos a JOIN pos b
  ON a.{key} = b.{key} AND b.p >= a.p AND (b.p = a.p OR b.upto - a.upto + a.tok <= {size}) GROUP BY a.{key}, a.p),
chain AS (SELECT {key}, p, past, n, 1::BIGINT AS section FROM ends WHERE p = 0
  UNION ALL SELECT e.{key}, e.p, e.past, e.n, c.section + 1 FROM chain c JOIN ends e
  ON e.{key} = c.{key} AND e.p = greatest(c.p + 1, c.past - {overlap})),
packed AS (SELECT c.{key}, c.section, min(x.turn) AS turn_start, max(x.turn) AS turn_end, count(*) AS num_turns,
  sum(x.tok)::BIGINT AS num_tokens, string_agg(x.line, {LF} ORDER BY x.p) AS text
  FROM chain c JOIN pos x ON x.{key} = c.{key} AND x.p >= c.p AND x.p < c.past GROUP BY c.{key}, c.section)"""


LINE_SQL = "speaker || CASE WHEN timestamp IS NULL OR timestamp = '' THEN '' ELSE ' (' || timestamp || ')' END || ': ' || text"


@register(
    "conversation_chunks",
    f"""WITH RECURSIVE {TURNS}, tl AS (SELECT doc_id, turn, len({sq.pieces('text')}) AS tok, {LINE_SQL} AS line FROM turns),
{packing_ctes('tl', 'doc_id', 120, 2)}
SELECT {sq.identifier("'d' || doc_id", 'section', '1', 'text')} AS chunk_id, turn_start, turn_end, num_turns, num_tokens FROM packed""",
)
def conversation_chunks(spark, folder):
    chunks = parsers.conversation_chunks(marked(spark, folder, "turns"), max_tokens=120)
    return chunks.select("chunk_id", *[F.col(c).cast("long").alias(c) for c in ("turn_start", "turn_end", "num_turns", "num_tokens")])


SECONDS = """CASE len(string_split({s}, ':')) WHEN 3 THEN TRY_CAST(trim(string_split({s}, ':')[1]) AS INT) * 3600
 + TRY_CAST(trim(string_split({s}, ':')[2]) AS INT) * 60 + TRY_CAST(trim(string_split({s}, ':')[3]) AS INT)
 WHEN 2 THEN TRY_CAST(trim(string_split({s}, ':')[1]) AS INT) * 60 + TRY_CAST(trim(string_split({s}, ':')[2]) AS INT) ELSE 0 END"""


@register(
    "conversation_metadata",
    f"""WITH {TURNS}, m AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT speaker)), '|') AS participants,
count(DISTINCT speaker) AS num_participants, count(*) AS num_turns, count(nullif(timestamp, '')) > 0 AS has_timestamps,
list(timestamp ORDER BY turn) FILTER (nullif(timestamp, '') IS NOT NULL) AS ts FROM turns GROUP BY doc_id)
SELECT doc_id, participants, num_participants, num_turns, has_timestamps,
CASE WHEN len(ts) >= 2 THEN {SECONDS.format(s='ts[len(ts)]')} - ({SECONDS.format(s='ts[1]')}) END::BIGINT AS duration_seconds FROM m""",
)
def conversation_metadata(spark, folder):
    rows = parsers.conversation_metadata(marked(spark, folder, "turns"), slug="doc_id")
    return rows.select(
        F.col("slug").alias("doc_id"),
        F.array_join("participants", "|").alias("participants"),
        F.col("num_participants").cast("long").alias("num_participants"),
        F.col("num_turns").cast("long").alias("num_turns"),
        "has_timestamps",
        F.col("duration_seconds").cast("long").alias("duration_seconds"),
    )


TIMED = r"^\[(\d{2}:\d{2}:\d{2})\]\s*([^:]+):\s*(.+)$"


@register(
    "strict_timed_turns",
    f"""WITH {marked_cte('turns')}, {sq.line_ctes('src')}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS turn, regexp_extract(s, '{TIMED}', 2) AS speaker,
regexp_extract(s, '{TIMED}', 1) AS timestamp, md5(regexp_extract(s, '{TIMED}', 3)) AS digest
FROM (SELECT *, {sq.strip('l')} AS s FROM ln) WHERE regexp_matches(s, '{TIMED}')""",
)
def strict_timed_turns(spark, folder):
    rows = unfolded(marked(spark, folder, "turns"), parsers.strict_turns(F.col("text"), timed=True), "turn", "doc_id")
    return rows.select("doc_id", F.col("turn").cast("long").alias("turn"), "speaker", "timestamp", md5("text").alias("digest"))


# ---------------------------------------------------------------- technical documents and reports

HEADING = r"^(#{2,3})\s+(.+)$"
NUMBERED = r"^(\d+\.?\d*)\s+(.+)$"
HAS_CODE = "(regexp_matches({t}, '(?s)```(\\w+)?\\n(.*?)```') OR " + " OR ".join(f"contains({{t}}, '{w}')" for w in tx.CODE_WORDS) + ")"
ALIGNED = (
    "len(list_filter(string_split({t}, chr(10)), lambda l: (length(l) - length(replace(l, '  ', ''))) / 2 >= 3 OR contains(l, chr(9))))"
)
TABLE_TECH = "(regexp_matches({t}, '\\|.*\\|') OR " + ALIGNED + " >= 3)"
TABLE_REPORT = "(" + ALIGNED + " >= 3 OR regexp_matches({t}, '(\\d+\\s+){{3,}}'))"


@register(
    "markdown_sections",
    f"""WITH {marked_cte('markdown')}, {sq.island_ctes('src', f"regexp_matches(l, '{HEADING}')", False)}
SELECT doc_id, k::VARCHAR AS section, {sq.strip(f"regexp_extract(head, '{HEADING}', 2)")} AS heading, md5({sq.strip('body')}) AS digest FROM isl""",
)
def markdown_sections(spark, folder):
    rows = unfolded(marked(spark, folder, "markdown"), parsers.markdown_sections(F.col("text")), "section", "doc_id")
    return rows.select("doc_id", "section", "heading", md5("text").alias("digest"))


NUMBERED_HEAD = f"regexp_matches({sq.strip('l')}, '{NUMBERED}') AND length({sq.strip('l')}) < 100"


@register(
    "numbered_sections",
    f"""WITH {marked_cte('numbered')}, {sq.island_ctes('src', NUMBERED_HEAD, False)}
SELECT doc_id, regexp_extract({sq.strip('head')}, '{NUMBERED}', 1) AS section,
{sq.strip(f"regexp_extract({sq.strip('head')}, '{NUMBERED}', 2)")} AS heading, md5({sq.strip('body')}) AS digest FROM isl
UNION ALL SELECT doc_id, '1', 'Document', md5(t) FROM src WHERE doc_id NOT IN (SELECT doc_id FROM isl)""",
)
def numbered_sections(spark, folder):
    rows = unfolded(marked(spark, folder, "numbered"), parsers.numbered_sections(F.col("text")), "section", "doc_id")
    return rows.select("doc_id", "section", "heading", md5("text").alias("digest"))


def whole_or_windows_sql(sections: str, whole: str, hashed: str, size: int, overlap: int, flags: str) -> str:
    return f"""whole AS (SELECT *, {sq.pieces('body')} AS tk FROM {sections}),
split AS ({sq.window_rows(f"(SELECT * EXCLUDE tk FROM whole WHERE len(tk) > {size})", 'body', 'doc_id, k, ' + flags, size, size - overlap)})
SELECT {sq.identifier("'d' || doc_id", 'k', '1', hashed)} AS chunk_id, md5({whole}) AS digest, len(tk) AS num_tokens,
length({hashed}) AS num_chars, false AS is_partial, {flags} FROM whole WHERE len(tk) <= {size}
UNION ALL SELECT {sq.identifier("'d' || doc_id", 'k', 'c + 1', 'body')}, md5(body), n::BIGINT, length(body), true, {flags} FROM split"""


@register(
    "techdoc_chunks",
    f"""WITH {marked_cte('markdown')}, {sq.island_ctes('src', f"regexp_matches(l, '{HEADING}')", False)},
sec AS (SELECT doc_id, k, {sq.strip(f"regexp_extract(head, '{HEADING}', 2)")} AS heading, {sq.strip('body')} AS body,
  {HAS_CODE.format(t=sq.strip('body'))} AS has_code, {TABLE_TECH.format(t=sq.strip('body'))} AS has_table FROM isl),
{whole_or_windows_sql('sec', f"'## ' || heading || {LF} || {LF} || body", 'body', 60, 10, 'has_code, has_table')}""",
)
def techdoc_chunks(spark, folder):
    chunks = parsers.techdoc_chunks(marked(spark, folder, "markdown"), max_tokens=60, overlap=10)
    return chunks.select(
        "chunk_id", md5("text").alias("digest"), F.col("num_tokens").cast("long").alias("num_tokens"),
        F.col("num_chars").cast("long").alias("num_chars"), "is_partial", "has_code", "has_table",
    )


def _keyword_sql(line: str) -> str:
    cases = " ".join(f"WHEN contains(lower({line}), '{w}') THEN '{w.replace(' ', '_')}'" for w in parsers.REPORT_KEYWORDS)
    return f"CASE WHEN length({line}) >= 100 THEN NULL {cases} END"


REPORTS = f"""{marked_cte('report')}, {sq.island_ctes('src', _keyword_sql(sq.strip('l')) + ' IS NOT NULL', True)},
sec0 AS (SELECT doc_id, k, {_keyword_sql(sq.strip('head'))} AS section_type, {sq.strip('head')} AS heading, {sq.strip('body')} AS body FROM isl
  UNION ALL SELECT doc_id, 1, 'full_document', 'Full Report', t FROM src WHERE doc_id NOT IN (SELECT doc_id FROM isl)),
sec AS (SELECT *, {TABLE_REPORT.format(t='body')} AS has_table FROM sec0)"""


@register("report_sections", f"WITH {REPORTS} SELECT doc_id, k AS ordinal, section_type, heading, md5(body) AS digest FROM sec")
def report_sections(spark, folder):
    rows = numbered(marked(spark, folder, "report"), parsers.report_sections(F.col("text")), "i", "s", "doc_id")
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("ordinal"), "s.*").select(
        "doc_id", "ordinal", "section_type", "heading", md5("text").alias("digest")
    )


@register(
    "report_chunks",
    f"""WITH {REPORTS}, {whole_or_windows_sql('sec', f"heading || {LF} || {LF} || body", f"heading || {LF} || {LF} || body", 60, 10, 'section_type, has_table')}""",
)
def report_chunks(spark, folder):
    chunks = parsers.report_chunks(marked(spark, folder, "report"), max_tokens=60, overlap=10)
    return chunks.select(
        "chunk_id", md5("text").alias("digest"), F.col("num_tokens").cast("long").alias("num_tokens"),
        F.col("num_chars").cast("long").alias("num_chars"), "is_partial", "section_type", "has_table",
    )


@register(
    "report_metadata",
    f"""WITH {REPORTS} SELECT doc_id, count(*) AS num_sections, array_to_string(list_sort(list(DISTINCT section_type)), '|') AS section_types,
bool_or(section_type = 'executive_summary') AS has_executive_summary, bool_or(has_table) AS has_tables FROM sec GROUP BY doc_id""",
)
def report_metadata(spark, folder):
    rows = parsers.document_metadata(marked(spark, folder, "report"), "report", slug="doc_id")
    return rows.select(
        F.col("slug").alias("doc_id"), F.col("num_sections").cast("long").alias("num_sections"),
        F.array_join("section_types", "|").alias("section_types"), "has_executive_summary", "has_tables",
    )


@register(
    "code_assets",
    f"""WITH {marked_cte('markdown')}, b AS (SELECT doc_id, unnest(regexp_extract_all(t, '(?s)```(\\w+)?\\n(.*?)```', 1)) AS lang,
unnest(regexp_extract_all(t, '(?s)```(\\w+)?\\n(.*?)```', 2)) AS code, generate_subscripts(regexp_extract_all(t, '(?s)```(\\w+)?\\n(.*?)```', 1), 1) AS ordinal FROM src)
SELECT doc_id, ordinal, coalesce(nullif(lang, ''), 'unknown') AS language, md5({sq.strip('code')}) AS digest, len({sq.lines(sq.strip('code'))}) AS lines FROM b""",
)
def code_assets(spark, folder):
    rows = parsers.code_assets(marked(spark, folder, "markdown"), slug="doc_id")
    return rows.select(
        F.col("slug").alias("doc_id"), F.col("ordinal").cast("long").alias("ordinal"), "language",
        md5("content").alias("digest"), F.col("lines").cast("long").alias("lines"),
    )


@register(
    "structure_detectors",
    f"""SELECT doc_id, {HAS_CODE.format(t='text')} AS has_code, {TABLE_TECH.format(t='text')} AS table_techdoc,
{TABLE_REPORT.format(t='text')} AS table_report FROM documents""",
)
def structure_detectors(spark, folder):
    text = F.col("text")
    return table(spark, folder, "documents").select(
        "doc_id", tx.has_code(text).alias("has_code"), tx.has_table_techdoc(text).alias("table_techdoc"),
        tx.has_table_report(text).alias("table_report"),
    )


@register(
    "tabular_lines",
    f"""WITH {marked_cte('report')} SELECT doc_id, len(list_filter({sq.lines('t')},
lambda l: (contains(l, chr(9)) OR contains(l, '  ')) AND regexp_matches(l, '\\d'))) AS n FROM src""",
)
def tabular_lines(spark, folder):
    rows = marked(spark, folder, "report")
    return rows.select("doc_id", F.size(tx.tabular_lines(F.col("text"))).cast("long").alias("n"))


@register(
    "marker_positions",
    f"""WITH {marked_cte('endings')} SELECT doc_id, len(string_split(t, 'HERE ENDETH')) - 1 AS hits,
position('HERE ENDETH' IN t)::BIGINT AS first FROM src""",
)
def marker_positions(spark, folder):
    rows = marked(spark, folder, "endings").select("doc_id", tx.occurrences(F.col("text"), "HERE ENDETH").alias("o"))
    return rows.select("doc_id", F.col("o.count").cast("long").alias("hits"), F.col("o.first").cast("long").alias("first"))


@register(
    "all_level_sections",
    f"""WITH {marked_cte('markdown')}, {sq.line_ctes('src')}, hd AS (SELECT *, starts_with(l, '#') AS h FROM ln),
gr AS (SELECT *, greatest(sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i), 1) AS g,
  bool_or(h) OVER (PARTITION BY doc_id) AS any_head FROM hd)
SELECT doc_id, g::BIGINT AS section, max(length(regexp_extract(l, '^#+'))) FILTER (h) AS level,
{sq.strip("regexp_replace(max(l) FILTER (h), '^#+', '')")} AS heading,
md5(coalesce(string_agg(l, {LF} ORDER BY i) FILTER (NOT h), '')) AS digest FROM gr WHERE any_head GROUP BY doc_id, g""",
)
def all_level_sections(spark, folder):
    rows = unfolded(marked(spark, folder, "markdown"), parsers.all_level_sections(F.col("text")), "section", "doc_id")
    return rows.select(
        "doc_id", F.col("section").cast("long").alias("section"), F.col("level").cast("long").alias("level"), "heading",
        md5("text").alias("digest"),
    )


@register(
    "techdoc_metadata",
    f"""WITH {marked_cte('markdown')}, {sq.island_ctes('src', f"regexp_matches(l, '{HEADING}')", False)},
s AS (SELECT doc_id, k, {sq.strip(f"regexp_extract(head, '{HEADING}', 2)")} AS heading, {sq.strip('body')} AS b FROM isl)
SELECT doc_id, count(*) AS num_sections, bool_or({HAS_CODE.format(t='b')}) AS has_code, bool_or({TABLE_TECH.format(t='b')}) AS has_tables,
md5(string_agg(heading, '|' ORDER BY k) FILTER (k <= 10)) AS headings FROM s GROUP BY doc_id""",
)
def techdoc_metadata(spark, folder):
    rows = parsers.document_metadata(marked(spark, folder, "markdown"), "tech_doc", slug="doc_id")
    return rows.where(F.col("num_sections") > 0).select(
        F.col("slug").alias("doc_id"), F.col("num_sections").cast("long").alias("num_sections"), "has_code", "has_tables",
        F.md5(F.array_join("section_headings", "|").cast("binary")).alias("headings"),
    )


@register(
    "book_metadata",
    f"SELECT doc_id, length(text) AS total_chars, len(regexp_extract_all(text, '{sq.NO_SPACE}+')) AS total_words FROM documents",
)
def book_metadata(spark, folder):
    rows = parsers.document_metadata(plain(spark, folder), "book", slug="doc_id")
    return rows.select(
        F.col("slug").alias("doc_id"), F.col("total_chars").cast("long").alias("total_chars"),
        F.col("total_words").cast("long").alias("total_words"),
    )


@register("library_chars", "SELECT source, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source")
def library_chars(spark, folder):
    return table(spark, folder, "documents").groupBy("source").agg(F.sum(F.length("text")).alias("chars"))
