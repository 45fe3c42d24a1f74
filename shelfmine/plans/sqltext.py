"""Fragments of the checking SQL."""

from __future__ import annotations

from shelfmine.functions.arrays import WHITESPACE
from shelfmine.functions.text import INDEX_STOPWORDS, QUERY_STOPWORDS

WORD = r"[\p{L}\p{M}\p{N}_]+"
SPACE = r"[\t\n\v\f\r \x{85}\p{Z}]"
NO_SPACE = r"[^\t\n\v\f\r \x{85}\p{Z}]"
LF = "chr(10)"
STRIP = "||".join(f"chr({ord(c)})" for c in WHITESPACE)


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{WORD}')"


def terms(text: str) -> str:
    return f"list_filter({words(text)}, lambda w: w NOT IN ({quoted(INDEX_STOPWORDS)}))"


def pieces(text: str) -> str:
    return f"regexp_extract_all({text}, '{SPACE}*{NO_SPACE}+')"


def strip(text: str) -> str:
    return f"trim({text}, {STRIP})"


def kept_words(query: str) -> str:
    cleaned = f"regexp_replace(lower({query}), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s\\p{{Z}}-]', ' ', 'g')"
    return (
        f"list_filter(regexp_split_to_array({cleaned}, '{SPACE}+'), "
        f"lambda w: length(w) > 2 AND w NOT IN ({quoted(QUERY_STOPWORDS)}))"
    )


def preprocessed(query: str) -> str:
    return f"coalesce(nullif(array_to_string({kept_words(query)}, ' '), ''), {query})"


def lines(text: str) -> str:
    return f"string_split({text}, {LF})"

# a character that no text has, between the spaces before a word
MARK = "\ue000"


def joined(lines_sql: str) -> str:
    return f"array_to_string({lines_sql}, {LF})"


def index_ctes(text: str = "text") -> str:
    """docs, lens, post, stats, idf over the documents table."""
    return f"""docs AS (SELECT doc_id, source, {terms(text)} AS terms FROM documents),
lens AS (SELECT doc_id, source, len(terms) AS dl FROM docs),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM docs) GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
idf AS (SELECT term, df, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf
        FROM (SELECT term, count(*) AS df FROM post GROUP BY term), stats)"""


def score_ctes(query_table: str, name: str, condition: str = "true") -> str:
    """{name}: BM25 score of every query and document that share a term."""
    return f"""{name}_t AS (SELECT qid, term, count(*) AS qtf
  FROM (SELECT qid, unnest({terms('query')}) AS term FROM {query_table}) GROUP BY ALL),
{name} AS (SELECT qid, doc_id, source, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM {name}_t JOIN post USING (term) JOIN idf USING (term) JOIN lens USING (doc_id), stats
  WHERE {condition} GROUP BY ALL)"""


def padded_ctes(query_table: str, scores: str, name: str, k: int) -> str:
    """{name}: the best k documents per query over all documents, unmatched ones at score 0."""
    return f"""{name} AS (SELECT qid, rank, doc_id AS chunk_id, score FROM (
  SELECT qid, doc_id, coalesce(score, 0.0) AS score,
         row_number() OVER (PARTITION BY qid ORDER BY coalesce(score, 0.0) DESC, doc_id) AS rank
  FROM (SELECT qid, doc_id FROM {query_table}, documents) LEFT JOIN {scores} USING (qid, doc_id)) WHERE rank <= {k})"""


def hashed_ctes(query_table: str, name: str, k: int) -> str:
    """{name}: the best k documents per query by cosine of hashed term counts (needs docs, post)."""
    bucket = "('0x' || substr(md5(term), 1, 8))::BIGINT % 64"
    return f"""{name}_d AS (SELECT doc_id, {bucket} AS b, sum(tf)::DOUBLE AS v FROM post GROUP BY ALL),
{name}_dn AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM {name}_d GROUP BY doc_id),
{name}_q AS (SELECT qid, {bucket} AS b, count(*)::DOUBLE AS v
  FROM (SELECT qid, unnest({terms('query')}) AS term FROM {query_table}) GROUP BY ALL),
{name}_qn AS (SELECT qid, sqrt(sum(v * v)) AS norm FROM {name}_q GROUP BY qid),
{name} AS (SELECT qid, rank, doc_id AS chunk_id, score FROM (
  SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT q.qid, d.doc_id, round(sum(q.v * d.v) / any_value(qn.norm) / any_value(dn.norm), 6) AS score
    FROM {name}_q q JOIN {name}_d d USING (b) JOIN {name}_qn qn ON qn.qid = q.qid JOIN {name}_dn dn ON dn.doc_id = d.doc_id
    GROUP BY q.qid, d.doc_id)) WHERE rank <= {k})"""


def fused_ctes(keyword: str, vector: str, name: str, keyword_weight: str, vector_weight: str, k: int) -> str:
    return f"""{name} AS (SELECT qid, rank, chunk_id, score FROM (
  SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first) AS rank FROM (
    SELECT qid, chunk_id, round(sum(w), 6) AS score, min(src * 1000000 + rank) AS first FROM (
      SELECT qid, chunk_id, rank, 0 AS src, {keyword_weight} AS w FROM {keyword}
      UNION ALL SELECT qid, chunk_id, rank, 1 AS src, {vector_weight} AS w FROM {vector})
    GROUP BY ALL)) WHERE rank <= {k})"""


def relined(text: str, line: str) -> str:
    """Text with every line ``l`` (one-based number ``i``) replaced by the expression ``line``."""
    return joined(f"list_transform({lines(text)}, lambda l, i: {line})")


def line_ctes(source: str) -> str:
    return (
        f"ln AS (SELECT doc_id, unnest({lines('t')}) AS l, generate_subscripts({lines('t')}, 1) AS i FROM {source})"
    )


def island_ctes(source: str, head: str, drop_empty: bool, name: str = "isl") -> str:
    """{name}(doc_id, k, head, body): runs of lines after each head line, numbered per document."""
    kept = "WHERE n > 0" if drop_empty else ""
    return f"""{line_ctes(source)},
hd AS (SELECT *, coalesce({head}, false) AS h FROM ln),
gr AS (SELECT *, sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM hd),
raw AS (SELECT doc_id, g, max(CASE WHEN h THEN l END) AS head, count(*) - 1 AS n,
  coalesce(string_agg(l, {LF} ORDER BY i) FILTER (NOT h), '') AS body FROM gr WHERE g > 0 GROUP BY doc_id, g),
{name} AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) AS k, head, n, body FROM raw {kept})"""


def window_rows(source: str, text: str, columns: str, size: int, step: int) -> str:
    """Rows of token windows: the columns, c (zero-based), n tokens, body."""
    return f"""SELECT {columns}, c // {step} AS c, least({size}, len(tk) - c) AS n, array_to_string(tk[c + 1 : c + {size}], '') AS body
FROM (SELECT *, unnest(range(0, len(tk), {step})) AS c FROM (SELECT *, {pieces(text)} AS tk FROM {source}))"""


def identifier(slug: str, section: str, chunk: str, text: str) -> str:
    return f"format('{{}}_{{:02d}}_{{:03d}}_{{}}', {slug}, ({section})::BIGINT, ({chunk})::BIGINT, substr(md5({text}), 1, 7))"


def byte_pair_ctes(source: str, text: str, key: str, path: str) -> str:
    """tokens(key, p, id, h): the tokens of every text in order, h their bytes in hexadecimal. To be used in WITH RECURSIVE.

    The vocabulary file is read as a table. Words are merged step by step, the pair of lowest rank and then leftmost
    first. As this engine has no look-ahead, the last of several spaces before a word is marked off in advance.
    """
    space = r"[\s\x0b\x85\p{Z}]"
    other = r"[^\s\x0b\x85\p{Z}\p{L}\p{N}" + MARK + "]"
    pattern = rf"''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+| ?{other}+|{space}+"
    marked = rf"regexp_replace({text}, '({space})({space}[^\s\x0b\x85\p{{Z}}])', '\1{MARK}\2', 'g')"
    return f"""ranks AS (
  SELECT hex(from_base64(token)) AS h, rank FROM read_csv('{path}', delim=' ', header=false, quote='', escape='', columns={{'token': 'VARCHAR', 'rank': 'BIGINT'}})),
spelled AS (SELECT {key}, regexp_extract_all({marked}, '{pattern}') AS ws FROM {source}),
placed AS (SELECT {key}, unnest(ws) AS w, unnest(range(0, len(ws))) AS pos FROM spelled),
merging AS (
  SELECT w, list_transform(range(0, length(hex(encode(w))) // 2), lambda i: hex(encode(w))[2 * i + 1:2 * i + 2]) AS parts
  FROM (SELECT DISTINCT w FROM placed)
  UNION ALL
  SELECT w, parts[:i - 1] || [parts[i] || parts[i + 1]] || parts[i + 2:]
  FROM (
    SELECT w, parts, arg_min(i, rank * 1000000 + i) AS i
    FROM (SELECT w, parts, unnest(range(1, len(parts))) AS i FROM merging) JOIN ranks ON h = parts[i] || parts[i + 1]
    GROUP BY w, parts)),
words AS (SELECT w, arg_min(parts, len(parts)) AS parts FROM merging GROUP BY w),
tokens AS (
  SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY pos, j) - 1 AS p, rank AS id, h
  FROM (SELECT {key}, pos, unnest(parts) AS h, unnest(range(0, len(parts))) AS j FROM placed JOIN words USING (w)) JOIN ranks USING (h))"""


def characters_started(h: str) -> str:
    """Characters that start in bytes given in hexadecimal: all bytes but those of the form 10xxxxxx."""
    return f"len(list_filter(range(0, length({h}) // 2), lambda i: {h}[2 * i + 1:2 * i + 1] NOT IN ('8', '9', 'A', 'B')))"
