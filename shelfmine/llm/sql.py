"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations


def _repeated(window: int, name: str) -> str:
    """Words per row that lie in windows of ``window`` words found twice or more in the text."""
    return f"""
{name}_grams AS (
  SELECT rn, i, count(*) OVER (PARTITION BY rn, gram) AS n
  FROM (SELECT rn, i, array_to_string(ws[i:i + {window - 1}], ' ') AS gram
        FROM (SELECT rn, ws, unnest(range(1, len(ws) - {window - 2})) AS i FROM words))),
{name} AS (
  SELECT rn, count(DISTINCT p) AS n FROM (SELECT rn, unnest(range(i, i + {window})) AS p FROM {name}_grams WHERE n > 1) GROUP BY rn)"""


QUALITY = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rn FROM documents),
words AS (
  SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM texts),
{_repeated(8, "eight")},
{_repeated(5, "five")},
{_repeated(101, "long")},
counts AS (
  SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(eight.n, 0) AS n_repeat_words, coalesce(five.n, 0) AS covered_words, coalesce(long.n, 0) AS too_long
  FROM words LEFT JOIN eight USING (rn) LEFT JOIN five USING (rn) LEFT JOIN long USING (rn)),
failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, base_failed,
  NOT base_failed AND covered_words <= 0.3 * n_words AND too_long = 0 AS kept
FROM failed
"""


def _escaped_length(column: str) -> str:
    """Length with one more character for each escape and each control string."""
    # The control strings of the template, as in chat.Template.
    controls = (
        "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
        "<|endoftext|>", "<|user|>", "<|assistant|>", "<|system|>", "\\",
    )
    more = " + ".join(f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in controls)
    return f"length({column}) + {more}"


CHAT = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS bigint) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len("<|im_start|><|im_sep|><|im_end|>")} + {_escaped_length("role")} + {_escaped_length("t")}) AS bigint) AS formatted_chars
FROM turns GROUP BY conv_id
"""


TOP_K = """
WITH vectors AS (
  SELECT vec_id, row_number() OVER () AS rn, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS double)) AS bigint)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, rn, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vectors),
scores AS (
  SELECT q.rn AS query, q.vec_id AS query_id, c.rn, c.vec_id, CAST(sum(q.x * c.x) AS bigint) AS score
  FROM parts q JOIN parts c ON q.i = c.i AND q.rn <> c.rn WHERE q.vec_id % 100 = 0 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scores)
SELECT query_id, CAST(rank AS integer) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""


JACCARD = r"""
WITH RECURSIVE rows AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
nodes AS (
  SELECT t, row_number() OVER () AS node, count(*) AS copies,
    list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM rows GROUP BY t),
shingles AS (
  SELECT DISTINCT node, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT node, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM nodes WHERE len(ws) > 0)),
sizes AS (SELECT node, count(*) AS n FROM shingles GROUP BY node),
common AS (SELECT a.node AS x, b.node AS y, count(*) AS n FROM shingles a JOIN shingles b USING (s) WHERE a.node < b.node GROUP BY ALL),
pairs AS (
  SELECT x, y FROM common JOIN sizes a ON a.node = x JOIN sizes b ON b.node = y WHERE 5 * common.n >= 4 * (a.n + b.n - common.n)),
links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (SELECT node AS x, node AS y FROM sizes UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
classes AS (
  SELECT reach.x AS node, min(rows.doc_id) AS class_id
  FROM reach JOIN nodes ON nodes.node = reach.y JOIN rows USING (t) GROUP BY ALL),
counts AS (
  SELECT links.x AS node, sum(nodes.copies) AS n FROM links JOIN nodes ON nodes.node = links.y GROUP BY ALL)
SELECT doc_id, CASE WHEN len(ws) = 0 THEN doc_id ELSE class_id END AS class_id,
  CAST(CASE WHEN len(ws) = 0 THEN 0 ELSE copies - 1 + coalesce(counts.n, 0) END AS bigint) AS n_links
FROM rows JOIN nodes USING (t) LEFT JOIN classes USING (node) LEFT JOIN counts USING (node)
"""


NEAR = r"""
WITH RECURSIVE rows AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
nodes AS (
  SELECT t, row_number() OVER () AS node, min(doc_id) AS first,
    list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM rows GROUP BY t),
shingles AS (
  SELECT DISTINCT node, array_to_string(ws[i:i + 3], ' ') AS s
  FROM (SELECT node, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM nodes WHERE len(ws) > 0)),
sizes AS (SELECT node, count(*) AS n FROM shingles GROUP BY node),
common AS (SELECT a.node AS x, b.node AS y, count(*) AS n FROM shingles a JOIN shingles b USING (s) WHERE a.node < b.node GROUP BY ALL),
pairs AS (
  SELECT x, y FROM common JOIN sizes a ON a.node = x JOIN sizes b ON b.node = y WHERE 100 * common.n >= 80 * (a.n + b.n - common.n)),
links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (SELECT node AS x, node AS y FROM sizes UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
components AS (SELECT reach.x AS node, min(nodes.first) AS component_id FROM reach JOIN nodes ON nodes.node = reach.y GROUP BY ALL),
named AS (
  SELECT doc_id, coalesce(n, 0) AS n_shingles, CASE WHEN len(ws) = 0 THEN doc_id ELSE component_id END AS component_id
  FROM rows JOIN nodes USING (t) LEFT JOIN sizes USING (node) LEFT JOIN components USING (node))
SELECT *, doc_id IS NOT DISTINCT FROM component_id AS kept FROM named
"""


def _crc32(text: str) -> str:
    """Unsigned checksum of a text of ASCII characters, bit by bit; fixed value: the polynomial 0xEDB88320."""
    step = "lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    codes = f"list_prepend(4294967295, list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii({text}[i]) AS bigint)))"
    return f"xor(list_reduce({codes}, lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], {step})), 4294967295)"


# six words in a row match on the diagonal of every run, so diagonals are joined on these
PERIODS = rf"""
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS rn, {_crc32("coalesce(CAST(doc_id AS varchar), 'null')")} AS h,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM documents),
places AS (SELECT *, h // 10 AS g, len(ws) AS n FROM texts),
ends AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM places),
periods AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM ends),
docs AS (
  SELECT doc_id, rn, CASE WHEN a IS NULL THEN ws
    ELSE ws[:a] || list_transform(range(a, n), lambda i: ws[a + (i - a) % p + 1]) END AS ws
  FROM periods),
grams AS (
  SELECT rn, i, array_to_string(ws[i + 1:i + 6], ' ') AS gram
  FROM (SELECT rn, ws, unnest(range(0, len(ws) - 5)) AS i FROM docs)),
matches AS (SELECT x.rn, x.i, x.i - y.i AS q FROM grams x JOIN grams y ON x.rn = y.rn AND x.gram = y.gram AND x.i > y.i),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY rn, q ORDER BY i) AS island FROM matches),
diagonals AS (SELECT rn, q, min(i) - q AS start, count(*) + 5 + q AS length FROM islands GROUP BY rn, q, island),
runs AS (SELECT rn, start, length, min(q) AS period FROM diagonals WHERE length >= greatest(12, 2 * q) GROUP BY ALL),
listed AS (
  SELECT rn, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
    first(struct_pack(start := start, length := length, period := period) ORDER BY length DESC, start, period) AS best
  FROM runs GROUP BY rn),
gone AS (SELECT DISTINCT rn, unnest(range(start + period, start + length)) AS i FROM runs),
words AS (SELECT rn, unnest(range(0, len(ws))) AS i, unnest(ws) AS w FROM docs WHERE rn IN (SELECT rn FROM listed)),
kept AS (SELECT rn, string_agg(w, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (rn, i) GROUP BY rn)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.start AS bigint) AS start, CAST(best.length AS bigint) AS length,
  CAST(best.period AS bigint) AS period, CAST(1000 * best.length // best.period AS bigint) AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256,
  sha256(CASE WHEN n_runs IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(t, '') END) AS collapsed_sha256
FROM docs LEFT JOIN listed USING (rn) LEFT JOIN kept USING (rn)
"""
