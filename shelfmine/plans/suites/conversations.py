"""Turns, packing, history and diversified results over the conversations table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmine.functions import text as tx
from shelfmine.operators import diversify as dv
from shelfmine.operators import lexical, packing, parsers
from shelfmine.plans import sqltext as sq
from shelfmine.plans.registry import register, table
from shelfmine.plans.suites.parsing import md5, packing_ctes
from shelfmine.plans.suites.retrieval import benchmark_queries

LF = sq.LF


def turns(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    line = parsers.rendered_turn(F.col("role"), F.lit(None).cast("string"), F.col("text"))
    return rows.select("conv_id", "turn", "role", "text", F.size(tx.pieces(F.col("text"))).alias("tok"), line.alias("line"))


TURNS = f"tl AS (SELECT conv_id, turn, role, text, len({sq.pieces('text')}) AS tok, role || ': ' || text AS line FROM conversations)"


@register("turn_render", f"WITH {TURNS} SELECT conv_id, turn, line, tok AS tokens FROM tl")
def turn_render(spark, folder):
    return turns(spark, folder).select("conv_id", "turn", "line", F.col("tok").cast("long").alias("tokens"))


@register(
    "conversation_profile",
    f"""WITH {TURNS} SELECT conv_id, array_to_string(list_sort(list(DISTINCT role)), '|') AS speakers, count(*) AS turns,
sum(tok)::BIGINT AS tokens, arg_min(role, turn) AS first_speaker FROM tl GROUP BY conv_id""",
)
def conversation_profile(spark, folder):
    return turns(spark, folder).groupBy("conv_id").agg(
        F.array_join(F.array_sort(F.collect_set("role")), "|").alias("speakers"),
        F.count(F.lit(1)).alias("turns"),
        F.sum("tok").alias("tokens"),
        F.min_by("role", "turn").alias("first_speaker"),
    )


PACKED = f"WITH RECURSIVE {TURNS}, {packing_ctes('tl', 'conv_id', 120, 2)} SELECT conv_id, section, turn_start, turn_end, num_turns, num_tokens, md5(text) AS digest FROM packed"


def _packed(spark: SparkSession, folder: str, **options) -> DataFrame:
    rows = packing.pack_turns(turns(spark, folder), "conv_id", "turn", "tok", "line", 120, 2, **options)
    return rows.select("conv_id", "section", "turn_start", "turn_end", "num_turns", "num_tokens", md5("text").alias("digest"))


@register("turn_packing", PACKED)
def turn_packing(spark, folder):
    return _packed(spark, folder)


@register("turn_packing_spread", PACKED)
def turn_packing_spread(spark, folder):
    """All conversations by the set-wise route that is meant for very large ones."""
    return _packed(spark, folder, row_turns=0)


# the turns of one conversation have no identifier: a null group is a group like others
LOOSE_SQL = "loose AS (SELECT * REPLACE (nullif(conv_id, 7) AS conv_id) FROM tl)"


def _loose(spark: SparkSession, folder: str) -> DataFrame:
    return turns(spark, folder).withColumn("conv_id", F.nullif("conv_id", F.lit(7)))


@register(
    "fixed_turn_windows",
    f"""WITH {TURNS}, {LOOSE_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, count(*) OVER (PARTITION BY conv_id) AS c FROM loose),
w AS (SELECT conv_id, unnest(range(0, max(c), 3)) AS s FROM n GROUP BY conv_id)
SELECT n.conv_id, s // 3 + 1 AS section, count(*) AS num_turns, md5(string_agg(line, {LF} ORDER BY turn)) AS digest
FROM w JOIN n ON w.conv_id IS NOT DISTINCT FROM n.conv_id WHERE p >= s AND p < s + 4 GROUP BY n.conv_id, s""",
)
def fixed_turn_windows(spark, folder):
    rows = packing.fixed_turn_windows(_loose(spark, folder), "conv_id", "turn", "line", size=4, overlap=1)
    return rows.select("conv_id", "section", "num_turns", md5("text").alias("digest"))


@register(
    "history_truncate",
    f"""WITH {TURNS}, {LOOSE_SQL}, s AS (SELECT *, (role = 'system' AND turn = 0) AS head,
  max(turn) FILTER (NOT (role = 'system' AND turn = 0)) OVER (PARTITION BY conv_id) AS newest,
  coalesce(sum(tok) FILTER (role = 'system' AND turn = 0) OVER (PARTITION BY conv_id), 0) AS sys,
  sum(tok) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tail FROM loose)
SELECT conv_id, turn, role FROM s WHERE head OR turn = newest OR tail + sys <= 150""",
)
def history_truncate(spark, folder):
    head = (F.col("role") == "system") & (F.col("turn") == 0)
    kept = packing.kept_history(_loose(spark, folder), "conv_id", "turn", F.col("tok"), head, budget=150)
    return kept.select("conv_id", "turn", "role")


# ---------------------------------------------------------------- search results over turns

STAMP_SQL = """CASE WHEN turn = 5 THEN NULL WHEN turn = 4 THEN 'soon'
ELSE '2024-01-' || lpad((1 + conv_id % 5)::VARCHAR, 2, '0') || ' 10:' || lpad((turn * 3)::VARCHAR, 2, '0') || CASE WHEN turn = 1 THEN '' ELSE ':30' END END"""
WHEN_SQL = """CASE WHEN turn < 4 OR turn > 5 THEN make_timestamp(2024, 1, 1 + conv_id % 5, 10, turn * 3, CASE WHEN turn = 1 THEN 0 ELSE 30 END) END"""


def stamp():
    day = F.lpad((1 + F.col("conv_id") % 5).cast("string"), 2, "0")
    minute = F.lpad((F.col("turn") * 3).cast("string"), 2, "0")
    seconds = F.when(F.col("turn") == 1, F.lit("")).otherwise(F.lit(":30"))
    return (
        F.when(F.col("turn") == 5, F.lit(None).cast("string"))
        .when(F.col("turn") == 4, F.lit("soon"))
        .otherwise(F.concat(F.lit("2024-01-"), day, F.lit(" 10:"), minute, seconds))
    )


def turn_results(spark: SparkSession, folder: str, k: int = 15) -> DataFrame:
    """Best turns of every benchmark passage, with speaker and time."""
    rows = table(spark, folder, "conversations").withColumn("chunk_id", F.col("conv_id") * 1000 + F.col("turn"))
    index = lexical.build_index(rows.withColumn("slug", F.col("role")))
    found = lexical.bm25_topk(benchmark_queries(spark, folder), index, k, pad=False)
    detail = rows.select(
        "chunk_id",
        F.when(F.col("role") != "system", F.col("role")).alias("speaker"),
        stamp().alias("timestamp"),
        F.lit("conversation").alias("doc_type"),
    )
    return found.join(detail, "chunk_id").withColumn("ts", tx.parse_timestamp(F.col("timestamp")))


RESULTS = f"""q AS (SELECT item_id AS qid, text AS query FROM benchmark),
documents AS (SELECT conv_id * 1000 + turn AS doc_id, role AS source, text FROM conversations),
{sq.index_ctes()}, {sq.score_ctes('q', 's')},
found AS (SELECT qid, doc_id AS chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 15),
res AS (SELECT qid, chunk_id, rank, nullif(role, 'system') AS speaker, {WHEN_SQL} AS ts
  FROM found JOIN conversations ON conv_id * 1000 + turn = chunk_id)"""


@register(
    "speaker_cap",
    f"""WITH {RESULTS} SELECT qid, rank, speaker FROM (SELECT *, row_number() OVER (PARTITION BY qid, speaker ORDER BY rank) AS n FROM res)
WHERE n <= 2 OR speaker IS NULL""",
)
def speaker_cap(spark, folder):
    return dv.speaker_cap(turn_results(spark, folder)).select("qid", "rank", "speaker")


def fold_ctes(cap: int, gap: int) -> str:
    over = f"coalesce(len(list_filter(f.charged, lambda c: c = i.speaker)) >= {cap}, false) AND i.speaker IS NOT NULL"
    near = f"coalesce(abs(epoch_us(i.ts) - epoch_us(f.last)) < {gap} * 1000000, false)"
    return f"""items AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ts NULLS LAST, rank) AS p, count(*) OVER (PARTITION BY qid) AS n FROM res),
fold AS (SELECT DISTINCT qid, 0::BIGINT AS p, n, []::BIGINT[] AS picked, []::VARCHAR[] AS charged, NULL::TIMESTAMP AS last FROM items
  UNION ALL SELECT f.qid, i.p, f.n, CASE WHEN {over} OR {near} THEN f.picked ELSE list_append(f.picked, i.rank) END,
    CASE WHEN {over} OR i.speaker IS NULL THEN f.charged ELSE list_append(f.charged, i.speaker) END,
    CASE WHEN {over} OR {near} THEN f.last ELSE i.ts END
  FROM fold f JOIN items i ON i.qid = f.qid AND i.p = f.p + 1),
done AS (SELECT qid, CASE WHEN n <= 3 THEN range(1, n + 1) ELSE picked[:greatest(5, n // 2)] END AS kept FROM fold WHERE p = n)"""


def _fold_sql(cap: int, gap: int) -> str:
    return f"WITH RECURSIVE {RESULTS}, {fold_ctes(cap, gap)} SELECT qid, unnest(kept) AS rank, generate_subscripts(kept, 1) AS position FROM done"


def _spread(spark: SparkSession, folder: str, gap: int, cap: int) -> DataFrame:
    rows = dv.diversify(turn_results(spark, folder), gap, cap)
    return rows.select("qid", F.col("rank").cast("long").alias("rank"), F.col("position").cast("long").alias("position"))


@register("time_gap_select", _fold_sql(1000, 300))
def time_gap_select(spark, folder):
    return _spread(spark, folder, 300, 1000)


@register("diversify", _fold_sql(2, 300))
def diversify(spark, folder):
    return _spread(spark, folder, 300, 2)


@register(
    "timestamp_parse",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('minute', ts)
WHEN 2 THEN date_trunc('day', ts)::TIMESTAMP END AS parsed FROM events""",
)
def timestamp_parse(spark, folder):
    kind = F.col("event_id") % 5
    text = (
        F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(kind == 1, F.date_format("ts", "yyyy-MM-dd HH:mm"))
        .when(kind == 2, F.date_format("ts", "yyyy-MM-dd"))
        .when(kind == 3, F.lit("last Tuesday"))
    )
    return table(spark, folder, "events").select("event_id", tx.parse_timestamp(text).alias("parsed"))
