"""Telemetry roll-ups. The events table plays the query metrics, by a fixed mapping of its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmine.operators import rollups
from shelfmine.operators import telemetry as tm
from shelfmine.plans.registry import register, table
from shelfmine.session import fresh_table_path


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    e, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        F.concat(F.when(e % 50 == 0, F.lit("ephemeral_")).otherwise(F.lit("q")), e.cast("string")).alias("query_id"),
        F.col("ts").alias("timestamp"),
        F.concat(kind, F.lit(" by user "), F.col("user_id").cast("string")).alias("query"),
        F.col("props").alias("response"),
        F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string"))).alias("book_slug"),
        (F.col("value") * 30).alias("latency_ms"),
        (kind != "error").alias("success"),
        F.when(kind == "error", F.concat(F.lit("failed with "), F.col("props"))).alias("error_message"),
        F.when(kind == "click", F.array().cast("array<string>"))
        .when(e % 3 == 0, F.array(F.lit("search_book"), kind))
        .otherwise(F.array(kind))
        .alias("tool_calls"),
        (e % 12).cast("int").alias("num_results"),
        F.when(e % 5 == 0, F.lit("EXCELLENT")).when(e % 5 == 1, F.lit("adequate")).when(e % 5 == 2, F.lit("POOR"))
        .when(e % 5 == 3, F.lit("unknown")).alias("llm_relevance_score"),
        F.when(e % 4 == 0, k % 5 + 1).alias("user_rating"),
        F.lit(None).cast("string").alias("user_comment"),
        (e % 6 == 0).alias("retry_attempted"),
        F.when((e % 6 == 0) & (e % 18 != 0), (e % 4).cast("int")).alias("retry_results"),
        ((e % 6 == 0) & (e % 4 == 0)).alias("fallback_to_context"),
    )


M = """m AS (SELECT CASE WHEN event_id % 50 = 0 THEN 'ephemeral_' ELSE 'q' END || event_id AS query_id, ts AS timestamp,
event_type || ' by user ' || user_id AS query, props AS response, CASE WHEN user_id % 7 <> 0 THEN 'src' || (user_id % 20) END AS book_slug,
value * 30 AS latency_ms, event_type <> 'error' AS success, CASE WHEN event_type = 'error' THEN 'failed with ' || props END AS error_message,
CASE WHEN event_type = 'click' THEN []::VARCHAR[] WHEN event_id % 3 = 0 THEN ['search_book', event_type] ELSE [event_type] END AS tool_calls,
CASE event_id % 5 WHEN 0 THEN 'EXCELLENT' WHEN 1 THEN 'ADEQUATE' WHEN 2 THEN 'POOR' ELSE 'NOT_JUDGED' END AS score,
CASE WHEN event_id % 4 = 0 THEN (props->>'k')::INT % 5 + 1 END AS user_rating, event_id % 6 = 0 AS retry_attempted,
CASE WHEN event_id % 6 = 0 AND event_id % 18 <> 0 THEN event_id % 4 END AS retry_results,
event_id % 6 = 0 AND event_id % 4 = 0 AS fallback_to_context, event_id FROM events)"""


@register(
    "metrics_summary",
    f"""WITH {M} SELECT count(*) AS total_queries, count(*) FILTER (success) AS success_count, count(*) FILTER (NOT success) AS error_count,
round(count(*) FILTER (success) * 100.0 / count(*), 6) AS success_rate, round(avg(latency_ms), 6) AS avg_latency_ms,
count(user_rating) AS rated_queries, round(avg(user_rating), 6) AS avg_rating FROM m""",
)
def metrics_summary(spark, folder):
    return tm.summary(metrics(spark, folder), digits=6)


@register("tracked_queries", f"WITH {M} SELECT query_id FROM m WHERE NOT starts_with(query_id, 'ephemeral_')")
def tracked_queries(spark, folder):
    return tm.trackable(metrics(spark, folder)).select("query_id")


@register("tool_usage", f"WITH {M} SELECT tool, count(*) AS calls FROM (SELECT unnest(tool_calls) AS tool FROM m) GROUP BY tool")
def tool_usage(spark, folder):
    return tm.tool_usage(metrics(spark, folder))


@register(
    "judged_distribution",
    f"""WITH {M} SELECT score, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percentage
FROM m WHERE score <> 'NOT_JUDGED' GROUP BY score""",
)
def judged_distribution(spark, folder):
    return tm.judged_distribution(metrics(spark, folder), digits=6)


@register(
    "rating_distribution",
    f"WITH {M} SELECT stars::INT AS stars, count(user_rating) AS count FROM range(1, 6) r(stars) LEFT JOIN m ON user_rating = stars GROUP BY stars",
)
def rating_distribution(spark, folder):
    return tm.rating_distribution(metrics(spark, folder))


@register(
    "latency_buckets",
    f"""WITH {M}, b AS (SELECT * FROM (VALUES (0, '< 1s', 0, 1000), (1, '1s - 2s', 1000, 2000), (2, '2s - 5s', 2000, 5000),
(3, '5s - 10s', 5000, 10000), (4, '> 10s', 10000, 1e18)) t(position, bucket, lo, hi))
SELECT position, bucket, count(latency_ms) AS count FROM b LEFT JOIN m ON event_id % 9 <> 0 AND latency_ms >= lo AND latency_ms < hi
GROUP BY position, bucket""",
)
def latency_buckets(spark, folder):
    """Every ninth latency is null and counts nowhere."""
    number = F.regexp_extract("query_id", r"(\d+)$", 1).cast("long")
    return tm.latency_buckets(metrics(spark, folder).withColumn("latency_ms", F.when(number % 9 != 0, F.col("latency_ms"))))


@register(
    "retry_stats",
    f"""WITH {M}, r AS (SELECT count(*) FILTER (retry_attempted) AS t, count(*) FILTER (retry_attempted AND retry_results > 0) AS g,
count(*) FILTER (retry_attempted AND coalesce(retry_results, 0) = 0) AS f, count(*) FILTER (fallback_to_context) AS c FROM m)
SELECT t AS total_retries, g AS successful_retries, f AS failed_retries, c AS fallback_to_context, round(g * 100.0 / t, 6) AS retry_success_rate FROM r""",
)
def retry_stats(spark, folder):
    return tm.retry_stats(metrics(spark, folder), digits=6)


@register(
    "recent_queries",
    f"""WITH {M} SELECT query_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, left(query, 80) AS query, coalesce(book_slug, 'N/A') AS book,
round(latency_ms, 2) AS latency_ms, CASE WHEN success THEN 'OK' ELSE 'FAIL' END AS success,
coalesce(nullif(array_to_string(tool_calls, ', '), ''), 'None') AS tools,
CASE score WHEN 'EXCELLENT' THEN '🟢 Excellent' WHEN 'POOR' THEN '🔴 Poor' WHEN 'ADEQUATE' THEN '🟡 Adequate' ELSE '⚪ N/A' END AS llm_score,
CASE WHEN user_rating IS NULL THEN '○ Not rated' ELSE repeat('⭐', user_rating) || ' (' || user_rating || '/5)' END AS user_rating
FROM m ORDER BY m.timestamp DESC, query_id DESC LIMIT 20""",
)
def recent_queries(spark, folder):
    rows = metrics(spark, folder).withColumn("llm_relevance_score", tm.normalised_score(F.col("llm_relevance_score")))
    return tm.recent_queries(rows)


@register(
    "recent_errors",
    f"""WITH {M} SELECT strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, left(query, 100) AS query, error_message AS error FROM (
SELECT * FROM (SELECT * FROM m ORDER BY m.timestamp DESC, query_id DESC LIMIT 50) WHERE NOT success ORDER BY timestamp DESC, query_id DESC LIMIT 10)""",
)
def recent_errors(spark, folder):
    return tm.recent_errors(metrics(spark, folder))


@register("history_window", f"WITH {M} SELECT query_id, latency_ms FROM m ORDER BY m.timestamp DESC, query_id DESC LIMIT 1000")
def history_window(spark, folder):
    return tm.newest(metrics(spark, folder), tm.HISTORY_ROWS).select("query_id", "latency_ms")


FEEDBACK_SQL = "fb AS (SELECT 'q' || doc_id AS query_id, quality * 4 + 1 AS rating, 'toxic ' || toxic AS comment FROM labels)"


@register(
    "feedback_update",
    f"""WITH {M}, {FEEDBACK_SQL} SELECT query_id, coalesce(rating, user_rating)::INT AS user_rating, comment AS user_comment
FROM m LEFT JOIN fb USING (query_id)""",
)
def feedback_update(spark, folder):
    given = table(spark, folder, "labels").select(
        F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("query_id"),
        (F.col("quality") * 4 + 1).alias("rating"),
        F.concat(F.lit("toxic "), F.col("toxic").cast("string")).alias("comment"),
        F.col("doc_id").alias("seq"),
    )
    return tm.with_feedback(metrics(spark, folder), given).select("query_id", "user_rating", "user_comment")


@register(
    "metric_upsert",
    f"""WITH {M} SELECT query_id, latency_ms, CASE WHEN event_id % 3 = 0 THEN 3 ELSE user_rating END AS user_rating FROM m
UNION ALL SELECT 'new' || query_id, latency_ms, 3 FROM m WHERE event_id % 3 = 1""",
)
def metric_upsert(spark, folder):
    stored = metrics(spark, folder)
    number = F.regexp_extract("query_id", r"(\d+)$", 1).cast("long")
    known = stored.where(number % 3 == 0).withColumn("latency_ms", F.lit(0.0))
    fresh = stored.where(number % 3 == 1).withColumn("query_id", F.concat(F.lit("new"), "query_id"))
    incoming = known.unionByName(fresh).withColumn("user_rating", F.lit(5))
    # every id comes again an hour later: the facts of the first row and the rating of the last one count
    again = incoming.withColumns(
        {"user_rating": F.lit(3), "latency_ms": F.lit(-1.0), "timestamp": F.expr("timestamp + interval 1 hour")}
    )
    incoming = incoming.unionByName(again)
    return tm.upserted(stored, incoming).select("query_id", "latency_ms", "user_rating")


@register(
    "display_ratings",
    f"""WITH {M} SELECT repeat('★', stars::INT) || ' (' || stars || ')' AS rating, count(user_rating) AS count
FROM range(1, 6) r(stars) LEFT JOIN m ON user_rating = stars GROUP BY stars""",
)
def display_ratings(spark, folder):
    return tm.display_ratings(metrics(spark, folder))


BUCKETS_SQL = """(VALUES (0, '< 1s', 0, 1000), (1, '1s - 2s', 1000, 2000), (2, '2s - 5s', 2000, 5000),
(3, '5s - 10s', 5000, 10000), (4, '> 10s', 10000, 1e18)) t(position, label, lo, hi)"""


@register(
    "dashboard_table",
    f"""WITH {M}
SELECT 'ratings' AS panel, stars::INT AS position, stars::VARCHAR AS label, count(user_rating) AS count
FROM range(1, 6) r(stars) LEFT JOIN m ON user_rating = stars GROUP BY stars
UNION ALL SELECT 'latency', position, label, count(latency_ms) FROM {BUCKETS_SQL} LEFT JOIN m ON latency_ms >= lo AND latency_ms < hi GROUP BY position, label
UNION ALL SELECT 'relevance', 0, score, count(*) FROM m WHERE score <> 'NOT_JUDGED' GROUP BY score
UNION ALL SELECT 'tools', 0, tool, count(*) FROM (SELECT unnest(tool_calls) AS tool FROM m) GROUP BY tool""",
)
def dashboard_table(spark, folder):
    return tm.dashboard_table(metrics(spark, folder))


@register(
    "display_retries",
    f"""WITH {M}, r AS (SELECT count(*) FILTER (retry_attempted) AS t, count(*) FILTER (retry_attempted AND retry_results > 0) AS g,
count(*) FILTER (retry_attempted AND coalesce(retry_results, 0) = 0) AS f, count(*) FILTER (fallback_to_context) AS c FROM m)
SELECT unnest([0, 1, 2, 3])::INT AS position, unnest(['total retries', 'successful retries', 'failed retries', 'fallback to context']) AS metric,
unnest([t::VARCHAR, g || ' (' || printf('%.2f', round(g * 100.0 / t, 2)) || '%)', f::VARCHAR, c::VARCHAR]) AS value FROM r WHERE t > 0""",
)
def display_retries(spark, folder):
    return tm.display_retries(metrics(spark, folder))


@register(
    "display_latency",
    f"""WITH {M} SELECT position, label AS range, count(latency_ms) AS count FROM {BUCKETS_SQL}
LEFT JOIN m ON latency_ms >= lo AND latency_ms < hi GROUP BY position, label""",
)
def display_latency(spark, folder):
    return tm.display_latency(metrics(spark, folder))


@register(
    "display_errors",
    f"""WITH {M} SELECT strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp,
'Query: ' || left(query, 100) || chr(10) || 'Error: ' || error_message AS line FROM (
SELECT * FROM (SELECT * FROM m ORDER BY m.timestamp DESC, query_id DESC LIMIT 50) WHERE NOT success ORDER BY timestamp DESC, query_id DESC LIMIT 5)""",
)
def display_errors(spark, folder):
    return tm.display_errors(metrics(spark, folder))


def _rolled_up(spark: SparkSession, folder: str) -> rollups.Rollups:
    """The metrics in three batches. The later ones repeat queries of the earlier ones, some with another rating; only the rating counts."""
    rows, number = metrics(spark, folder), F.regexp_extract("query_id", r"(\d+)$", 1).cast("long")
    store = rollups.Rollups(spark, fresh_table_path(spark, "rollups"))
    later = lambda given, stars: given.withColumns({"user_rating": F.lit(stars), "latency_ms": F.lit(-1.0), "success": F.lit(True)})
    store.add(rows.where(number % 3 != 1), 0)
    store.add(rows.where(number % 3 == 1).unionByName(later(rows.where(number % 6 == 0), 2)), 1)
    store.add(later(rows.where(number % 4 == 1), None).unionByName(later(rows.where(number % 12 == 0), 5)), 2)
    return store


# event_id % 12 = 0: rated 2, then 5; other event_id % 6 = 0: rated 2; event_id % 4 = 1: the rating is taken back
ROLLED = f"""{M}, t AS (SELECT * REPLACE (CASE WHEN event_id % 12 = 0 THEN 5 WHEN event_id % 6 = 0 THEN 2 WHEN event_id % 4 = 1 THEN NULL
ELSE user_rating END AS user_rating) FROM m WHERE NOT starts_with(query_id, 'ephemeral_'))"""


@register(
    "dashboard_incremental",
    f"""WITH {ROLLED}
SELECT 'ratings' AS panel, stars::INT AS position, stars::VARCHAR AS label, count(user_rating) AS count
FROM range(1, 6) r(stars) LEFT JOIN t ON user_rating = stars GROUP BY stars
UNION ALL SELECT 'latency', position, label, count(latency_ms) FROM {BUCKETS_SQL} LEFT JOIN t ON latency_ms >= lo AND latency_ms < hi GROUP BY position, label
UNION ALL SELECT 'relevance', 0, score, count(*) FROM t WHERE score <> 'NOT_JUDGED' GROUP BY score
UNION ALL SELECT 'tools', 0, tool, count(*) FROM (SELECT unnest(tool_calls) AS tool FROM t) GROUP BY tool""",
)
def dashboard_incremental(spark, folder):
    store = _rolled_up(spark, folder)
    return rollups.dashboard_table(store.counts(), store.tools())


@register(
    "hourly_slug_counts",
    f"""WITH {ROLLED} SELECT date_trunc('hour', timestamp)::TIMESTAMP AS hour, book_slug AS slug, count(*) AS total, count(*) FILTER (success) AS good,
count(user_rating) AS rated, coalesce(sum(user_rating), 0)::BIGINT AS rating, round(sum(latency_ms), 4) AS latency FROM t GROUP BY 1, 2""",
)
def hourly_slug_counts(spark, folder):
    """Counts per hour and slug after three batches."""
    names = ("total", "good", "rated", "rating")
    merged = _rolled_up(spark, folder).counts().groupBy("hour", "slug")
    return merged.agg(*[F.sum(n).alias(n) for n in names], F.round(F.sum("latency"), 4).alias("latency"))
