"""Query telemetry: roll-ups, distributions, recent activity and feedback.

All roll-ups are global aggregates with map-side partial sums, and recent lists are top-n plans, so neither
depends on how rows are spread over keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCORES = ("EXCELLENT", "ADEQUATE", "POOR")
# Latency bucket labels with their exclusive upper bounds in milliseconds.
LATENCY_BUCKETS = (("< 1s", 1000.0), ("1s - 2s", 2000.0), ("2s - 5s", 5000.0), ("5s - 10s", 10000.0), ("> 10s", None))
# Display labels of the judged scores.
SCORE_LABELS = {
    "EXCELLENT": "🟢 Excellent",
    "ADEQUATE": "🟡 Adequate",
    "POOR": "🔴 Poor",
    "NOT_JUDGED": "⚪ N/A",
}
UNTRACKED_PREFIX = "ephemeral_"
HISTORY_ROWS = 1000


def _rate(part: Column, whole: Column, digits: int) -> Column:
    return F.round(F.coalesce(part * F.lit(100.0) / F.nullif(whole, F.lit(0)), F.lit(0.0)), digits)


def trackable(metrics: DataFrame) -> DataFrame:
    """Rows that may be stored: nothing from an untracked session."""
    return metrics.where(~F.coalesce(F.col("query_id").startswith(UNTRACKED_PREFIX), F.lit(False)))


def normalised_score(score: Column) -> Column:
    """Known label in upper case, everything else NOT_JUDGED."""
    return F.when(F.upper(score).isin(*SCORES), F.upper(score)).otherwise(F.lit("NOT_JUDGED"))


def summary(metrics: DataFrame, digits: int = 2) -> DataFrame:
    """One row: counts, success rate, average latency, ratings. Every ratio is over the same rows."""
    total = F.count(F.lit(1))
    good = F.count_if(F.col("success"))
    return metrics.agg(
        total.alias("total_queries"),
        good.alias("success_count"),
        F.count_if(~F.col("success")).alias("error_count"),
        _rate(good, total, digits).alias("success_rate"),
        F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), digits).alias("avg_latency_ms"),
        F.count("user_rating").alias("rated_queries"),
        F.round(F.coalesce(F.avg("user_rating"), F.lit(0.0)), digits).alias("avg_rating"),
    )


def tool_usage(metrics: DataFrame) -> DataFrame:
    """Calls per tool, most used first."""
    return (
        metrics.select(F.explode("tool_calls").alias("tool"))
        .groupBy("tool")
        .agg(F.count(F.lit(1)).alias("calls"))
        .orderBy(F.desc("calls"), "tool")
    )


def judged_distribution(metrics: DataFrame, digits: int = 1) -> DataFrame:
    """Count and share of each label among the judged queries."""
    counts = (
        metrics.select(normalised_score(F.col("llm_relevance_score")).alias("score"))
        .where(F.col("score") != "NOT_JUDGED")
        .groupBy("score")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    judged = metrics.agg(F.count_if(normalised_score(F.col("llm_relevance_score")) != "NOT_JUDGED")).scalar()
    return counts.withColumn("percentage", _rate(F.col("count"), judged, digits))


def rating_distribution(metrics: DataFrame) -> DataFrame:
    """Count per star from 1 to 5, zeros included."""
    counted = [F.count_if(F.col("user_rating") == stars).alias(str(stars)) for stars in range(1, 6)]
    pairs = F.array(*[F.struct(F.lit(s).alias("stars"), F.col(str(s)).alias("count")) for s in range(1, 6)])
    return metrics.agg(*counted).select(F.inline(pairs))


def latency_bucket(latency: Column) -> Column:
    """Name of the bucket; null for a null latency."""
    label = F.when(latency.isNotNull(), F.lit(LATENCY_BUCKETS[-1][0]))
    for name, bound in reversed(LATENCY_BUCKETS[:-1]):
        label = F.when(latency < bound, F.lit(name)).otherwise(label)
    return label


def latency_buckets(metrics: DataFrame) -> DataFrame:
    """Queries per half-open latency bucket, zeros included, in one aggregate without a shuffle of rows."""
    label = latency_bucket(F.col("latency_ms"))
    counted = [F.count_if(label == name).alias(f"b{i}") for i, (name, _) in enumerate(LATENCY_BUCKETS)]
    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(name).alias("bucket"), F.col(f"b{i}").alias("count"))
            for i, (name, _) in enumerate(LATENCY_BUCKETS)
        ]
    )
    return metrics.agg(*counted).select(F.inline(pairs))


def retry_stats(metrics: DataFrame, digits: int = 2) -> DataFrame:
    """Retries tried, with and without results, and fallbacks to the model's own knowledge."""
    tried = F.count_if(F.col("retry_attempted"))
    worked = F.count_if(F.col("retry_attempted") & (F.coalesce("retry_results", F.lit(0)) > 0))
    failed = F.count_if(F.col("retry_attempted") & (F.coalesce("retry_results", F.lit(0)) == 0))
    return metrics.agg(
        tried.alias("total_retries"),
        worked.alias("successful_retries"),
        failed.alias("failed_retries"),
        F.count_if(F.col("fallback_to_context")).alias("fallback_to_context"),
        _rate(worked, tried, digits).alias("retry_success_rate"),
    )


def newest(metrics: DataFrame, limit: int) -> DataFrame:
    """The most recent rows; the identifier settles equal times."""
    return metrics.orderBy(F.desc("timestamp"), F.desc("query_id")).limit(limit)


def rating_label(rating: Column) -> Column:
    stars = F.concat(F.repeat(F.lit("⭐"), rating), F.lit(" ("), rating, F.lit("/5)"))
    return F.when(rating.isNull(), F.lit("○ Not rated")).otherwise(stars)


def score_label(score: Column) -> Column:
    label = F.lit(SCORE_LABELS["NOT_JUDGED"])
    for name in SCORES:
        label = F.when(score == name, F.lit(SCORE_LABELS[name])).otherwise(label)
    return label


def recent_queries(metrics: DataFrame, limit: int = 20) -> DataFrame:
    """Display rows of the newest queries."""
    return newest(metrics, limit).select(
        "query_id",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.left(F.col("query"), F.lit(80)).alias("query"),
        F.coalesce(F.nullif("book_slug", F.lit("")), F.lit("N/A")).alias("book"),
        F.round("latency_ms", 2).alias("latency_ms"),
        F.when(F.col("success"), F.lit("OK")).otherwise(F.lit("FAIL")).alias("success"),
        F.coalesce(F.nullif(F.array_join("tool_calls", ", "), F.lit("")), F.lit("None")).alias("tools"),
        score_label(F.col("llm_relevance_score")).alias("llm_score"),
        rating_label(F.col("user_rating")).alias("user_rating"),
    )


def recent_errors(metrics: DataFrame, window: int = 50, limit: int = 10) -> DataFrame:
    """The last failures among the newest queries."""
    return newest(newest(metrics, window).where(~F.col("success")), limit).select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.left(F.col("query"), F.lit(100)).alias("query"),
        F.col("error_message").alias("error"),
    )


def queries_per_slug(golden: DataFrame, slug: str = "slug") -> DataFrame:
    return golden.groupBy(slug).agg(F.count(F.lit(1)).alias("queries"))


def with_feedback(metrics: DataFrame, feedback: DataFrame) -> DataFrame:
    """Metrics with the latest rating and comment of each query; other rows keep theirs.

    ``feedback`` is ``(query_id, rating, comment, seq)``.
    """
    latest = feedback.groupBy("query_id").agg(F.max_by(F.struct("rating", "comment"), "seq").alias("_fb"))
    joined = metrics.join(latest, "query_id", "left")
    given = F.col("_fb").isNotNull()
    return (
        joined.withColumn("user_rating", F.when(given, F.col("_fb.rating")).otherwise(F.col("user_rating")))
        .withColumn("user_comment", F.when(given, F.col("_fb.comment")).otherwise(F.col("user_comment")))
        .drop("_fb")
    )


def one_per_query(metrics: DataFrame, order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """One row per ``query_id``: the facts of the first one by ``order``, rating and comment of the last one.

    That is what applying them one after the other gives. Rows that ``order`` leaves equal go by all their columns.
    """
    facts = [c for c in metrics.columns if c != "query_id"]
    rest = [c for c in facts if c not in order]
    row, at = F.struct(*facts), F.struct(*order, *rest)
    grouped = metrics.groupBy("query_id").agg(F.min_by(row, at).alias("_first"), F.max_by(row, at).alias("_last"))
    kept = {c: ("_last" if c in ("user_rating", "user_comment") else "_first") for c in facts}
    return grouped.select("query_id", *[F.col(f"{side}.{c}").alias(c) for c, side in kept.items()]).select(*metrics.columns)


def upserted(stored: DataFrame, incoming: DataFrame, order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """Insert new metrics; a known ``query_id`` only takes over rating and comment. A batch may repeat an id."""
    incoming = one_per_query(incoming, order)
    fresh = incoming.join(stored.select("query_id"), "query_id", "left_anti")
    patch = incoming.select("query_id", F.struct("user_rating", "user_comment").alias("_new"))
    kept = stored.join(patch, "query_id", "left")
    known = F.col("_new").isNotNull()
    kept = (
        kept.withColumn("user_rating", F.when(known, F.col("_new.user_rating")).otherwise(F.col("user_rating")))
        .withColumn("user_comment", F.when(known, F.col("_new.user_comment")).otherwise(F.col("user_comment")))
        .drop("_new")
    )
    return kept.unionByName(fresh)


def dashboard(metrics: DataFrame) -> dict[str, DataFrame]:
    """All roll-ups by name."""
    return {
        "summary": summary(metrics),
        "llm_assessment": judged_distribution(metrics),
        "user_feedback": rating_distribution(metrics),
        "tool_usage": tool_usage(metrics),
        "latency_distribution": latency_buckets(metrics),
        "recent_queries": recent_queries(metrics),
        "recent_errors": recent_errors(metrics),
    }


def dashboard_table(metrics: DataFrame) -> DataFrame:
    """The counting roll-ups as one tall table ``(panel, position, label, count)``."""
    ratings = rating_distribution(metrics).select(F.lit("ratings").alias("panel"), F.col("stars").alias("position"), F.col("stars").cast("string").alias("label"), "count")
    latency = latency_buckets(metrics).select(F.lit("latency").alias("panel"), "position", F.col("bucket").alias("label"), "count")
    judged = judged_distribution(metrics).select(F.lit("relevance").alias("panel"), F.lit(0).alias("position"), F.col("score").alias("label"), "count")
    tools = tool_usage(metrics).select(F.lit("tools").alias("panel"), F.lit(0).alias("position"), F.col("tool").alias("label"), F.col("calls").alias("count"))
    return ratings.unionByName(latency).unionByName(judged).unionByName(tools)


def display_retries(metrics: DataFrame, digits: int = 2) -> DataFrame:
    """``(position, metric, value)`` texts of the retry counts; no row if nothing was retried."""
    stats = retry_stats(metrics, digits).where(F.col("total_retries") > 0)
    text = lambda name: F.col(name).cast("string")
    worked = F.concat(text("successful_retries"), F.lit(" ("), F.format_string(f"%.{digits}f", "retry_success_rate"), F.lit("%)"))
    rows = (
        ("total retries", text("total_retries")),
        ("successful retries", worked),
        ("failed retries", text("failed_retries")),
        ("fallback to context", text("fallback_to_context")),
    )
    return stats.select(F.inline(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(m).alias("metric"), v.alias("value")) for i, (m, v) in enumerate(rows)])))


def display_latency(metrics: DataFrame) -> DataFrame:
    """``(position, range, count)`` of the latency buckets."""
    return latency_buckets(metrics).select("position", F.col("bucket").alias("range"), "count")


def display_errors(metrics: DataFrame) -> DataFrame:
    """The last five failures as lines of text, newest first."""
    errors = recent_errors(metrics, limit=5)
    return errors.select("timestamp", F.concat(F.lit("Query: "), "query", F.lit("\nError: "), "error").alias("line"))


def display_ratings(metrics: DataFrame) -> DataFrame:
    """Star labels with their counts, five stars first."""
    return rating_distribution(metrics).orderBy(F.desc("stars")).select(
        F.concat(F.repeat(F.lit("★"), F.col("stars")), F.lit(" ("), F.col("stars"), F.lit(")")).alias("rating"), "count"
    )
