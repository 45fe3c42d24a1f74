"""Telemetry roll-ups that are kept up to date by batches.

A batch of metrics is reduced to counts per hour and slug, calls per hour, slug and tool, and its newest rows. All of these
merge by adding or by taking the newest, so the dashboard reads some rows per hour and never the metrics again. A query that
comes again changes its rating only: the batch then counts the old rating with weight -1 and the new one with weight 1.

Every batch writes folders of its own number, and looks at batches of smaller numbers only. A batch that is done again after
a failure overwrites itself with the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmine.operators import telemetry as tm
from shelfmine.session import cut_lineage, drop_steps

STARS = range(1, 6)
KEYS = ("hour", "slug")


def _counters() -> dict[str, Column]:
    """What a metric row adds to the counts of its hour and slug, by name. Unknown values add nothing."""
    one = lambda condition: F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("long")
    score, bucket = tm.normalised_score(F.col("llm_relevance_score")), tm.latency_bucket(F.col("latency_ms"))
    tried, found = F.col("retry_attempted"), F.coalesce("retry_results", F.lit(0))
    return {
        "total": F.lit(1).cast("long"),
        "good": one(F.col("success")),
        "bad": one(~F.col("success")),
        "timed": one(F.col("latency_ms").isNotNull()),
        "latency": F.coalesce(F.col("latency_ms").cast("double"), F.lit(0.0)),
        **{f"bucket_{i}": one(bucket == name) for i, (name, _) in enumerate(tm.LATENCY_BUCKETS)},
        **{f"score_{name}": one(score == name) for name in tm.SCORES},
        "retries": one(tried),
        "retries_worked": one(tried & (found > 0)),
        "retries_failed": one(tried & (found == 0)),
        "fallbacks": one(F.col("fallback_to_context")),
        **_rating_counters(F.col("user_rating")),
    }


def _rating_counters(rating: Column) -> dict[str, Column]:
    one = lambda condition: F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("long")
    return {
        "rated": one(rating.isNotNull()),
        "rating": F.coalesce(rating.cast("long"), F.lit(0).cast("long")),
        **{f"stars_{s}": one(rating == s) for s in STARS},
    }


def _place() -> list[Column]:
    return [F.date_trunc("hour", "timestamp").alias("hour"), F.col("book_slug").alias("slug")]


def counts_of(metrics: DataFrame) -> DataFrame:
    """One row of counts per hour and slug. Null timestamps and slugs are groups of their own."""
    values = _counters()
    return metrics.select(*_place(), *[v.alias(n) for n, v in values.items()]).groupBy(*KEYS).agg(*[F.sum(n).alias(n) for n in values])


def tools_of(metrics: DataFrame) -> DataFrame:
    """Calls per hour, slug and tool."""
    return metrics.select(*_place(), F.explode("tool_calls").alias("tool")).groupBy(*KEYS, "tool").agg(F.count(F.lit(1)).alias("calls"))


def rating_changes(changed: DataFrame) -> DataFrame:
    """Counts that take the old rating back and add the new one, for ``changed(hour, slug, old_rating, user_rating)``."""
    old, new = _rating_counters(F.col("old_rating")), _rating_counters(F.col("user_rating"))
    rows = changed.select(*KEYS, *[(new[n] - old[n]).alias(n) for n in new])
    return rows.groupBy(*KEYS).agg(*[F.sum(n).alias(n) for n in new])


@dataclass(frozen=True)
class Rollups:
    """Roll-ups below ``folder``: ``counts``, ``tools``, ``recent`` and ``known`` (id, place and rating of every query), by batch.

    Rows of untracked sessions are never stored. Rows with a null ``query_id`` are one query per batch, and never a known one.
    """

    spark: SparkSession
    folder: str

    def _path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}"

    def _read(self, name: str, schema: str) -> DataFrame:
        """All batches of a table; no rows before the first batch."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
        files = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not files.exists(path):
            return self.spark.createDataFrame([], schema + ", batch long")
        return self.spark.read.schema(schema + ", batch long").parquet(self._path(name))

    def _write(self, rows: DataFrame, name: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(self._path(f"{name}/batch={number}"))

    def add(self, metrics: DataFrame, number: int, order: tuple[str, ...] = ("timestamp",)) -> None:
        """Add a batch. It may repeat an id, and hold ids of earlier batches; these only take over the rating.

        Only ids, places and ratings of earlier queries are read, not their metrics. Rows may be late by any time.
        """
        batch = cut_lineage(tm.one_per_query(tm.trackable(metrics), order), "batch")
        earlier = self._read("known", KNOWN).where(F.col("batch") < number)
        # ids of the batch find their last rating: a join by id, then one row per id
        stored = earlier.join(batch.select("query_id"), "query_id", "left_semi").groupBy("query_id")
        stored = stored.agg(F.max_by(F.struct("hour", "slug", F.col("user_rating").alias("old_rating")), "batch").alias("_old"))
        marked = cut_lineage(batch.join(stored, "query_id", "left"), "marked")
        fresh = marked.where(F.col("_old").isNull()).drop("_old")
        changed = marked.where(F.col("_old").isNotNull()).select("query_id", "_old.*", "user_rating", "user_comment")
        changed = changed.withColumn("user_rating", F.col("user_rating").cast("int"))
        known = fresh.select("query_id", *_place(), F.col("user_rating").cast("int").alias("user_rating"))
        self._write(known.unionByName(changed.select("query_id", *KEYS, "user_rating")), "known", number)
        self._write(counts_of(fresh).unionByName(rating_changes(changed), allowMissingColumns=True), "counts", number)
        self._write(tools_of(fresh), "tools", number)
        # the newest rows of all batches are among the newest of each; a changed one is looked up again when it is shown
        self._write(tm.newest(fresh, tm.HISTORY_ROWS), "recent", number)
        drop_steps(batch, marked)

    def counts(self, since=None, until=None, slug: str | None = None) -> DataFrame:
        """Stored counts, one row per batch, hour and slug; from ``since`` on, before ``until``."""
        types = {n: "double" if n == "latency" else "long" for n in _counters()}
        return self._between("counts", "hour timestamp, slug string, " + ", ".join(f"{n} {t}" for n, t in types.items()), since, until, slug)

    def tools(self, since=None, until=None, slug: str | None = None) -> DataFrame:
        return self._between("tools", "hour timestamp, slug string, tool string, calls long", since, until, slug)

    def _between(self, name: str, schema: str, since, until, slug: str | None) -> DataFrame:
        rows = self._read(name, schema)
        if since is not None:
            rows = rows.where(F.col("hour") >= F.lit(since))
        if until is not None:
            rows = rows.where(F.col("hour") < F.lit(until))
        return rows if slug is None else rows.where(F.col("slug") == slug)

    def recent(self, schema: str, limit: int = tm.HISTORY_ROWS) -> DataFrame:
        """The newest queries, at most ``HISTORY_ROWS``, with their present rating."""
        if limit > tm.HISTORY_ROWS:
            raise ValueError(f"only the newest {tm.HISTORY_ROWS} queries are kept")
        rows = tm.newest(self._read("recent", schema).drop("batch"), limit)
        ratings = self._read("known", KNOWN).join(F.broadcast(rows.select("query_id")), "query_id", "left_semi")
        ratings = ratings.groupBy("query_id").agg(F.max_by(F.struct("user_rating"), "batch").alias("_last"))
        rows = rows.join(ratings, "query_id", "left")
        rating = F.when(F.col("_last").isNull(), F.col("user_rating")).otherwise(F.col("_last.user_rating"))
        return rows.withColumn("user_rating", rating).drop("_last")


KNOWN = "query_id string, hour timestamp, slug string, user_rating int"


def summary(counts: DataFrame, digits: int = 2) -> DataFrame:
    """The row of ``telemetry.summary``."""
    total = {n: F.coalesce(F.sum(n), F.lit(0)) for n in ("total", "good", "bad", "timed", "latency", "rated", "rating")}
    mean = lambda part, whole: F.round(F.coalesce(total[part] / F.nullif(total[whole], F.lit(0)), F.lit(0.0)), digits)
    return counts.agg(
        total["total"].alias("total_queries"),
        total["good"].alias("success_count"),
        total["bad"].alias("error_count"),
        F.round(F.coalesce(total["good"] * F.lit(100.0) / F.nullif(total["total"], F.lit(0)), F.lit(0.0)), digits).alias("success_rate"),
        mean("latency", "timed").alias("avg_latency_ms"),
        total["rated"].alias("rated_queries"),
        mean("rating", "rated").alias("avg_rating"),
    )


def dashboard_table(counts: DataFrame, tools: DataFrame) -> DataFrame:
    """The rows of ``telemetry.dashboard_table``, from the counts alone."""
    cells = [("ratings", s, str(s), f"stars_{s}") for s in STARS]
    cells += [("latency", i, name, f"bucket_{i}") for i, (name, _) in enumerate(tm.LATENCY_BUCKETS)]
    cells += [("relevance", 0, name, f"score_{name}") for name in tm.SCORES]
    sums = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for *_, c in cells])
    rows = [F.struct(F.lit(p).alias("panel"), F.lit(i).alias("position"), F.lit(n).alias("label"), F.col(c).alias("count")) for p, i, n, c in cells]
    fixed = sums.select(F.inline(F.array(*rows))).where((F.col("panel") != "relevance") | (F.col("count") > 0))
    called = tools.groupBy("tool").agg(F.sum("calls").alias("count"))
    return fixed.unionByName(called.select(F.lit("tools").alias("panel"), F.lit(0).alias("position"), F.col("tool").alias("label"), "count"))
