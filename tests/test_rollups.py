"""Roll-ups kept by batches beside roll-ups of all metrics at once."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shelfmine import schema
from shelfmine.operators import rollups
from shelfmine.operators import telemetry as tm
from shelfmine.streaming import collector


def made(spark, n=400, seed=5):
    rng = random.Random(seed)
    names = [f.name for f in spark.createDataFrame([], schema.QUERY_METRICS).schema]
    rows = []
    for i in range(n):
        values = {
            "query_id": f"q{rng.randrange(250)}" if i % 20 else f"ephemeral_{i}",
            "timestamp": dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i),
            "query": f"text {i}",
            "book_slug": rng.choice(["a", "b", None]),
            "latency_ms": rng.choice([None, 10.0, 1000.0, 4000.5, 20000.0]),
            "success": rng.choice([True, True, False, None]),
            "tool_calls": rng.choice([None, [], ["x"], ["x", "y", "x"]]),
            "llm_relevance_score": rng.choice([None, "poor", "EXCELLENT", "?"]),
            "user_rating": rng.choice([None, 1, 3, 5]),
            "retry_attempted": rng.choice([None, True, False]),
            "retry_results": rng.choice([None, 0, 2]),
            "fallback_to_context": rng.choice([None, True]),
        }
        rows.append(tuple(values.get(name) for name in names))
    return spark.createDataFrame(rows, schema.QUERY_METRICS)


def batches(rows, count=3):
    """By time, so that the first row of a query is in the first batch that holds it."""
    minute = F.floor((F.unix_timestamp("timestamp") - F.lit(int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp()))) / 60 / 7)
    return [rows.where((minute >= 400 * i // count) & (minute < 400 * (i + 1) // count)) for i in range(count)]


def listed(frame):
    return sorted(map(str, frame.collect()))


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    rows = made(spark)
    store = rollups.Rollups(spark, str(tmp_path_factory.mktemp("rollups")))
    for number, batch in enumerate(batches(rows)):
        store.add(batch, number)
    return store, tm.one_per_query(tm.trackable(rows)).cache()


def test_same_panels_as_all_at_once(kept):
    store, once = kept
    assert listed(rollups.dashboard_table(store.counts(), store.tools())) == listed(tm.dashboard_table(once))
    assert listed(rollups.summary(store.counts(), 6)) == listed(tm.summary(once, 6))


def test_one_slug_and_some_hours(kept):
    store, once = kept
    since, until = dt.datetime(2024, 1, 1, 12), dt.datetime(2024, 1, 2, 3)
    part = once.where((F.col("timestamp") >= F.lit(since)) & (F.col("timestamp") < F.lit(until)) & (F.col("book_slug") == "a"))
    chosen = (since, until, "a")
    assert listed(rollups.dashboard_table(store.counts(*chosen), store.tools(*chosen))) == listed(tm.dashboard_table(part))


def test_newest_rows_show_the_last_rating(kept):
    store, once = kept
    assert listed(tm.recent_queries(store.recent(schema.QUERY_METRICS, 50))) == listed(tm.recent_queries(once))
    with pytest.raises(ValueError):
        store.recent(schema.QUERY_METRICS, tm.HISTORY_ROWS + 1)


def test_a_batch_done_again_and_an_empty_store(spark, kept, tmp_path):
    store, once = kept
    for number in (1, 2):
        store.add(batches(made(spark))[number], number)
    assert listed(rollups.summary(store.counts(), 6)) == listed(tm.summary(once, 6))
    empty = rollups.Rollups(spark, str(tmp_path / "none"))
    nothing = made(spark).limit(0)
    assert listed(rollups.dashboard_table(empty.counts(), empty.tools())) == listed(tm.dashboard_table(nothing))
    assert listed(rollups.summary(empty.counts())) == listed(tm.summary(nothing))
    empty.add(nothing, 0)
    assert listed(rollups.summary(empty.counts())) == listed(tm.summary(nothing))


def test_stream_of_files(spark, kept, tmp_path):
    """Each file is a batch of its own; running the stream again adds nothing."""
    _, once = kept
    store, source = rollups.Rollups(spark, str(tmp_path / "rolled")), str(tmp_path / "in")
    for batch in batches(made(spark)):
        batch.coalesce(1).write.mode("append").json(source)
        collector.roll_up(collector.metric_stream(spark, source), store, str(tmp_path / "checkpoint")).awaitTermination(120)
    collector.roll_up(collector.metric_stream(spark, source), store, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert listed(rollups.dashboard_table(store.counts(), store.tools())) == listed(tm.dashboard_table(once))
