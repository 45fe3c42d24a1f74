import json

import pytest
from pyspark.sql import functions as F

from shelfmine import schema
from shelfmine.operators import catalog, chunking, telemetry
from shelfmine.plans import ingest, search, service
from shelfmine.session import fresh_table_path, shared_folder
from shelfmine.sources import readers
from shelfmine.streaming import collector

BOOK = "Front matter\nCHAPTER I.\n\nAlice saw a white rabbit. It was late. She followed.\nCHAPTER II.\n\nA pool of tears."
TALK = "\n".join(f"[00:{i:02d}:00] P{i % 3}: point number {i} about the plan" for i in range(8))


def documents(spark):
    rows = [("aiw", "Alice", "Carroll", "book", BOOK), ("talk", "Weekly", "", "conversation", TALK)]
    return spark.createDataFrame(rows, "slug string, title string, author string, doc_type string, text string")


@pytest.fixture(scope="module")
def stores(spark):
    fresh = ingest.ingest(documents(spark), ingest.empty_stores(spark), max_tokens=40, overlap=10)
    return ingest.save(fresh, fresh_table_path(spark, "stores"), "flow", buckets=2)


def test_ingestion_is_complete(spark, stores):
    rows = {r["slug"]: r for r in ingest.verification(documents(spark), stores).collect()}
    assert rows["aiw"]["problem"] == "" and rows["aiw"]["sections"] == 3
    assert rows["talk"]["problem"] == ""
    meta = {r["slug"]: json.loads(r["metadata"]) for r in stores.documents.collect()}
    assert meta["aiw"] == {} and meta["talk"]["num_turns"] == 8


def test_known_slug_is_refused_and_bad_slug_too(spark, stores):
    with pytest.raises(ValueError, match="already stored"):
        ingest.checked(documents(spark), stores.documents, replace_known=False)
    bad = documents(spark).withColumn("slug", F.lit("a b"))
    with pytest.raises(ValueError, match="invalid slug"):
        ingest.checked(bad, stores.documents, replace_known=True)


def test_delete_reaches_every_table(spark, stores):
    left = ingest.delete(spark.createDataFrame([("talk",)], "slug string"), stores)
    for frame in (left.documents, left.chunks, left.section_summaries, left.document_summaries, left.vectors, left.index.postings):
        assert {r[0] for r in frame.select("slug").distinct().collect()} == {"aiw"}


def test_tools(spark, stores):
    tools = service.ToolService(spark, stores)
    found = tools.dispatch("search_book", {"query": "white rabbit", "book_identifier": "[Alice]"})
    assert found.startswith("Found 3 results for 'white rabbit' in Alice:") and "Passage 1 [Section 2, Source: aiw_02_001_" in found
    assert tools.dispatch("search_book", {"query": "x", "book_identifier": "nope"}) == "Error: Book not found: nope"
    assert tools.dispatch("get_chapter_summaries", {"book_identifier": "aiw"}).startswith("Found 3 chapters:\n\nChapter 1:\nFront matter")
    assert tools.dispatch("get_book_summary", {"book_identifier": "nope"}) == "No summary available"
    assert tools.dispatch("nope", {}) == "Unknown tool: nope"
    several = tools.dispatch("search_multiple_books", {"query": "plan", "book_identifiers": "aiw, talk, gone"})
    assert "### TALK ###" in several and "Error: Book not found: gone" in several
    with pytest.raises(ValueError):
        tools.query_book("gone")


def test_vector_only_without_keyword_index(spark, stores):
    library = stores.library()
    queries = spark.createDataFrame([(1, "white rabbit")], "qid int, query string")
    bare = search.Library(library.chunks, library.vectors, None, library.embedder)
    assert search.hybrid_search(queries, bare, 2).count() == 2


# ---------------------------------------------------------------- sources


def test_text_encodings(spark):
    folder = fresh_table_path(spark, "texts")
    import os

    os.makedirs(folder)
    for name, data in (("utf.txt", "é".encode()), ("latin.md", "é".encode("latin-1"))):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    rows = {r["slug"]: (r["suffix"], r["text"]) for r in readers.read_texts(spark, folder).collect()}
    assert rows == {"utf": (".txt", "é"), "latin": (".md", "é")}
    with pytest.raises(Exception, match="not valid UTF-8"):
        readers.read_texts(spark, folder, strict=True).collect()


def test_golden_files(spark):
    folder = fresh_table_path(spark, "golden")
    golden = spark.createDataFrame([("c1", "q1"), ("c1", "q2"), ("c2", "q3")], schema.GOLDEN)
    readers.golden_lines(golden).coalesce(1).write.text(folder)
    lines = spark.read.text(folder)
    assert sorted(map(tuple, readers.golden_rows(lines).collect())) == [("c1", "q1"), ("c1", "q2"), ("c2", "q3")]
    assert readers.read_golden(spark, folder + "-absent").count() == 0


def test_validation_of_chunks(spark):
    with pytest.raises(ValueError, match="metadata"):
        chunking.validated(spark.createDataFrame([("x",)], "text string"))
    bad = spark.createDataFrame([(None, "m")], "text string, metadata string")
    with pytest.raises(Exception, match="must not be null"):
        chunking.validated(bad).collect()


def test_shared_folder_is_the_configured_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_upsert_keeps_identity(spark):
    columns = "book_id long, slug string, title string, added_at string"
    old = spark.createDataFrame([(1, "a", "A", "old")], columns)
    new = spark.createDataFrame([(9, "a", "B", "new"), (10, "b", "C", "new")], columns)
    rows = sorted(map(tuple, catalog.upsert_documents(old, new).collect()))
    assert rows == [(1, "a", "B", "old"), (10, "b", "C", "new")]


# ---------------------------------------------------------------- telemetry stream


def metric(query_id, tools, success=True):
    return {
        "query_id": query_id, "timestamp": "2024-01-01T00:00:00", "query": "q", "latency_ms": 10.0, "success": success,
        "tool_calls": tools, "fallback_to_context": False, "retry_attempted": False,
    }


def test_stream_stores_trackable_rows_once(spark):
    import os

    source, target, checkpoint = (fresh_table_path(spark, n) for n in ("in", "out", "state"))
    os.makedirs(source)

    def arrive(name, *rows):
        with open(f"{source}/{name}.json", "w") as f:
            f.write("\n".join(json.dumps(r) for r in rows))

    def run():
        collector.store(collector.metric_stream(spark, source), target, checkpoint).awaitTermination()

    arrive("one", metric("q1", ["search_book"]), metric("ephemeral_1", ["search_book"]))
    run()
    arrive("two", metric("q2", ["search_book", "other"], success=False))
    run()
    stored = collector.stored_metrics(spark, target)
    assert sorted(r["query_id"] for r in stored.collect()) == ["q1", "q2"]
    row = telemetry.summary(stored).first()
    assert (row["total_queries"], row["error_count"], row["success_rate"]) == (2, 1, 50.0)

    usage = collector.running_tool_usage(collector.metric_stream(spark, source))
    query = usage.writeStream.format("memory").queryName("tool_usage_now").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["tool"]: r["calls"] for r in spark.table("tool_usage_now").collect()} == {"search_book": 2, "other": 1}


def test_empty_metrics_give_zeros(spark):
    nothing = spark.createDataFrame([], schema.QUERY_METRICS)
    row = telemetry.summary(nothing).first()
    assert (row["total_queries"], row["success_rate"], row["avg_latency_ms"]) == (0, 0.0, 0.0)
    assert [r["count"] for r in telemetry.latency_buckets(nothing).collect()] == [0] * 5
    assert set(telemetry.dashboard(nothing)) >= {"summary", "tool_usage", "latency_distribution"}


def test_summary_upsert_keeps_one_row_per_key(spark):
    schema = "book_id bigint, chapter_id int, summary string, created_at timestamp_ntz"
    old = spark.sql("SELECT 1L AS book_id, 1 AS chapter_id, 'old' AS summary, timestamp_ntz'2024-01-01' AS created_at "
                    "UNION ALL SELECT CAST(NULL AS bigint), 1, 'old', timestamp_ntz'2024-01-01' UNION ALL SELECT 2L, 1, 'stays', NULL")
    new = spark.sql("SELECT 1L AS book_id, 1 AS chapter_id, 'b' AS summary, timestamp_ntz'2024-02-02' AS created_at "
                    "UNION ALL SELECT 1L, 1, 'z', timestamp_ntz'2024-02-01' UNION ALL SELECT CAST(NULL AS bigint), 1, 'n', NULL")
    got = catalog.upsert_summaries(old.to(spark.createDataFrame([], schema).schema), new, ("book_id", "chapter_id"))
    assert sorted((str(r.book_id), r.summary) for r in got.collect()) == [("1", "b"), ("2", "stays"), ("None", "n")]
