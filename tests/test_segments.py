"""Stored libraries that grow by segments."""

import os

import pytest
from pyspark.sql import functions as F

from shelfmine.operators import lexical
from shelfmine.plans import ingest, search
from shelfmine.session import RELEASED, fresh_table_path, settings, shared_folder
from shelfmine.sources import segments
from shelfmine.sources.segments import SegmentedLibrary, index_tables

WORDS = "white rabbit hat pool tears queen king cat tea hare".split()


def text(i, turn=0):
    return " ".join(WORDS[(i * 7 + k * k + turn) % len(WORDS)] for k in range(3 + (i + turn) % 11))


def chunks(spark, numbers, turn=0):
    rows = [(f"{i}-{k}", f"s{i}", text(i + k, turn)) for i in numbers for k in range(1 + (i + turn) % 3)]
    return spark.createDataFrame(rows, "chunk_id string, slug string, text string")


def slugs(spark, numbers):
    return spark.createDataFrame([(f"s{i}",) for i in numbers], "slug string")


def files(root, below=""):
    return {
        os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns
        for d, _, names in os.walk(os.path.join(root, below))
        for n in names
        if n.endswith(".parquet")
    }


def grow(spark, root):
    """Library and the chunks that it must hold, after appends, replacements and removals."""
    library = SegmentedLibrary.create(spark, root)
    first = chunks(spark, range(40))
    library = library.append({"chunks": first, **index_tables(first)})
    second = chunks(spark, [*range(30, 50), 3], turn=1)
    library = library.append({"chunks": second, **index_tables(second)}, second.select("slug"))
    library = library.delete(slugs(spark, [0, 31, 49, 99]))
    third = chunks(spark, [31, 60], turn=2)
    library = library.append({"chunks": third, **index_tables(third)}, third.select("slug"))
    wanted = {i: 0 for i in range(40)} | {i: 1 for i in [*range(30, 50), 3]}
    wanted = {i: t for i, t in wanted.items() if i not in (0, 31, 49)} | {31: 2, 60: 2}
    final = [r for turn in (0, 1, 2) for r in map(tuple, chunks(spark, [i for i, t in wanted.items() if t == turn], turn).collect())]
    return library, sorted(final)


def same_search(spark, library, final):
    fresh = lexical.build_index(spark.createDataFrame(final, "chunk_id string, slug string, text string"))
    queries = spark.createDataFrame([(1, "white rabbit tea"), (2, "queen queen"), (3, "unknown"), (4, "hat hare pool king")], "qid int, query string")
    best = lambda index: sorted(map(tuple, lexical.bm25_topk(queries, index, 9).collect()))
    stats = lambda df: sorted((r.term, r.df, round(r.idf, 9)) for r in df.collect())
    index = library.index()
    assert best(index) == best(fresh)
    assert stats(index.term_stats) == stats(lexical.term_stats(fresh))
    assert index.totals == tuple(fresh.lengths.agg(F.count(F.lit(1)), F.sum("dl")).first())


@pytest.fixture(scope="module")
def grown(spark):
    root = fresh_table_path(spark, "lib")
    return root, *grow(spark, root)


def test_appends_replacements_and_removals(spark, grown):
    root, library, final = grown
    assert sorted(map(tuple, library.table("chunks").collect())) == final
    same_search(spark, library, final)
    opened = SegmentedLibrary.open(spark, root)
    assert opened.version == library.version == 4
    assert sorted(map(tuple, opened.table("chunks").collect())) == final


def test_stored_files_stay_as_they_are(spark, grown):
    root, library, _ = grown
    before = files(root)
    more = chunks(spark, [1, 70], turn=3)
    more_of_it = library.append({"chunks": more, **index_tables(more)}, more.select("slug"))
    more_of_it.delete(slugs(spark, [2]))
    after = files(root)
    assert before.items() <= after.items()
    new = after.keys() - before.keys()
    own = more_of_it.segments[-1]["id"]
    assert new and all(f"segment={own}" in n or "/removed/" in n or "/deletes/" in n for n in new)


def test_old_versions_stay_readable(spark, grown):
    root, _, _ = grown
    old = SegmentedLibrary.open(spark, root, 1)
    assert sorted(map(tuple, old.table("chunks").collect())) == sorted(map(tuple, chunks(spark, range(40)).collect()))
    assert SegmentedLibrary.open(spark, root, 0).segments == []
    with pytest.raises(segments.NoLibrary):
        SegmentedLibrary.open(spark, root, 77)
    with pytest.raises(segments.NoLibrary):
        SegmentedLibrary.open(spark, fresh_table_path(spark, "none"))


def test_merging_leaves_out_dead_rows(spark):
    root = fresh_table_path(spark, "lib")
    library, final = grow(spark, root)
    one = library.merged(2)
    assert len(one.segments) < len(library.segments)
    assert sorted(map(tuple, one.table("chunks").collect())) == final
    same_search(spark, one, final)
    whole = one
    while len(whole.segments) > 1:
        whole = whole._merge(whole.segments)
    assert whole.manifest["deletes"] == [] and whole.segments[0]["rows"]["chunks"] == len(final)
    same_search(spark, whole, final)
    later = whole.delete(slugs(spark, [60]))
    same_search(spark, later, [r for r in final if r[1] != "s60"])


def test_postings_are_neither_exchanged_nor_counted_again(spark, monkeypatch, tmp_path):
    """Chunks are dealt before they become postings; a merge knows the frequencies and the size from its segments."""
    first, second = chunks(spark, range(20)), chunks(spark, [3, 4, 30], turn=1)
    library = SegmentedLibrary.create(spark, str(tmp_path / "library"))
    tables = index_tables(first)
    assert "runs" in tables["postings"].rows.columns
    library = library.append(tables).append(index_tables(second), second.select("slug")).delete(slugs(spark, [5]))

    def again(*_):
        raise AssertionError("postings are counted again")

    monkeypatch.setattr(segments, "document_frequency", again)
    monkeypatch.setattr(SegmentedLibrary, "_size", again)
    merged = library._merge(library.segments)
    assert len(merged.segments) == 1
    final = [*map(tuple, first.where("slug not in ('s3', 's4', 's5')").collect()), *map(tuple, second.collect())]
    same_search(spark, merged, sorted(final))


def test_second_writer_is_refused(spark):
    root = fresh_table_path(spark, "lib")
    library = SegmentedLibrary.create(spark, root)
    a, b = chunks(spark, [1]), chunks(spark, [2])
    library.append({"chunks": a})
    with pytest.raises(segments.ConcurrentChange):
        library.append({"chunks": b})
    assert [r.slug for r in SegmentedLibrary.open(spark, root).table("chunks").distinct().collect()][0] == "s1"


def test_odd_batches(spark):
    """Null slugs stay, repeated rows stay repeated, batches and removals without rows change nothing."""
    library = SegmentedLibrary.create(spark, fresh_table_path(spark, "lib"))
    rows = spark.createDataFrame([("a", None, "x y"), ("b", "s", "x"), ("b", "s", "x")], "chunk_id string, slug string, text string")
    library = library.append({"chunks": rows, **index_tables(rows)})
    library = library.append({"chunks": rows.where("false"), **index_tables(rows.where("false"))}, rows.where("false").select("slug"))
    assert library.table("chunks").count() == 3 and library.index().totals == (3, 4)
    library = library.delete(rows.select("slug").where("slug is null")).delete(slugs(spark, [8]))
    assert library.table("chunks").count() == 3
    library = library.delete(rows.select("slug"))
    assert [tuple(r) for r in library.table("chunks").collect()] == [("a", None, "x y")] and library.index().totals == (1, 2)
    with pytest.raises(ValueError, match="layout"):
        library.append({"chunks": rows.withColumn("bucket", F.lit(1))})


def test_buckets_follow_the_size(spark, monkeypatch):
    monkeypatch.setattr(segments, "BUCKET_BYTES", 200)
    root = fresh_table_path(spark, "lib")
    library, final = grow(spark, root)
    assert len({s["buckets"] for s in library.segments}) > 1 and max(s["buckets"] for s in library.segments) > 3
    assert sorted(map(tuple, library.table("chunks").collect())) == final
    same_search(spark, library, final)


def test_ingestion_by_batches(spark):
    schema = "slug string, title string, author string, doc_type string, text string"
    talk = "\n".join(f"[00:{i:02d}:00] P{i % 3}: point number {i} about the plan" for i in range(8))
    first = [("aiw", "Alice", "Carroll", "book", "CHAPTER I.\n\nA white rabbit.\n"), ("talk", "Weekly", "", "conversation", talk)]
    library = SegmentedLibrary.create(spark, fresh_table_path(spark, "lib"))
    library = ingest.append(spark.createDataFrame(first, schema), library)
    known = {r.slug: r for r in library.table("documents").collect()}
    with pytest.raises(ValueError, match="already stored"):
        ingest.append(spark.createDataFrame(first[:1], schema), library)
    second = [("aiw", "Alice 2", "Carroll", "book", "CHAPTER I.\n\nA pool of tears.\n"), ("new", "N", "", "book", "a mad tea party")]
    library = ingest.append(spark.createDataFrame(second, schema), library, replace_known=True)
    rows = {r.slug: r for r in library.table("documents").collect()}
    assert rows.keys() == {"aiw", "talk", "new"} and rows["aiw"].title == "Alice 2"
    assert (rows["aiw"].book_id, rows["aiw"].added_at) == (known["aiw"].book_id, known["aiw"].added_at)
    assert len({r.book_id for r in rows.values()}) == 3
    stores = ingest.stores_of(library)
    problems = ingest.verification(spark.createDataFrame(second, schema), stores).collect()
    assert {r.problem for r in problems} == {""}
    queries = spark.createDataFrame([(1, "pool tears"), (2, "rabbit"), (3, "plan point")], "qid int, query string")
    hits = search.passages(search.hybrid_search(queries, stores.library(), 2), stores.chunks).where("rank = 1").collect()
    assert {r.qid: r.slug for r in hits if r.qid != 2} == {1: "aiw", 3: "talk"}
    assert "rabbit" not in {r.term for r in stores.index.term_stats.collect()}


def batch(spark, numbers, turn=0):
    rows = [(f"s{i}", f"T{i}", "", "book", f"{text(i, turn)}\nCHAPTER I.\n\n{text(i + 1, turn)} " * 5) for i in numbers]
    return spark.createDataFrame(rows, "slug string, title string, author string, doc_type string, text string")


def test_an_appended_batch_leaves_no_copy_beside_the_library(spark, monkeypatch):
    """Steps of a batch go as soon as they are stored, and so do the files of exchanges; what follows from stored chunks is
    not exchanged again, and every table holds its rows in the buckets of their slugs."""
    monkeypatch.setattr(segments, "BUCKET_BYTES", 2_000)
    plans, dealt = {}, SegmentedLibrary._dealt

    def watched(self, name, *rows):
        out = dealt(self, name, *rows)
        plans[name] = out._jdf.queryExecution().executedPlan().toString()
        return out

    monkeypatch.setattr(SegmentedLibrary, "_dealt", watched)
    folder = shared_folder(spark).removeprefix("file://").removeprefix("file:")
    root = fresh_table_path(spark, "lib").removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    conf = {name: spark.conf.get(name) for name in (*RELEASED, *segments.PLACED)}
    library = ingest.append(batch(spark, range(40)), SegmentedLibrary.create(spark, root), max_tokens=12, overlap=4)
    library = ingest.append(batch(spark, [3, 50], turn=1), library, replace_known=True, max_tokens=12, overlap=4).delete(slugs(spark, [7]))
    assert set(os.listdir(folder)) - before <= {os.path.basename(root)}
    assert conf == {name: spark.conf.get(name) for name in conf}
    for name in ("vectors", "lengths", "postings"):
        assert "Exchange" not in plans[name] and "Scan parquet" in plans[name]
    assert library.segments[0]["buckets"] > 1
    kept = {f"s{i}" for i in (*range(40), 50)} - {"s7"}
    for name in (*ingest.TABLES, "lengths", "postings"):
        assert {"segment", "bucket"}.isdisjoint(library.table(name).columns)
        assert {r.slug for r in library.table(name).select("slug").distinct().collect()} == kept
        for s in library.segments:
            home = F.pmod(F.xxhash64("slug"), F.lit(s["buckets"])).cast("int")
            assert library._stored(name, [s]).where(F.col("bucket") != home).count() == 0
    rows = [tuple(r) for r in library.table("chunks").select("chunk_id", "slug", "text").collect()]
    assert library.table("vectors").count() == library.table("lengths").count() == len(rows)
    same_search(spark, library, sorted(rows))


def test_stored_files_are_small(spark, tmp_path):
    """Tables of a library, delete files and term counts are not in the default codec."""
    import pyarrow.parquet as pq

    root = str(tmp_path / "library")
    library = ingest.append(batch(spark, range(5)), SegmentedLibrary.create(spark, root))
    ingest.append(batch(spark, [1], turn=1), library, replace_known=True).delete(slugs(spark, [2])).merged(2)
    found = {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files(root) if pq.ParquetFile(f).metadata.num_row_groups}
    assert found == {"ZSTD"}


def test_settings_end_with_their_block(spark):
    name, known = "spark.shelfmine.nothing", "spark.sql.shuffle.partitions"
    before = spark.conf.get(known)
    with pytest.raises(KeyError):
        with settings(spark, {name: "1", known: "3"}):
            assert (spark.conf.get(name), spark.conf.get(known)) == ("1", "3")
            raise KeyError
    assert (spark.conf.get(name, None), spark.conf.get(known)) == (None, before)


def test_rows_that_follow_need_a_bucket(spark):
    segment = SegmentedLibrary.create(spark, fresh_table_path(spark, "lib")).begin()
    first = chunks(spark, range(3))
    segment.write({"chunks": first})
    with pytest.raises(ValueError, match="bucket"):
        segment.follow({"vectors": first})
    with pytest.raises(ValueError, match="layout"):
        segment.write({"others": segment.stored("chunks")})
    segment.follow({"others": segment.stored("chunks").drop("text")})
    assert sorted(segment.commit().table("others").collect()) == sorted(first.drop("text").collect())


def test_many_removed_documents_exchange_no_postings(spark, monkeypatch, tmp_path):
    """More documents than a broadcast may have: their buckets are read in shares, each with a broadcast of its own."""
    monkeypatch.setattr(segments, "BUCKET_BYTES", 120)
    monkeypatch.setattr(segments, "BROADCAST_ROWS", 12)
    plans, write = [], SegmentedLibrary._write_terms

    def watched(self, counts, name, *by, **options):
        if name == "removed":
            plans.append(counts._jdf.queryExecution().executedPlan().toString())
        return write(self, counts, name, *by, **options)

    monkeypatch.setattr(SegmentedLibrary, "_write_terms", watched)
    first, second = chunks(spark, range(60)), chunks(spark, range(5, 50), turn=1)
    library = SegmentedLibrary.create(spark, str(tmp_path / "library")).append({"chunks": first, **index_tables(first)})
    library = library.append({"chunks": second, **index_tables(second)}, second.select("slug"))
    assert len(plans) > 2 and not any("SortMergeJoin" in p or "hashpartitioning(slug" in p for p in plans)
    library = library.delete(slugs(spark, [*range(0, 60, 2), 99])).delete(slugs(spark, [0, 3, 8]))
    final = [r for rows, gone in ((first, range(5, 50)), (second, ())) for r in map(tuple, rows.collect()) if int(r[1][1:]) not in {*gone, *range(0, 60, 2), 3}]
    assert sorted(map(tuple, library.table("chunks").collect())) == sorted(final)
    same_search(spark, library, sorted(final))
