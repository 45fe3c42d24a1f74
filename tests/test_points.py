"""Stored points: what a lookup and a page read, and what they return."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from shelfmine.session import fresh_table_path
from shelfmine.sources import points


@pytest.fixture(scope="module")
def store(spark):
    rows = spark.range(5_000).select(
        F.format_string("c%05d", "id").alias("chunk_id"), (F.col("id") % 7).alias("label"), F.array(F.col("id") / 10).alias("vector")
    )
    return points.write_points(rows, fresh_table_path(spark, "points"), buckets=8)


def test_lookup_keeps_what_was_asked(spark, store):
    ids = spark.createDataFrame([("c00042", 2), ("c04999", 1), ("c00042", 3), ("nobody", 4), (None, 5)], "chunk_id string, rank int")
    rows = store.by_ids(ids).orderBy("rank").collect()
    assert [(r.rank, r.chunk_id, r.label) for r in rows] == [(1, "c04999", 4999 % 7), (2, "c00042", 0), (3, "c00042", 0)]
    assert store.by_ids(ids.where("false")).count() == 0


def test_lookup_reads_the_buckets_of_its_identifiers(spark, store):
    ids = spark.createDataFrame([("c00042",)], "chunk_id string")
    found = store.by_ids(ids)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "PushedFilters: [" in plan and "chunk_id" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert len({r.f for r in found.select(F.input_file_name().alias("f")).collect()}) == 1
    files = glob.glob(f"{store.path}/bucket=*/*.parquet")
    assert len(files) == 8
    # files with a Bloom filter keep one row group's bits behind its columns: the footer names their place
    plain = fresh_table_path(spark, "plain")
    store.rows.write.partitionBy("bucket").parquet(plain)
    size = lambda path: sum(pq.ParquetFile(f).metadata.row_group(0).total_byte_size for f in glob.glob(f"{path}/bucket=*/*.parquet"))
    total = lambda path: sum(len(open(f, "rb").read()) for f in glob.glob(f"{path}/bucket=*/*.parquet"))
    assert total(store.path) - size(store.path) > total(plain) - size(plain)


def test_many_identifiers_are_joined(spark, store, monkeypatch):
    monkeypatch.setattr(points, "PUSHED_IDS", 10)
    ids = spark.range(0, 6_000, 3).select(F.format_string("c%05d", "id").alias("chunk_id"))
    assert store.by_ids(ids).count() == len(range(0, 5_000, 3))


@pytest.mark.parametrize("size", [700, 5_000])
def test_pages_hold_every_point_once(store, size):
    condition = F.col("label") == 3
    pages = list(store.pages(size, condition, ("chunk_id", "label")))
    ids = [r.chunk_id for p in pages for r in p]
    assert sorted(ids) == [f"c{i:05d}" for i in range(5_000) if i % 7 == 3] and len(set(ids)) == len(ids)
    assert all(len(p) == size for p in pages[:-1])


def test_cursor_goes_on_after_the_last_identifier(store):
    first, cursor = store.page(None, 30)
    second, _ = store.page(cursor, 30)
    assert len(first) == len(second) == 30 and not {r.chunk_id for r in first} & {r.chunk_id for r in second}


def test_page_bounds(spark):
    rows = spark.range(0, 1_050).select((F.col("id") * 3).alias("key"))
    bounds = sorted(map(tuple, points.page_bounds(rows, "key").collect()))
    assert bounds == [(p, 300 * p, min(300 * p + 297, 3147), 100 if p < 10 else 50) for p in range(11)]
    assert points.page_bounds(rows.where("false"), "key").count() == 0
