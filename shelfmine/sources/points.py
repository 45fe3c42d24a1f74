"""Stored points: lookup by identifier and scans in pages, without reading what is not asked for.

Points lie in buckets by the hash of their identifier, sorted by it inside, and every file has a Bloom filter on it. A lookup
opens the buckets of its identifiers, and of these the row groups whose statistics and filter may hold one. A scan goes
through buckets in order, and through a bucket by identifier: its cursor is the last identifier seen, not an offset, so
a page costs the same wherever it lies, and points that come in meanwhile shift no page.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmine.operators.skew import join_small
from shelfmine.session import cut_lineage, drop_steps

POINTS_PER_BUCKET = 250_000
PAGE = 100
# identifiers of a lookup that are pushed to the reader; more of them are joined
PUSHED_IDS = 1_000


@dataclass(frozen=True)
class PointStore:
    """Points with a unique identifier column, in ``buckets`` folders below ``path``."""

    spark: SparkSession
    path: str
    key: str
    buckets: int

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def by_ids(self, ids: DataFrame) -> DataFrame:
        """The points of ``ids``, with the other columns of ``ids``; unknown and null identifiers disappear, and an
        identifier that is asked twice comes twice."""
        few = [r[0] for r in ids.select(self.key).where(F.col(self.key).isNotNull()).distinct().limit(PUSHED_IDS + 1).collect()]
        asked = ids.withColumn("bucket", self._bucket(F.col(self.key)))
        if len(few) > PUSHED_IDS:
            return join_small(self.rows, asked, ["bucket", self.key], self.key).drop("bucket")
        buckets = [r[0] for r in asked.select("bucket").distinct().collect()]  # at most as many as there are identifiers
        rows = self.rows.where(F.col("bucket").isin(buckets) & F.col(self.key).isin(few))
        return rows.join(F.broadcast(asked), ["bucket", self.key]).drop("bucket")

    def page(self, after: tuple | None = None, size: int = PAGE, condition: Column | None = None, columns: tuple[str, ...] = ()) -> tuple[list, tuple | None]:
        """``(rows, cursor)``: the next points after a cursor, and where to go on; the cursor is None at the end."""
        bucket, last = after or (0, None)
        found: list = []
        while bucket < self.buckets and len(found) < size:
            rows = self.rows.where(F.col("bucket") == bucket)
            if last is not None:
                rows = rows.where(F.col(self.key) > F.lit(last))
            if condition is not None:
                rows = rows.where(condition)
            rows = rows.select(*(columns or rows.columns)) if columns else rows.drop("bucket")
            part = rows.orderBy(self.key).limit(size - len(found)).collect()
            found += part
            if len(found) == size:
                return found, (bucket, part[-1][self.key])
            bucket, last = bucket + 1, None
        return found, None

    def pages(self, size: int = PAGE, condition: Column | None = None, columns: tuple[str, ...] = ()) -> Iterator[list]:
        """All pages in turn; the driver holds one page."""
        cursor: tuple | None = (0, None)
        while cursor is not None:
            rows, cursor = self.page(cursor, size, condition, columns)
            if rows:
                yield rows


def write_points(points: DataFrame, path: str, key: str = "chunk_id", buckets: int | None = None) -> PointStore:
    """Store points under a fresh ``path``. Identifiers are unique and not null (``vectors.latest_points`` makes them so)."""
    n = points.count()
    buckets = buckets or max(1, -(-n // POINTS_PER_BUCKET))
    store = PointStore(points.sparkSession, path, key, buckets)
    placed = points.withColumn("bucket", store._bucket(F.col(key))).repartition(buckets, "bucket")
    writer = placed.sortWithinPartitions("bucket", key).write.partitionBy("bucket")
    writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.option(f"parquet.bloom.filter.expected.ndv#{key}", str(max(1, n // buckets))).parquet(path)
    return store


def page_bounds(points: DataFrame, key: str, size: int = PAGE) -> DataFrame:
    """``(page, first_id, last_id, n)``: the pages of a scan in the order of a unique identifier, all at once, so that many
    readers can take pages of their own. Rows are sorted in ranges; only the sizes of the ranges come to the driver."""
    ranges = points.select(F.col(key).alias("id")).repartitionByRange("id").sortWithinPartitions("id")
    # the number has the range in its upper bits and the place within it in the lower 33
    placed = cut_lineage(ranges.withColumn("at", F.monotonically_increasing_id()), "ranges")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    before, total = [], 0
    for row in sizes:
        before.append((row.part, total))
        total += row.n
    offsets = points.sparkSession.createDataFrame(before, "part long, offset long")
    numbered = placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("row", F.col("offset") + place)
    pages = numbered.groupBy(F.floor(F.col("row") / size).alias("page"))
    out = cut_lineage(pages.agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count(F.lit(1)).alias("n")), "pages")
    drop_steps(placed)
    return out
