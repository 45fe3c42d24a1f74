"""Guards against hot keys: checked broadcasts, salted joins and running sums over bounded blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmine.session import cut_lineage

# A side is broadcast only when both its rows and its bytes have been counted to stay below these bounds.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
SALT_BUCKETS = 32
# rows of the large side from which a key is hot
HOT_ROWS = 1_000_000
BLOCK_ROWS = 100_000


def measured_size(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes of text form, by one aggregate that is combined in the map side."""
    as_text = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    row = df.agg(F.count(F.lit(1)), F.sum(as_text)).first()
    return row[0], row[1] or 0


def fits_broadcast(df: DataFrame, row_limit: int = BROADCAST_ROWS, byte_limit: int = BROADCAST_BYTES) -> bool:
    rows, size = measured_size(df)
    return rows <= row_limit and size <= byte_limit


def join_small(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    salt_on: str,
    how: str = "inner",
    fits: bool | None = None,
    null_safe: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join a large table with a usually small one.

    The small side is broadcast when its counted size fits. Beyond that both sides are shuffled. Keys that at least
    ``hot_rows`` rows of the big side share get a salt: their rows spread over ``SALT_BUCKETS`` tasks by the hash of
    ``salt_on``. Every row of the big side has exactly one salt and meets all small rows of its key, so inner,
    left, semi and anti joins are exact. ``null_safe`` matches null keys with each other, as groups do.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type: {how}")
    if fits is None:
        fits = fits_broadcast(small)
    if fits:
        return _joined(big, F.broadcast(small), keys, how, null_safe)
    # only keys that many rows of the big side share are salted, and only their rows of the small side are copied
    hot = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= hot_rows)
    hot = hot.select(*keys, F.lit(True).alias("_hot"))
    salt = F.pmod(F.xxhash64(salt_on), F.lit(SALT_BUCKETS)).cast("int")
    every = F.sequence(F.lit(0), F.lit(SALT_BUCKETS - 1))
    marked = lambda df: _joined(df, hot, keys, "left", null_safe=True)
    salted_big = marked(big).withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(0)).drop("_hot")
    salted_small = marked(small).withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0))))
    ).drop("_hot")
    return _joined(salted_big, salted_small, [*keys, "_salt"], how, null_safe).drop("_salt")


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, null_safe: bool) -> DataFrame:
    if not null_safe:
        return left.join(right, list(keys), how)
    other = {k: f"_other_{k}" for k in keys}
    right = right.withColumnsRenamed(other)
    same = [F.col(k).eqNullSafe(F.col(o)) for k, o in other.items()]
    return left.join(right, same, how).drop(*other.values())


def running_sum(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    value: Column,
    name: str,
    block_rows: int = BLOCK_ROWS,
    levels: int = 2,
) -> DataFrame:
    """Inclusive running sum per group in the order of a unique whole-number column.

    A window over the group alone would put a hot group into one task. Here each group is cut into blocks of
    consecutive order values, so a task holds at most ``block_rows`` rows; the block totals are summed across
    the group by the same means, ``levels`` deep, which also covers order columns with wide gaps. Rows of a null
    group are a group like others; a null order is an error, as such a row has no place.

    The rows are written once, so a costly source is not computed again for the totals.
    """
    at = F.when(F.col(order).isNull(), F.raise_error(F.lit(f"null in order column {order}"))).otherwise(F.col(order))
    blocked = cut_lineage(df.withColumn("_block", F.floor(at / F.lit(block_rows))).withColumn("_value", value), "running")
    inside = W.partitionBy(*group, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    local = blocked.withColumn("_local", F.sum("_value").over(inside))
    totals = blocked.groupBy(*group, F.col("_block").alias("_at")).agg(F.sum("_value").alias("_total"))
    if levels > 1:
        upto = running_sum(totals, group, "_at", F.col("_total"), "_upto", block_rows, levels - 1)
    else:
        through = W.partitionBy(*group).orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
        upto = totals.withColumn("_upto", F.sum("_total").over(through))
    offsets = upto.select(*group, F.col("_at").alias("_block"), (F.col("_upto") - F.col("_total")).alias("_offset"))
    return (
        _joined(local, offsets, [*group, "_block"], "inner", null_safe=True)
        .withColumn(name, F.col("_local") + F.col("_offset"))
        .drop("_block", "_value", "_local", "_offset")
    )


def running_number(df: DataFrame, group: Sequence[str], order: str, name: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One-based position per group, by the same two levels."""
    return running_sum(df, group, order, F.lit(1), name, block_rows)
