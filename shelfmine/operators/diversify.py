"""Spreading of conversation results over time and speakers.

The input is a ranked list per query, so a group never exceeds the ``k`` of the search that produced it. The
decision for a row depends on the rows accepted before it; that is one ordered fold over the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmine.operators.rows import numbered

MIN_GAP_SECONDS = 300
SPEAKER_CAP = 2
SMALL_LIST = 3
MIN_TARGET = 5


def speaker_cap(results: DataFrame, cap: int = SPEAKER_CAP, order: str = "rank") -> DataFrame:
    """At most ``cap`` rows per query and speaker, best first; rows without a speaker all stay.

    Spark keeps ``cap`` rows per task and key before the exchange, so a frequent speaker does no harm.
    """
    named = F.nullif(F.col("speaker"), F.lit("")).isNotNull()
    by_speaker = W.partitionBy("qid", "speaker").orderBy(order)
    capped = results.where(named).withColumn("_n", F.row_number().over(by_speaker)).where(F.col("_n") <= cap).drop("_n")
    return capped.unionByName(results.where(~named))


def _fold(items: Column, gap_seconds: int, cap: int) -> Column:
    """Ranks accepted in order. A row rejected for its time has already used up its speaker's quota."""
    empty = F.struct(
        F.expr("cast(array() as array<int>)").alias("picked"),
        F.expr("cast(array() as array<string>)").alias("charged"),
        F.expr("cast(null as timestamp_ntz)").alias("last"),
    )

    def step(acc: Column, item: Column) -> Column:
        named = F.nullif(item["speaker"], F.lit("")).isNotNull()
        used = F.size(F.filter(acc["charged"], lambda s: s == item["speaker"]))
        charged = F.when(named, F.array_append(acc["charged"], item["speaker"])).otherwise(acc["charged"])
        gap = F.abs(F.timestamp_diff("MICROSECOND", acc["last"], item["ts"]))
        near = F.coalesce(gap < F.lit(gap_seconds * 1_000_000), F.lit(False))
        accepted = F.struct(
            F.array_append(acc["picked"], item["rank"]).alias("picked"), charged.alias("charged"), item["ts"].alias("last")
        )
        skipped = F.struct(acc["picked"].alias("picked"), charged.alias("charged"), acc["last"].alias("last"))
        return F.when(named & (used >= cap), acc).when(near, skipped).otherwise(accepted)

    return F.aggregate(items, empty, step, lambda acc: acc["picked"])


def diversify(
    results: DataFrame, gap_seconds: int = MIN_GAP_SECONDS, cap: int = SPEAKER_CAP, target: int | None = None
) -> DataFrame:
    """``(qid, position, rank)`` of the rows kept from ``(qid, rank, speaker, ts)``.

    Lists of up to three rows stay as they are. Others are ordered by time, rows without a time last, then
    by rank; at most ``target`` rows are kept, by default the greater of five and half the list.
    """
    listed = results.groupBy("qid").agg(
        F.array_sort(
            F.collect_list(
                F.struct(F.col("ts").isNull().alias("untimed"), "ts", F.col("rank").cast("int").alias("rank"), "speaker")
            )
        ).alias("items")
    )
    count = F.size("items")
    goal = F.lit(target) if target is not None else F.greatest(F.lit(MIN_TARGET), F.floor(count / 2).cast("int"))
    by_rank = F.array_sort(F.transform("items", lambda i: i["rank"]))
    kept = F.when(count <= SMALL_LIST, by_rank).otherwise(F.slice(_fold(F.col("items"), gap_seconds, cap), 1, goal))
    return numbered(listed, kept, "_i", "rank", "qid").select(
        "qid", (F.col("_i") + 1).alias("position"), "rank"
    )
