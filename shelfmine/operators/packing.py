"""Packing of consecutive turns into chunks of bounded size.

The end of a chunk depends only on its start, because token prefix sums never fall. The starts form a chain:
each chunk begins a few turns before the end of the previous one.

Ordinary conversations are packed in their own row. A conversation too large for one row is packed set-wise:
the end of every possible start comes from an as-of lookup in buckets of prefix sums, and the chain is followed
by pointer doubling, so no task ever holds the conversation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmine.operators.rows import unfolded, unfolded_values
from shelfmine.operators.skew import join_small, running_number, running_sum
from shelfmine.session import cut_lineage

ROW_TURNS = 20_000
BOUNDS = "array<struct<first int, past int, tokens bigint>>"


def packed_bounds(counts: Column, max_tokens: int, overlap: int) -> Column:
    """Half-open turn ranges of the chunks, from the token counts of one conversation in order."""

    @F.pandas_udf(BOUNDS)
    def pack(column: pd.Series) -> pd.Series:
        return column.map(lambda tokens: _bounds(np.asarray(tokens, dtype=np.int64), max_tokens, overlap))

    return pack(counts)


def _bounds(tokens: np.ndarray, max_tokens: int, overlap: int) -> list[dict]:
    total = np.concatenate([[0], np.cumsum(tokens)])
    # last turn count that still fits, for every start at once; the first turn is always admitted
    past = np.searchsorted(total, total[:-1] + max_tokens, side="right") - 1
    past = np.maximum(past, np.arange(1, len(tokens) + 1))
    chunks, start = [], 0
    while start < len(tokens):
        end = int(past[start])
        chunks.append({"first": start, "past": end, "tokens": int(total[end] - total[start])})
        start = max(start + 1, end - overlap)
    return chunks


def pack_turns(
    turns: DataFrame,
    group: str,
    order: str,
    tokens: str,
    line: str,
    max_tokens: int = 500,
    overlap: int = 2,
    row_turns: int = ROW_TURNS,
) -> DataFrame:
    """``(group, section, turn_start, turn_end, num_turns, num_tokens, text)`` from one row per turn.

    ``order`` is a unique whole number within its group, ``line`` the rendered turn.
    """
    rows = turns.select(group, order, F.col(tokens).cast("long").alias("tok"), F.col(line).alias("line"))
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.where(F.col("_n") > row_turns).select(group)
    columns = [group, "section", "turn_start", "turn_end", "num_turns", "num_tokens", "text"]
    if large.isEmpty():
        return _pack_rows(rows, group, order, max_tokens, overlap).select(*columns)
    ordinary = _pack_rows(join_small(rows, large, [group], order, "left_anti"), group, order, max_tokens, overlap)
    spread = _pack_spread(join_small(rows, large, [group], order, "left_semi"), group, order, max_tokens, overlap)
    return ordinary.select(*columns).unionByName(spread.select(*columns))


def _pack_rows(rows: DataFrame, group: str, order: str, max_tokens: int, overlap: int) -> DataFrame:
    gathered = rows.groupBy(group).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("turn"), "tok", "line"))).alias("turns")
    )
    bounds = packed_bounds(F.transform("turns", lambda t: t["tok"]), max_tokens, overlap)
    chunks = F.transform(
        "bounds",
        lambda b, i: F.struct(
            (i + 1).cast("long").alias("section"),
            b["tokens"].alias("num_tokens"),
            F.slice("turns", b["first"] + 1, b["past"] - b["first"]).alias("own"),
        ),
    )
    return (
        unfolded(gathered.withColumn("bounds", bounds), chunks, "section", group)
        .select(
            group,
            "section",
            F.get("own", F.lit(0))["turn"].alias("turn_start"),
            F.element_at("own", -1)["turn"].alias("turn_end"),
            F.size("own").cast("long").alias("num_turns"),
            "num_tokens",
            F.array_join(F.transform("own", lambda t: t["line"]), "\n").alias("text"),
        )
    )


def _pack_spread(rows: DataFrame, group: str, order: str, max_tokens: int, overlap: int) -> DataFrame:
    numbered = running_number(rows, [group], order, "pos")
    placed = cut_lineage(running_sum(numbered, [group], "pos", F.col("tok"), "upto"))
    ends = cut_lineage(_chunk_ends(placed.select(group, "pos", "tok", "upto"), group, max_tokens))
    # the chunk starting at pos covers [pos, past); the chain goes on at nxt
    nxt = F.greatest(F.col("pos") + 1, F.col("past") - overlap)
    count = placed.groupBy(group).agg(F.max("pos").alias("_last"))
    steps = join_small(ends, count, [group], "pos").select(group, "pos", F.when(nxt <= F.col("_last"), nxt).alias("nxt"))
    starts = _chain(steps, group)
    chosen = running_number(starts, [group], "pos", "section").join(ends, [group, "pos"])
    spans = chosen.select(
        group,
        "section",
        F.col("pos").alias("_start"),
        F.explode(F.sequence(F.col("pos"), F.col("past") - 1)).alias("pos"),
    )
    return (
        spans.join(placed, [group, "pos"])
        .groupBy(group, "section")
        .agg(
            F.min(order).alias("turn_start"),
            F.max(order).alias("turn_end"),
            F.count(F.lit(1)).alias("num_turns"),
            F.sum("tok").alias("num_tokens"),
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda t: t["line"]), "\n"
            ).alias("text"),
        )
    )


def _chunk_ends(placed: DataFrame, group: str, max_tokens: int) -> DataFrame:
    """``past`` for every start: one after the last turn whose prefix sum stays within the limit.

    A start looks up the greatest prefix sum not above its own limit. Unless the first turn alone exceeds the
    limit, that sum is at most ``max_tokens`` smaller, so it lies in the same bucket of width ``max_tokens`` or
    in the one before. Equal sums are merged first, which bounds a bucket by ``max_tokens`` values.
    """
    width = F.lit(max_tokens)
    sums = placed.groupBy(group, F.col("upto").alias("at")).agg(F.max("pos").alias("reach"))
    sums = sums.withColumn("bucket", F.floor(F.col("at") / width))
    limits = placed.where(F.col("tok") <= max_tokens).select(
        group, (F.col("upto") - F.col("tok") + max_tokens).alias("at")
    ).distinct()
    limits = limits.withColumn("bucket", F.floor(F.col("at") / width))
    events = sums.select(group, "bucket", "at", "reach").unionByName(
        limits.select(group, "bucket", "at", F.lit(None).cast("long").alias("reach"))
    )
    as_of = W.partitionBy(group, "bucket").orderBy("at", F.col("reach").isNull()).rowsBetween(W.unboundedPreceding, 0)
    seen = events.withColumn("seen", F.max("reach").over(as_of)).where(F.col("reach").isNull())
    tops = sums.groupBy(group, (F.col("bucket") + 1).alias("bucket")).agg(F.max("reach").alias("below"))
    resolved = seen.join(tops, [group, "bucket"], "left").select(
        group, "at", F.coalesce("seen", "below").alias("reach")
    )
    fits = placed.withColumn("at", F.col("upto") - F.col("tok") + max_tokens).join(resolved, [group, "at"], "left")
    alone = F.col("tok") > max_tokens
    return fits.select(
        group, "pos", F.when(alone, F.col("pos") + 1).otherwise(F.col("reach") + 1).alias("past")
    )


def _chain(steps: DataFrame, group: str) -> DataFrame:
    """Positions reached from the first one by following ``nxt``: jumps double in every round."""
    reached = cut_lineage(steps.groupBy(group).agg(F.min("pos").alias("pos")))
    jumps = cut_lineage(steps.where(F.col("nxt").isNotNull()))
    while not jumps.isEmpty():
        landed = reached.join(jumps, [group, "pos"]).select(group, F.col("nxt").alias("pos"))
        reached = cut_lineage(reached.unionByName(landed).distinct())
        second = jumps.select(group, F.col("pos").alias("nxt"), F.col("nxt").alias("_after"))
        jumps = cut_lineage(
            jumps.join(second, [group, "nxt"]).select(group, "pos", F.col("_after").alias("nxt"))
        )
    return reached


def fixed_turn_windows(
    turns: DataFrame, group: str, order: str, line: str, size: int = 10, overlap: int = 2
) -> DataFrame:
    """Windows of a fixed number of turns: ``(group, section, num_turns, text)``.

    Every turn is sent to the windows that cover it, so a task gathers at most ``size`` turns at a time.
    """
    step = size - overlap
    placed = running_number(turns.select(group, order, F.col(line).alias("line")), [group], order, "_n")
    at = F.col("_n") - 1
    first = F.greatest(F.floor((at - size + step) / F.lit(step)), F.lit(0))
    covering = F.sequence(first, F.floor(at / F.lit(step)))
    return (
        unfolded_values(placed, covering, "window", group, order, "line")
        .groupBy(group, (F.col("window") + 1).alias("section"))
        .agg(
            F.count(F.lit(1)).alias("num_turns"),
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda t: t["line"]), "\n"
            ).alias("text"),
        )
    )


def kept_history(
    messages: DataFrame, group: str, order: str, tokens: Column, head: Column, budget: int = 50_000
) -> DataFrame:
    """Messages that survive truncation: the head, and the newest others within the token budget.

    The oldest messages go first; at least one message beside the head always stays. ``head`` marks the system
    row. Sums run over bounded blocks, so a very long history is spread over many tasks.
    """
    flagged = messages.withColumn("_head", head).withColumn("_tokens", tokens)
    totals = flagged.groupBy(group).agg(
        F.sum("_tokens").alias("_total"), F.max(F.when(~F.col("_head"), F.col(order))).alias("_newest")
    )
    summed = running_sum(flagged, [group], order, F.when(F.col("_head"), F.lit(0)).otherwise(F.col("_tokens")), "_upto")
    before = F.col("_upto") - F.col("_tokens")
    keep = F.col("_head") | (F.col("_total") - before <= budget) | (F.col(order) == F.col("_newest"))
    return (
        join_small(summed, totals, [group], order, null_safe=True)
        .where(keep)
        .drop("_head", "_tokens", "_total", "_newest", "_upto")
    )
