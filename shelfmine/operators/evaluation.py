"""Retrieval quality: Hit@k and MRR@k against golden pairs, and golden-set handling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmine.functions.arrays import let, run_lengths
from shelfmine.functions.text import words
from shelfmine.operators.rows import unfolded_values
from shelfmine.operators.skew import join_small, running_number
from shelfmine.session import cut_lineage

K_VALUES = (5, 7)


def gold_ranks(golden: DataFrame, ranked: DataFrame) -> DataFrame:
    """Rank of the gold chunk of every golden query, null when it was not returned."""
    found = ranked.select("qid", F.col("chunk_id").alias("gold_id"), "rank")
    return golden.join(found, ["qid", "gold_id"], "left")


def _metrics(k_values: Sequence[int]) -> list[Column]:
    out: list[Column] = []
    for k in k_values:
        inside = F.col("rank") <= k
        out.append(F.round(F.coalesce(F.avg(F.when(inside, 1.0).otherwise(0.0)), F.lit(0.0)), 6).alias(f"hit_rate_at_{k}"))
        out.append(
            F.round(F.coalesce(F.avg(F.when(inside, 1.0 / F.col("rank")).otherwise(0.0)), F.lit(0.0)), 6).alias(f"mrr_at_{k}")
        )
    out.append(F.count(F.lit(1)).alias("total_queries"))
    return out


def evaluate(ranks: DataFrame, k_values: Sequence[int] = K_VALUES) -> DataFrame:
    """One row of averages over all golden queries; zeros for an empty set."""
    return ranks.agg(*_metrics(k_values))


def evaluate_by(ranks: DataFrame, column: str, k_values: Sequence[int] = K_VALUES) -> DataFrame:
    """Averages per slug and overall in one pass; the overall row carries ``ALL``."""
    return (
        ranks.rollup(column)
        .agg(F.grouping(column).alias("_all"), *_metrics(k_values))
        .withColumn(column, F.when(F.col("_all") == 1, F.lit("ALL")).otherwise(F.col(column)))
        .drop("_all")
    )


def misses(ranks: DataFrame, k: int = 5) -> DataFrame:
    """Golden queries whose chunk is absent from the first ``k``."""
    return ranks.where(F.col("rank").isNull() | (F.col("rank") > k))


def improvement(baseline: DataFrame, adaptive: DataFrame, k_values: Sequence[int] = K_VALUES) -> DataFrame:
    """Metric, both values, and the relative change in percent (null when the baseline is 0)."""
    names = [f"{m}_at_{k}" for k in k_values for m in ("hit_rate", "mrr")]

    def tall(df: DataFrame, value: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias(value)) for n in names])
        return df.select(F.inline(pairs))

    change = (F.col("adaptive") - F.col("baseline")) / F.nullif(F.col("baseline"), F.lit(0.0)) * 100.0
    return tall(baseline, "baseline").join(tall(adaptive, "adaptive"), "metric").withColumn(
        "change_percent", F.round(change, 6)
    )


def sample_evenly(chunks: DataFrame, group: str, order: str, size: int, skip_first: int = 0) -> DataFrame:
    """Every n-th chunk of each group after skipping its first ones; all of them when there are few."""
    positions = running_number(chunks, [group], order, "_position").where(F.col("_position") > skip_first)
    counts = chunks.groupBy(group).agg(F.greatest(F.count(F.lit(1)) - skip_first, F.lit(0)).alias("_left"))
    step = F.greatest(F.floor(F.col("_left") / F.lit(size)), F.lit(1))
    offset = F.col("_position") - 1 - skip_first
    return (
        join_small(positions, counts, [group], order, null_safe=True)
        .where((F.col("_left") <= size) | ((F.pmod(offset, step) == 0) & (F.floor(offset / step) < size)))
        .drop("_position", "_left")
    )


def golden_stats(golden: DataFrame) -> DataFrame:
    """Number of golden queries and their average per chunk."""
    per_chunk = golden.groupBy("gold_id").agg(F.count(F.lit(1)).alias("n"))
    return per_chunk.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_queries"),
        F.count(F.lit(1)).alias("chunks"),
        F.round(F.avg("n"), 6).alias("avg_per_chunk"),
    )


ANCHOR_WORDS = 6


def _shingles(tokens: Column, size: int) -> Column:
    """Distinct hashes of all runs of ``size`` words."""

    def hashed(all_tokens: Column) -> Column:
        last = F.size(all_tokens) - size
        run = lambda i: F.xxhash64(F.array_join(F.slice(all_tokens, i + 1, size), " "))
        return F.when(last >= 0, F.array_distinct(F.transform(F.sequence(F.lit(0), last), run)))

    return let(tokens, hashed)


def _character_runs(text: Column, size: int) -> Column:
    """Distinct hashes of all substrings of ``size`` characters."""
    last = F.length(text) - size
    return F.when(
        last >= 0,
        F.array_distinct(
            F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.substring(text, i + 1, F.lit(size))))
        ),
    )


def passages_in_texts(passages: DataFrame, texts: DataFrame, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """Pairs ``(passage_id, text_id)`` where the text contains the passage verbatim.

    Words inside a contained passage, all but its first and last, are whole words of the text too. So the pair
    shares a run of words, which turns the search into an equi-join on a hash; the containment is then checked
    on the joined rows alone. Passages with few words are anchored by a run of their characters instead.
    """
    inner = lambda t: F.slice(words(t), 2, F.greatest(F.size(words(t)) - 2, F.lit(0)))
    anchored = passages.withColumn("_inner", inner(F.col("passage")))
    long_anchor = anchored.where(F.size("_inner") >= anchor_words).select(
        "passage_id", F.xxhash64(F.array_join(F.slice("_inner", 1, anchor_words), " ")).alias("_anchor")
    )
    runs = unfolded_values(texts, _shingles(words(F.col("text")), anchor_words), "_anchor", "text_id")
    found = join_small(runs, long_anchor, ["_anchor"], "text_id").select("passage_id", "text_id")

    short = anchored.where((F.size("_inner") < anchor_words) & (F.length("passage") > 0))
    # one scan per distinct length, at most eight of them
    for row in short.select(F.least(F.length("passage"), F.lit(8)).alias("n")).distinct().collect():
        size = row["n"]
        anchors = short.where(F.least(F.length("passage"), F.lit(8)) == size).select(
            "passage_id", F.xxhash64(F.substring("passage", 1, size)).alias("_anchor")
        )
        runs = unfolded_values(texts, _character_runs(F.col("text"), size), "_anchor", "text_id")
        more = join_small(runs, anchors, ["_anchor"], "text_id").select("passage_id", "text_id")
        found = found.unionByName(more)

    # the candidate pairs are written once: counting them decides whether the texts must be shuffled
    pairs = cut_lineage(found)
    candidates = join_small(pairs, passages, ["passage_id"], "text_id")
    return (
        join_small(texts, candidates, ["text_id"], "text_id")
        .where(F.col("text").contains(F.col("passage")))
        .select("passage_id", "text_id")
    )


def golden_from_passages(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """One gold text per passage, the one with the smallest identifier, when several contain it."""
    return passages_in_texts(passages, texts).groupBy("passage_id").agg(F.min("text_id").alias("gold_id"))


def query_seeds(text: Column, count: int = 5) -> Column:
    """Offline stand-in for query generation: the most frequent longer words of a chunk, one query each."""
    runs = run_lengths(F.filter(words(text), lambda w: F.length(w) > 4))
    best = F.sort_array(F.transform(runs, lambda r: F.struct(-r["tf"], r["term"])))
    return F.slice(F.transform(best, lambda r: r["term"]), 1, count)
