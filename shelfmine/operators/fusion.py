"""Rank fusion of a keyword list and a vector list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfmine.operators.lexical import SCORE_DIGITS

ALPHA = 0.7
RRF_CONSTANT = 60


def _stacked(keyword: DataFrame, vector: DataFrame) -> DataFrame:
    """Both ranked lists in one table. A union and one aggregate is cheaper than a full outer join."""
    return keyword.select("qid", "chunk_id", "rank", F.lit(0).alias("source")).unionByName(
        vector.select("qid", "chunk_id", "rank", F.lit(1).alias("source"))
    )


def _fused(stacked: DataFrame, weight: Column, k: int) -> DataFrame:
    """Sum the weights; ties go to the row met first, keyword list before vector list."""
    summed = stacked.groupBy("qid", "chunk_id").agg(
        F.round(F.sum(weight), SCORE_DIGITS).alias("score"),
        F.min(F.struct("source", "rank")).alias("_first"),
    )
    order = W.partitionBy("qid").orderBy(F.desc("score"), F.asc("_first"))
    return (
        summed.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("qid", "rank", "chunk_id", "score")
    )


def rrf_fusion(keyword: DataFrame, vector: DataFrame, k: int = 7, constant: int = RRF_CONSTANT) -> DataFrame:
    """Reciprocal rank fusion: sum of ``1 / (constant + rank)``."""
    return _fused(_stacked(keyword, vector), F.lit(1.0) / (F.lit(constant) + F.col("rank")), k)


def weighted_fusion(keyword: DataFrame, vector: DataFrame, k: int = 7, alpha: float | DataFrame = ALPHA) -> DataFrame:
    """``alpha / rank`` for the keyword list plus ``(1 - alpha) / rank`` for the vector list.

    ``alpha`` is one number, or a table ``(qid, alpha)`` for a weight per query.
    """
    stacked = _stacked(keyword, vector)
    if isinstance(alpha, DataFrame):
        stacked = stacked.join(alpha.select("qid", "alpha"), "qid")
        share = F.col("alpha")
    else:
        share = F.lit(float(alpha))
    weight = F.when(F.col("source") == 0, share).otherwise(F.lit(1.0) - share) / F.col("rank")
    return _fused(stacked, weight, k)
