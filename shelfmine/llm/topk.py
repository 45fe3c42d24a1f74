"""Exact inner-product search of sparse rows: term-at-a-time accumulation into dense score arrays.

Queries and candidates are cut into bounded blocks, and every (query block, candidate block) cell is one task group:
it holds the postings of its candidates by dimension, adds each query's weighted postings to a dense array of scores,
and keeps the best by partition selection. The cells' lists are merged by rank.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmine.session import cut_lineage

K = 10
SCALE = 1024
# rows of a cell on each side, about: rows are dealt to blocks by the hash of their number
QUERY_BLOCK = 1_024
CANDIDATE_BLOCK = 65_536
RESULT = "query bigint, query_id bigint, vec_id bigint, score bigint"


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of each component as 64-bit integers; null for a vector that takes no part.

    Vectors take no part if null or if a component is null or not finite. A component beyond 64 bits is an error.
    """
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    large = F.exists(vector, lambda x: F.abs(x.cast("double")) * scale >= 2.0**63)
    error = F.raise_error(F.lit(f"a component times {scale} needs more than 64 bits"))
    return F.when(fine & large, error).when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def postings(vectors: list[np.ndarray], kind: type = np.int64) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows with a weight other than 0 in each dimension, and these weights; as Python's integers with ``object``."""
    sizes = np.array([len(v) for v in vectors])
    row = np.repeat(np.arange(len(vectors)), sizes)
    values = np.concatenate(vectors).astype(np.int64).astype(kind) if len(vectors) else np.zeros(0, kind)
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    dim = np.arange(len(values)) - starts
    keep = values != 0
    row, dim, values = row[keep], dim[keep], values[keep]
    order = np.argsort(dim, kind="stable")
    edges = np.searchsorted(dim[order], np.arange(sizes.max(initial=0) + 1))
    return [(row[order[a:b]], values[order[a:b]]) for a, b in zip(edges, edges[1:])]


def accumulated(query: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]], n: int, kind: type = np.int64) -> np.ndarray:
    scores = np.zeros(n, dtype=kind)
    query = query.astype(kind)
    for dim in np.flatnonzero(query[: len(lists)]):
        rows, weights = lists[dim]
        if len(rows) == n:  # a list of all rows is in order
            scores += query[dim] * weights
        else:
            scores[rows] += query[dim] * weights
    return scores


def best(scores: np.ndarray, ids: np.ndarray, nameless: np.ndarray, k: int, others: np.ndarray) -> np.ndarray:
    """Places of the ``k`` highest scores among ``others``, ties to smaller ids and those without an id last."""
    scores = scores[others]
    if len(scores) > k:
        bound = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= bound)
    else:
        places = np.arange(len(scores))
    chosen = others[places]
    levels = np.unique(scores[places])  # unbounded integers cannot be sorted with others, their ranks can
    falling = -np.searchsorted(levels, scores[places])
    return chosen[np.lexsort((ids[chosen], nameless[chosen], falling))[:k]]


def search(
    rows: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    scale: int = SCALE,
    query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of highest inner product for each row that is a query.

    A query's own row is no candidate for it, other rows of its id are. Rows that repeat an id are candidates each, and
    queries each, with a list of their own; rows of a null id are candidates, after others of equal score. Vectors of
    different sizes meet in the dimensions that both have. Where sums could pass 64 bits they are made with unbounded
    integers, and a score in a list that needs more is an error. An empty table gives an empty result; other columns are
    not read.
    """
    whole = rows.select(
        rows[id_col].cast("long").alias("id"), quantised(rows[vector_col], scale).alias("v"), is_query.alias("asked")
    ).where(F.col("v").isNotNull())
    # numbers are written with the rows, so that every later read sees the same ones
    whole = cut_lineage(whole.withColumn("query", F.monotonically_increasing_id()), "vectors")
    size = F.aggregate("v", F.lit(0.0), lambda most, x: F.greatest(most, F.abs(x.cast("double"))))
    n, asked, most, longest = whole.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.col("asked").cast("long")), F.lit(0)), F.max(size), F.max(F.size("v"))
    ).first()
    kind = object if n and longest * most * most >= 2.0**62 else np.int64
    blocks, cells = max(1, -(-asked // query_block)), max(1, -(-n // candidate_block))
    # a column with nulls would reach pandas as doubles, so null ids are marked
    named = whole.withColumns({"nameless": F.col("id").isNull(), "id": F.coalesce("id", F.lit(0))})
    dealt = lambda parts: F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    queries = named.where("asked").select("query", "id", "v", dealt(blocks).alias("block"), each(cells).alias("cell"))
    candidates = named.select("query", "id", "nameless", "v", dealt(cells).alias("cell"), each(blocks).alias("block"))

    def cell(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        nameless = held["nameless"].to_numpy()
        ids, rows = held["id"].to_numpy(), held["query"].to_numpy()
        lists = postings(list(held["v"]), kind)
        out, scores = [], []
        for own, vector in zip(asked["query"], asked["v"]):
            total = accumulated(vector, lists, len(ids), kind)
            places = best(total, ids, nameless, k, np.flatnonzero(rows != own))
            if kind is object and any(abs(x) >= 2**63 for x in total[places]):
                raise OverflowError("a score needs more than 64 bits")
            out.append(places)
            scores.append(total[places])
        sizes = [len(p) for p in out]
        found = np.concatenate(out) if out else np.zeros(0, dtype=np.int64)
        return pd.DataFrame(
            {
                "query": np.repeat(asked["query"].to_numpy(), sizes),
                "query_id": np.repeat(asked["id"].to_numpy(), sizes),
                "vec_id": pd.array(ids[found], dtype="Int64"),
                "score": (np.concatenate(scores) if out else np.zeros(0)).astype(np.int64),
            }
        ).assign(vec_id=lambda df: df["vec_id"].mask(nameless[found]))

    found = queries.groupBy("block", "cell").cogroup(candidates.groupBy("block", "cell")).applyInPandas(cell, RESULT)
    order = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
