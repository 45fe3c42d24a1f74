"""Exact cosine search that leaves out cells of vectors which cannot reach a query's list.

Vectors are dealt to the nearest of a bounded number of centres and, within such a cell, to rings by their angle to the centre.
By the triangle inequality for angles, a query at angle t from a centre is at least ``t - high`` and at least ``low - t`` away from every
vector of a ring whose angles go from ``low`` to ``high``, which bounds the cosine from above. A query first scores the rings of
its highest bounds. The score of its k-th best vector there is a threshold, and of all rings it then scores those only whose
bound reaches it. A vector that is not scored could not have been in the list, so the result is that of ``vectors.cosine_topk``.

Rings are left out where vectors form groups. On vectors without any, all angles are alike, every bound is reached, and
``vectors.cosine_topk`` is the cheaper search, as it needs no first lists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmine.operators.lexical import SCORE_DIGITS, top_k
from shelfmine.operators.vectors import VECTOR_BLOCK, _directed, _Meeting, _matrix, _sql_type, _with_group
from shelfmine.session import cut_lineage, drop_steps

# centres are fitted on about this many rows; every row is dealt to its cell
SAMPLE_ROWS = 50_000
MAX_CELLS = 1_024
ITERATIONS = 8
# rings of a cell; with the cells this bounds the rings that the driver and every task know
RINGS = 32
# vectors that a query scores to get its threshold, for each result that it wants
FIRST_ROWS = 8
QUERY_BLOCK = 16_384
# cells are scored in bundles of at least this many vectors, so that a query is copied once per bundle and not once per ring
BUNDLE_ROWS = 4_096
# larger tables are cut into about this many bundles, of at most VECTOR_BLOCK vectors
BUNDLES = 12
# scores are rounded and angles near zero are exact to about 1e-8, so a bound counts as reached from this far below
SLACK = 2 * 10.0**-SCORE_DIGITS
# numbers of a table of bounds held at once
BOUNDS_HELD = 4_000_000
# ring of the vectors of length zero, whose cosine with everything is 0
NOWHERE = -1


@dataclass(frozen=True)
class VectorCells:
    """``rows(slot, chunk_id, group_key, vector, ring)``, the rings ``(ring, rows, low, high)`` and the centres."""

    rows: DataFrame
    rings: pd.DataFrame
    centres: np.ndarray


def _units(batch: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    batch = _directed(batch).reset_index(drop=True)
    return batch, _matrix(batch["vector"])


def _fitted(vectors: DataFrame, sample_rows: int, cells: int | None) -> np.ndarray:
    """Centres of length one from a sample of bounded expected size; none if no vector has a direction."""

    def directions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            _, unit = _units(batch)
            unit = unit[unit.any(axis=1)]
            if len(unit):
                yield pd.DataFrame({"unit": list(unit)})

    total = vectors.count()
    if total == 0:
        return np.zeros((0, 0))
    sample = vectors.select("vector").sample(False, min(1.0, sample_rows / total), seed=1)
    # the fit fails if it draws equal starting points, so copies are taken out of the sample and the start is drawn from the rest
    sample = cut_lineage(sample.mapInPandas(directions, "unit array<double>").distinct(), "directions")
    wanted = min(MAX_CELLS, cells or ceil(sqrt(total)), sample.count())
    if wanted < 2:
        return np.array([r["unit"] for r in sample.take(wanted)])
    points = sample.select(array_to_vector("unit").alias("unit"))
    model = KMeans(k=wanted, seed=1, initMode="random", maxIter=ITERATIONS, featuresCol="unit").fit(points)
    drop_steps(sample)
    centres = np.array(model.clusterCenters())
    lengths = np.linalg.norm(centres, axis=1, keepdims=True)
    return (centres / np.where(lengths == 0.0, 1.0, lengths))[lengths[:, 0] > 0.0]


def _angles(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ centres.T, -1.0, 1.0))


def celled(vectors: DataFrame, cells: int | None = None, sample_rows: int = SAMPLE_ROWS) -> VectorCells:
    """Cells of ``vectors(chunk_id, vector [, group_key])``, written once for any number of searches.

    Vectors that are null or hold a null or non-finite component are left out. Repeated rows stay repeated.
    """
    vectors = _with_group(vectors).select("chunk_id", "group_key", "vector")
    centres = _fitted(vectors, sample_rows, cells)
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch, unit = _units(batch)
            ring, angle = np.full(len(batch), NOWHERE), np.zeros(len(batch))
            at = np.flatnonzero(unit.any(axis=1))
            if len(at) and len(shared.value):
                angles = _angles(unit[at], shared.value)
                cell = angles.argmin(axis=1)
                angle[at] = angles[np.arange(len(at)), cell]
                ring[at] = cell * RINGS + np.minimum((angle[at] * (RINGS / pi)).astype(int), RINGS - 1)
            yield batch.assign(ring=ring, angle=angle)

    kind = lambda name: _sql_type(vectors, name)
    schema = f"chunk_id {kind('chunk_id')}, group_key {kind('group_key')}, vector {kind('vector')}, ring int, angle double"
    dealt = vectors.mapInPandas(deal, schema).withColumn("slot", F.monotonically_increasing_id())
    rows = cut_lineage(dealt.sortWithinPartitions("ring"), "cells")
    stats = rows.groupBy("ring").agg(F.count(F.lit(1)).alias("rows"), F.min("angle").alias("low"), F.max("angle").alias("high"))
    # at most MAX_CELLS * RINGS + 1 rows, whatever the table's size
    return VectorCells(rows.drop("angle"), stats.orderBy("ring").toPandas(), centres)


def _bounds(unit: np.ndarray, rings: pd.DataFrame, centres: np.ndarray) -> np.ndarray:
    """Upper bound of the cosine of each query with any vector of each ring."""
    ring = rings["ring"].to_numpy()
    bounds = np.zeros((len(unit), len(ring)))
    somewhere = ring != NOWHERE
    if somewhere.any():
        theta = _angles(unit, centres)[:, ring[somewhere] // RINGS]
        low, high = rings["low"].to_numpy()[somewhere], rings["high"].to_numpy()[somewhere]
        bounds[:, somewhere] = np.cos(np.maximum(np.maximum(theta - high, low - theta), 0.0))
        bounds[~unit.any(axis=1)] = 0.0
    return bounds


def _stripes(batches: Iterator[pd.DataFrame], rings: pd.DataFrame, centres: np.ndarray) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    step = max(1, BOUNDS_HELD // max(1, len(rings)))
    for batch in batches:
        batch, unit = _units(batch)
        for start in range(0, len(batch), step):
            yield batch.iloc[start : start + step], _bounds(unit[start : start + step], rings, centres)


def _with_rings(queries: DataFrame, cells: VectorCells, name: str, pick: Callable[[pd.DataFrame, np.ndarray], list]) -> DataFrame:
    """Queries with a list of rings, chosen from their bounds."""
    shared = queries.sparkSession.sparkContext.broadcast((cells.rings, cells.centres))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, bounds in _stripes(batches, *shared.value):
            if len(batch):
                yield batch.assign(**{name: pick(batch, bounds)})

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)
    return cut_lineage(queries.mapInPandas(choose, f"{fields}, {name} array<int>"), name)


def first_rings(queries: DataFrame, cells: VectorCells, k: int) -> DataFrame:
    """Queries with a ``slot`` of their own and, as ``first``, the rings of highest bounds that hold enough vectors."""
    queries = _with_group(queries).select("qid", "group_key", "vector").withColumn("slot", F.monotonically_increasing_id())
    ring, rows = cells.rings["ring"].to_numpy(), cells.rings["rows"].to_numpy()

    def pick(batch: pd.DataFrame, bounds: np.ndarray) -> list:
        # every ring holds a vector, so this many rings hold enough
        most = min(len(ring), FIRST_ROWS * k + 1)
        high = np.argpartition(-bounds, most - 1, axis=1)[:, :most]
        order = np.take_along_axis(high, np.argsort(-np.take_along_axis(bounds, high, axis=1), axis=1, kind="stable"), axis=1)
        taken = (np.cumsum(rows[order], axis=1) < FIRST_ROWS * k + 1).sum(axis=1) + 1
        return [ring[o[:n]] for o, n in zip(order, taken)]

    return _with_rings(queries, cells, "first", pick)


def _with_least(asked: DataFrame, scored: DataFrame, k: int) -> DataFrame:
    """``asked`` with the k-th score of each query as ``least``, null where there is none."""
    least = top_k(scored, k).where(F.col("rank") == k).select(F.col("qid").alias("_qid"), F.col("score").alias("least"))
    return asked.join(least, F.col("qid").eqNullSafe(F.col("_qid")), "left").drop("_qid")


def other_rings(asked: DataFrame, cells: VectorCells, scored: DataFrame, k: int) -> DataFrame:
    """``asked`` with, as ``rest``, the other rings whose bound reaches the k-th score; all of them where there is none. These
    are the rings that the second search reads beside the first ones."""
    ring = cells.rings["ring"].to_numpy()
    joined = _with_least(asked, scored, k)

    def pick(batch: pd.DataFrame, bounds: np.ndarray) -> list:
        least = batch["least"].astype(float).fillna(-np.inf).to_numpy()
        reached = bounds + SLACK >= least[:, None]
        return [ring[r & ~np.isin(ring, f)] for r, f in zip(reached, batch["first"])]

    return _with_rings(joined, cells, "rest", pick)


def _bundle_width(rings: pd.DataFrame) -> int:
    """Numbers of rings that make a bundle."""
    ring, rows = rings["ring"], rings["rows"]
    per_cell = rows.sum() / max(1, (ring // RINGS).nunique())
    wide = min(max(BUNDLE_ROWS, rows.sum() / BUNDLES), VECTOR_BLOCK)
    return RINGS * max(1, int(wide / max(1.0, per_cell)))


def _listed(block: pd.DataFrame, known: np.ndarray) -> np.ndarray:
    """Which of the ``known`` rings each query has in its list."""
    lists = [np.asarray(r, dtype=np.int64) for r in block["rings"]]
    query, ring = np.repeat(np.arange(len(lists)), [len(r) for r in lists]), np.concatenate(lists)
    place = np.minimum(np.searchsorted(known, ring), len(known) - 1)
    wanted = np.zeros((len(lists), len(known)), dtype=bool)
    here = known[place] == ring
    wanted[query[here], place[here]] = True
    return wanted


def _reached(block: pd.DataFrame, rings: pd.DataFrame, centres: np.ndarray) -> np.ndarray:
    """Which rings have a bound that reaches the query's ``least``."""
    parts = [b + SLACK >= q["least"].astype(float).fillna(-np.inf).to_numpy()[:, None] for q, b in _stripes([block], rings, centres)]
    return np.concatenate(parts) if parts else np.zeros((0, len(rings)), dtype=bool)


def _scored(asked: DataFrame, rings: str, cells: VectorCells, k: int, skip_self: bool, query_block: int, vector_block: int) -> DataFrame:
    """Best ``k`` of each query in each part of the bundles that hold the rings of its list."""
    width = _bundle_width(cells.rings)
    bundle = lambda column: F.floor(column / F.lit(width)).cast("int")
    bundles = F.explode(F.array_distinct(F.transform(rings, bundle)))
    pairs = asked.select("qid", "group_key", "vector", "slot", rings, bundles.alias("bundle"))
    inside = F.filter(rings, lambda r: bundle(r) == F.col("bundle")).alias("rings")
    pairs = pairs.select("qid", "group_key", "vector", "slot", "bundle", inside)
    return _met(pairs, cells, k, skip_self, query_block, vector_block)


def _scored_again(asked: DataFrame, cells: VectorCells, scored: DataFrame, k: int, skip_self: bool, query_block: int, vector_block: int) -> DataFrame:
    """Best ``k`` of each query among all vectors of rings whose bound reaches the k-th score so far, the first rings among them.

    A query carries its k-th score and the bundles to visit. Which rings count is found again in the cells, as lists of rings
    would grow with the vectors and be copied with each query.
    """
    width = _bundle_width(cells.rings)
    shared = asked.sparkSession.sparkContext.broadcast((cells.rings, cells.centres))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rings, centres = shared.value
        names, first = np.unique(rings["ring"].to_numpy() // width, return_index=True)
        for batch in batches:
            # rings are in order, so those of a bundle are neighbours
            batch = _directed(batch).reset_index(drop=True)
            if len(batch) and len(names):
                reached = np.logical_or.reduceat(_reached(batch, rings, centres), first, axis=1)
                yield batch.assign(bundles=[names[r] for r in reached])

    joined = _with_least(asked, scored, k).select("qid", "group_key", "vector", "slot", "least")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema)
    visits = cut_lineage(joined.mapInPandas(visit, f"{fields}, bundles array<int>"), "visits")
    pairs = visits.select("qid", "group_key", "vector", "slot", "least", F.explode("bundles").alias("bundle"))
    return _met(pairs, cells, k, skip_self, query_block, vector_block)


def _met(pairs: DataFrame, cells: VectorCells, k: int, skip_self: bool, query_block: int, vector_block: int) -> DataFrame:
    """Queries ``pairs(qid, group_key, vector, slot, bundle)`` meet the rings that they want in their bundle: those of ``rings`` or,
    without it, those whose bound reaches ``least``. A bundle is copied for every ``query_block`` queries that ask for one of
    its rings, and cut into parts of ``vector_block`` rows."""
    spark = pairs.sparkSession
    width = _bundle_width(cells.rings)
    sizes = cells.rings.groupby(cells.rings["ring"] // width)["rows"].sum().rename_axis("bundle").reset_index(name="rows")
    sizes = spark.createDataFrame(sizes, "bundle int, rows long")
    parts = lambda n, size: F.ceil(F.col(n) / F.lit(size)).cast("int")
    # one row per bundle, so its size has the bound of the rings
    layout = pairs.groupBy("bundle").agg(F.count(F.lit(1)).alias("asking")).join(F.broadcast(sizes), "bundle")
    layout = F.broadcast(layout.select("bundle", parts("asking", query_block).alias("_qs"), parts("rows", vector_block).alias("_vs")))
    part = lambda n: F.pmod("slot", n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    choice = "rings" if "rings" in pairs.columns else "least"
    left = pairs.join(layout, "bundle").select("qid", "group_key", "vector", choice, "bundle", part("_qs").alias("_q"), each("_vs").alias("_v"))
    right = cells.rows.withColumn("bundle", F.floor(F.col("ring") / F.lit(width)).cast("int")).join(layout, "bundle")
    right = right.select("chunk_id", "group_key", "vector", "ring", "bundle", part("_vs").alias("_v"), each("_qs").alias("_q"))
    shared = spark.sparkContext.broadcast((cells.rings, cells.centres))

    def cell(block: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        block, points = _directed(block).reset_index(drop=True), _directed(points)
        if len(block) and choice == "rings":
            # queries of one ring become neighbours
            block = block.iloc[np.argsort([min(r) for r in block["rings"]], kind="stable")].reset_index(drop=True)
        best = _Meeting(block, k, skip_self)
        if len(block) == 0 or len(points) == 0:
            return best.result()
        points = points.iloc[np.argsort(points["ring"].to_numpy(), kind="stable")]
        known, first = np.unique(points["ring"].to_numpy(), return_index=True)
        ends = np.append(first[1:], len(points))
        if choice == "rings":
            wanted = _listed(block, known)
        else:
            rings, centres = shared.value
            wanted = _reached(block, rings[rings["ring"].isin(known)], centres)
        # rings that most queries want are met by all in one product, which adds pairs but no wrong ones; others by their own queries
        share = wanted.mean(axis=0)
        dense = share > 0.5
        place = np.repeat(np.arange(len(known)), ends - first)
        best.add(points.iloc[np.flatnonzero(dense[place])])
        for i in np.flatnonzero(~dense & (share > 0.0)):
            best.add(points.iloc[first[i] : ends[i]], asking=wanted[:, i])
        return best.result()

    schema = f"qid {_sql_type(pairs, 'qid')}, chunk_id {_sql_type(cells.rows, 'chunk_id')}, score double"
    keys = ("bundle", "_q", "_v")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(cell, schema)


def cells_topk(
    queries: DataFrame,
    cells: VectorCells,
    k: int = 7,
    skip_self: bool = False,
    query_block: int = QUERY_BLOCK,
    vector_block: int = VECTOR_BLOCK,
) -> DataFrame:
    """``(qid, rank, chunk_id, score)``, the rows of ``vectors.cosine_topk``.

    A query with a ``group_key`` meets vectors of that key only; rings do not know keys, so such a query has a threshold only if
    its first rings hold ``k`` vectors of the key. Queries of length zero score 0 everywhere and read every ring;
    a query whose ``qid`` is null gets no list.
    """
    asked = first_rings(queries, cells, k)
    first = cut_lineage(_scored(asked, "first", cells, k, skip_self, query_block, vector_block), "scores")
    # the first rings are read again, with all others, so no pair has to be left out there and none comes twice
    second = _scored_again(asked, cells, first, k, skip_self, query_block, vector_block)
    return top_k(second, k).select("qid", "rank", "chunk_id", "score")
