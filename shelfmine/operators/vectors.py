"""Exact cosine search.

Both sides are cut into bounded blocks and every (query block, vector block) cell is one Arrow matrix product
that returns only its best ``k`` rows per query. No pair list is ever produced: the shuffle after the cells
carries at most ``k`` rows per query and cell. When the whole query side is counted to fit one block, the
vectors are not shuffled at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmine.functions.arrays import spans
from shelfmine.operators.lexical import top_k
from shelfmine.operators.lists import BestLists
from shelfmine.operators.skew import join_small

# a query side of this size goes to the tasks that read the vectors
SHARED_QUERIES = 1_024
# Every row is copied once per block of the other side, so blocks are large: the copies grow with the product of both tables
# over the block's size. Smaller tables are cut into at least MIN_CELLS cells of FEW rows and more, to use all cores.
QUERY_BLOCK = 16_384
VECTOR_BLOCK = 65_536
MIN_CELLS = 24
FEW = 1_024
MAX_BINS = 4_096
# queries and vectors of the product held at once inside a cell
QUERY_STRIPE = 1_024
STRIPE = 4_096


def _directed(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows whose vector has a direction. Checked here and not in the plan: a filter on a computed vector would be pushed
    below its computation and compute it again."""
    fine = [v is not None and bool(np.isfinite(np.asarray(v, dtype=np.float64)).all()) for v in rows["vector"]]
    return rows if all(fine) else rows[np.array(fine, dtype=bool)]


def _matrix(column: pd.Series) -> np.ndarray:
    if len(column) == 0:
        return np.zeros((0, 0))
    rows = np.stack([np.asarray(v, dtype=np.float64) for v in column])
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0.0, 1.0, norms)


class _Best:
    """Best ``k`` (score, chunk) per query among the stripes seen so far, in the order of the final sort.

    Products are taken in single precision; cells that may be listed are computed again in double precision. Where queries have a
    score ``least`` that ``k`` vectors are known to reach, lower ones are not looked at.
    """

    def __init__(self, queries: pd.DataFrame, k: int, skip_self: bool) -> None:
        queries = _directed(queries)
        self.qid = queries["qid"].to_numpy()
        self.matrix = _matrix(queries["vector"])
        self.rough = self.matrix.astype(np.float32)
        # sums of products of unit vectors in single precision, with both sides rounded to it
        self.error = (self.matrix.shape[1] + 8) * 2.0**-23
        self.lists = [BestLists(min(QUERY_STRIPE, len(self.qid) - at), k) for at in range(0, len(self.qid), QUERY_STRIPE)]
        if "least" in queries.columns:
            least = queries["least"].astype(float).fillna(-np.inf).to_numpy()
            for i, lists in enumerate(self.lists):
                lists.least[:] = least[i * QUERY_STRIPE : i * QUERY_STRIPE + lists.n]
        self.names = None
        if skip_self:
            codes, names = pd.factorize(self.qid)
            self.names = pd.Index(names)
            self.by_code = np.argsort(codes, kind="stable")
            self.ends = np.searchsorted(codes[self.by_code], np.arange(len(self.names) + 1))

    def _own(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells of a query and the vector of the same identifier."""
        code = self.names.get_indexer(ids) if len(self.names) else np.full(len(ids), -1)
        columns = np.flatnonzero(code >= 0)
        first, sizes = self.ends[code[columns]], self.ends[code[columns] + 1] - self.ends[code[columns]]
        return self.by_code[spans(first, sizes)], np.repeat(columns, sizes)

    def add(self, vectors: pd.DataFrame, asking: np.ndarray | None = None) -> None:
        """Meet some vectors; ``asking`` says which queries, all with a direction, meet them."""
        vectors = _directed(vectors)
        if len(vectors) == 0 or len(self.qid) == 0:
            return
        ids = vectors["chunk_id"].to_numpy()
        points = _matrix(vectors["vector"])
        rough = points.astype(np.float32)
        rows, columns = self._own(ids) if self.names is not None else (None, None)
        for i, lists in enumerate(self.lists):
            start = i * QUERY_STRIPE
            stop = start + lists.n
            some = None if asking is None else np.flatnonzero(asking[start:stop])
            if some is not None and len(some) == 0:
                continue
            at = slice(start, stop) if some is None else start + some
            scores = self.rough[at] @ rough.T
            if rows is not None:
                here = (rows >= start) & (rows < stop)
                own, column = rows[here] - start, columns[here]
                if some is not None:
                    met = np.isin(own, some)
                    own, column = np.searchsorted(some, own[met]), column[met]
                scores[own, column] = -np.inf
            block = self.matrix[at]

            def exact(r: np.ndarray, c: np.ndarray | None) -> np.ndarray:
                return block[r] @ points.T if c is None else np.einsum("ij,ij->i", block[r], points[c])

            lists.offer(scores, ids, exact, self.error, some)

    def result(self) -> pd.DataFrame:
        found = [(self.qid[i * QUERY_STRIPE + r], ids, scores) for i, x in enumerate(self.lists) for r, ids, scores in [x.result()]]
        found = [pd.DataFrame({"qid": q, "chunk_id": ids, "score": scores}) for q, ids, scores in found if len(q)]
        if not found:
            empty = pd.Series([], dtype=object)
            return pd.DataFrame({"qid": empty, "chunk_id": empty, "score": pd.Series([], dtype=float)})
        # a null qid gets no list
        return pd.concat(found).dropna(subset=["qid"])


class _Meeting:
    """A block of queries of any keys: those of a key meet vectors of that key only, those without one meet all."""

    def __init__(self, queries: pd.DataFrame, k: int, skip_self: bool) -> None:
        self.rows = {key: at for key, at in queries.reset_index(drop=True).groupby("group_key", sort=False).indices.items()}
        free = np.flatnonzero(queries["group_key"].isna().to_numpy())
        self.bound = {key: _Best(queries.iloc[at], k, skip_self) for key, at in self.rows.items()}
        self.free, self.free_rows = (_Best(queries.iloc[free], k, skip_self) if len(free) else None), free

    def add(self, points: pd.DataFrame, asking: np.ndarray | None = None) -> None:
        """Meet some vectors, in stripes; ``asking`` as in ``_Best.add``."""
        some = lambda rows: None if asking is None else asking[rows]
        if self.free is not None:
            for start in range(0, len(points), STRIPE):
                part = slice(start, start + STRIPE)
                self.free.add(points.iloc[part], some(self.free_rows))
        if self.bound:
            for key, at in points.reset_index(drop=True).groupby("group_key", sort=False).indices.items():
                if key in self.bound:
                    for start in range(0, len(at), STRIPE):
                        part = at[start : start + STRIPE]
                        self.bound[key].add(points.iloc[part], some(self.rows[key]))

    def result(self) -> pd.DataFrame:
        every = [*self.bound.values(), *([self.free] if self.free is not None else [])]
        return pd.concat([x.result() for x in every]) if every else _Best(pd.DataFrame({"qid": [], "vector": []}), 1, False).result()


def cosine_topk(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 7,
    skip_self: bool = False,
    query_block: int = QUERY_BLOCK,
    vector_block: int = VECTOR_BLOCK,
) -> DataFrame:
    """``(qid, rank, chunk_id, score)`` by exact cosine similarity.

    ``queries`` is ``(qid, vector)`` and ``vectors`` is ``(chunk_id, vector)``. When both carry a ``group_key``,
    a query with a non-null key only meets vectors of the same key (a slug, for instance). Vectors that are null or
    hold a null or non-finite component have no direction and take no part on either side.
    """
    # aliases give each side columns of its own, as both may come from one table
    own = lambda df, *names: _with_group(df).select(*[F.col(n).alias(n) for n in names])
    queries = own(queries, "qid", "group_key", "vector")
    vectors = own(vectors, "chunk_id", "group_key", "vector")
    schema = f"qid {_sql_type(queries, 'qid')}, chunk_id {_sql_type(vectors, 'chunk_id')}, score double"
    total, bound = queries.agg(F.count(F.lit(1)), F.count("group_key")).first()
    if total and bound == total:
        # every query is tied to a group, so vectors of other groups are dropped before any product
        groups = queries.select("group_key").distinct()
        vectors = join_small(vectors, groups, ["group_key"], "chunk_id", "left_semi").select(
            "chunk_id", "group_key", "vector"
        )
    if total <= min(query_block, SHARED_QUERIES):
        cells = _one_query_block(queries, vectors, k, skip_self, schema)
    else:
        cells = _block_grid(queries, vectors, k, skip_self, schema, query_block, vector_block, bound == total)
    return top_k(cells, k).select("qid", "rank", "chunk_id", "score")


def _with_group(df: DataFrame) -> DataFrame:
    return df if "group_key" in df.columns else df.withColumn("group_key", F.lit(None).cast("string"))


def _sql_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _one_query_block(queries: DataFrame, vectors: DataFrame, k: int, skip_self: bool, schema: str) -> DataFrame:
    """The counted, bounded query block goes to every task; vectors are streamed where they are stored."""
    shared = queries.sparkSession.sparkContext.broadcast(queries.toPandas())

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _Meeting(shared.value, k, skip_self)
        for batch in batches:
            best.add(batch)
        yield best.result()

    return vectors.mapInPandas(score, schema)


def _block_grid(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    skip_self: bool,
    schema: str,
    query_block: int,
    vector_block: int,
    by_group: bool,
) -> DataFrame:
    """Grid of cells; each row is repeated once per block of the other side, each cell holds bounded blocks.

    With ``by_group``, where every query is tied to a group, rows are first dealt to bins by group, so that a row is only
    repeated within its bin.
    """
    most = -(-max(queries.count(), vectors.count()) // FEW)
    bins = max(1, min(MAX_BINS, most)) if by_group else 1
    binned = lambda df: df.withColumn("_g", F.pmod(F.xxhash64("group_key"), F.lit(bins)).cast("int"))
    queries, vectors = binned(queries), binned(vectors)
    sizes = lambda df, name: df.groupBy("_g").agg(F.count(F.lit(1)).alias(name))
    # one row per bin, at most MAX_BINS
    counts = sizes(queries, "_nq").join(sizes(vectors, "_nv"), "_g").collect()
    each = -(-MIN_CELLS // max(1, len(counts)))
    layout = [(r["_g"], max(-(-r["_nq"] // query_block), min(-(-r["_nq"] // FEW), each)), -(-r["_nv"] // vector_block)) for r in counts]
    layout = F.broadcast(queries.sparkSession.createDataFrame(layout, "_g int, _qs int, _vs int"))
    across = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).cast("int")
    left = queries.join(layout, "_g").withColumn("_q", place("qid", "_qs")).withColumn("_v", across("_vs"))
    right = vectors.join(layout, "_g").withColumn("_v", place("chunk_id", "_vs")).withColumn("_q", across("_qs"))
    left, right = left.drop("_qs", "_vs"), right.drop("_qs", "_vs")

    def cell(block: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        best = _Meeting(block, k, skip_self)
        best.add(points)
        return best.result()

    return left.groupBy("_g", "_q", "_v").cogroup(right.groupBy("_g", "_q", "_v")).applyInPandas(cell, schema)


def latest_points(points: DataFrame, order: str) -> DataFrame:
    """Upsert semantics: the last version of each chunk wins. Copies are combined before the shuffle."""
    payload = [c for c in points.columns if c != "chunk_id"]
    return points.groupBy("chunk_id").agg(
        F.max_by(F.struct(*payload), F.col(order)).alias("_row")
    ).select("chunk_id", "_row.*")


def points_by_ids(ids: DataFrame, points: DataFrame) -> DataFrame:
    """Payload of the requested chunks in rank order; unknown identifiers disappear."""
    return ids.join(points, "chunk_id").orderBy(*[c for c in ("qid", "rank") if c in ids.columns])
