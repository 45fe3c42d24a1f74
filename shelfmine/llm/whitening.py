"""Whitening of vectors by the eigenvectors of their covariance.

The centred scatter matrix is summed by the tasks, its size is that of one vector squared. Its pivoted Cholesky factor is
rotated by one-sided Jacobi steps until its columns are orthogonal: the squared norms of the columns are the eigenvalues,
the columns over their norms the eigenvectors. The covariance itself is never iterated on, so small eigenvalues keep their
relative precision. Then one more read projects the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
# whole numbers up to this size, so that sums of squares over a vector fit into 64 bits
LARGEST = 2**26
# rows worked on together in a task
ROWS = 4_096
SWEEPS = 60


def whole(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """``floor(scale * c) + shift`` of each entry as 64-bit integers; null for a vector that takes no part."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    large = F.exists(vector, lambda c: F.abs(c.cast("double")) * scale >= float(LARGEST))
    entries = F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long") + shift)
    error = F.raise_error(F.lit(f"an entry times {scale} lies beyond {LARGEST}"))
    return F.when(fine & large, error).when(fine, entries)


def pivoted_cholesky(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(factor, order)`` with ``matrix[order][:, order] = factor @ factor.T`` for a positive semidefinite matrix. The
    factor is lower triangular and has as many columns as the matrix has rank, up to rounding."""
    a = np.array(matrix, dtype=np.float64)
    n = len(a)
    order = np.arange(n)
    factor = np.zeros((n, n))
    left = np.diag(a).copy()
    stop = n * np.finfo(np.float64).eps * max(left.max(initial=0.0), 0.0)
    for k in range(n):
        p = k + int(left[k:].argmax())
        if left[p] <= stop:
            return factor[:, :k], order
        swap, back = [k, p], [p, k]
        a[swap], order[swap], left[swap], factor[swap] = a[back], order[back], left[back], factor[back]
        a[:, swap] = a[:, back]
        factor[k, k] = np.sqrt(left[k])
        factor[k + 1 :, k] = (a[k + 1 :, k] - factor[k + 1 :, :k] @ factor[k, :k]) / factor[k, k]
        left[k + 1 :] -= factor[k + 1 :, k] ** 2
    return factor, order


def rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Disjoint pairs of columns, so that all pairs have met after all rounds (a round-robin tournament)."""
    seats = np.arange(n + n % 2)
    for _ in range(len(seats) - 1):
        i, j = seats[: len(seats) // 2], seats[::-1][: len(seats) // 2]
        real = (i < n) & (j < n)
        yield i[real], j[real]
        seats = np.r_[seats[:1], seats[-1:], seats[1:-1]]


def one_sided_jacobi(factor: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """The factor times a rotation that makes its columns orthogonal, to the last bits of a double."""
    rows = np.ascontiguousarray(factor.T, dtype=np.float64)  # columns as rows, as pairs of them are rotated
    close = np.finfo(np.float64).eps * np.sqrt(max(len(factor), 1))
    for _ in range(sweeps):
        worst = 0.0
        for i, j in rounds(len(rows)):
            x, y = rows[i], rows[j]
            xx, yy, xy = (x * x).sum(1), (y * y).sum(1), (x * y).sum(1)
            cosine = np.abs(xy) / np.sqrt(xx * yy)
            worst = max(worst, cosine.max(initial=0.0))
            turn = cosine > close
            if not turn.any():
                continue
            i, j, x, y = i[turn], j[turn], x[turn], y[turn]
            zeta = (yy[turn] - xx[turn]) / (2 * xy[turn])
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            c = 1 / np.sqrt(1 + t * t)
            s = (c * t)[:, None]
            c = c[:, None]
            rows[i], rows[j] = c * x - s * y, s * x + c * y
        if worst <= close:
            return rows.T
    raise ArithmeticError(f"columns are not orthogonal after {sweeps} sweeps")


def eigen(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(values, vectors)`` of a positive semidefinite matrix by falling value; vectors are columns, and of those with a
    value above zero only."""
    factor, order = pivoted_cholesky(scatter)
    rotated = one_sided_jacobi(factor)
    norms = np.sqrt((rotated * rotated).sum(0))
    by_size = np.argsort(-norms, kind="stable")
    vectors = np.empty_like(rotated)
    vectors[order] = rotated / norms
    return norms[by_size] ** 2, vectors[:, by_size]


def summed(rows: DataFrame, vector: str, size: int, of_block) -> np.ndarray:
    """Sum over all rows of ``of_block(block)``, a matrix for each block of vectors; only such matrices leave a task, row by
    row, and they are added up by Spark."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for block in blocks(batches, vector, size):
            part = of_block(block)
            total = part if total is None else total + part
        if total is not None:
            flat = pa.array(list(total), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), flat], names=["i", "row"])

    parts = rows.select(vector).mapInArrow(partial, "i bigint, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    lines = cells.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "x"))).alias("row")).orderBy("i").collect()
    return np.array([[c.x for c in r.row] for r in lines])


def blocks(batches: Iterator[pa.RecordBatch], vector: str, size: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            column = batch.column(vector).slice(start, ROWS)
            yield column.flatten().to_numpy().reshape(len(column), size)


class Fit:
    """What a fit keeps: count and sums of the vectors, and the components."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n = n
        self.base = np.array([s // n for s in sums], dtype=np.int64)
        self.rest = np.array([s % n for s in sums], dtype=np.int64)
        self.values = np.zeros(0)
        self.vectors = np.zeros((len(sums), 0))
        self.trace = 0.0
        self.error = 0.0

    def centred(self, block: np.ndarray) -> np.ndarray:
        """``x - S / n``: the whole parts are subtracted first, so that nothing is lost to the size of ``x``."""
        return (block - self.base) - self.rest / self.n

    def whitened(self, block: np.ndarray) -> np.ndarray:
        return self.centred(block) @ (self.vectors / np.sqrt(self.values))


def fit(rows: DataFrame, vector: str, components: int = COMPONENTS) -> Fit | None:
    """Fit to the vectors of one size in ``rows``; None without rows. Only the sums by dimension and two matrices, of the
    vectors' size squared and of ``components`` squared, come to the driver."""
    sums = rows.select(F.posexplode(vector).alias("j", "x")).groupBy("j").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s"))
    sums = [int(r.s) for r in sums.orderBy("j").collect()]
    n = rows.count()
    if not sums:
        return None
    made, size = Fit(n, sums), len(sums)

    def scatter(block: np.ndarray) -> np.ndarray:
        z = made.centred(block)
        return z.T @ z

    total = summed(rows, vector, size, scatter) / n
    values, vectors = eigen((total + total.T) / 2)
    made.trace = float(np.trace(total))
    made.values, made.vectors = values[:components], vectors[:, :components]
    if len(made.values):
        mean = lambda block: made.whitened(block).sum(0, keepdims=True)
        middle = summed(rows, vector, size, mean) / n

        def spread(block: np.ndarray) -> np.ndarray:
            w = made.whitened(block) - middle
            return w.T @ w

        made.error = float(np.abs(summed(rows, vector, size, spread) / n - np.eye(len(made.values))).max())
    return made


def whitened(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """One row per vector and component: ``(vec_id, component, n, deviation, whitened, explained, identity_error)``.

    Vectors that are null or hold a null, infinite or not-a-number entry take no part; a vector shorter than the longest
    one counts as having nulls at its end. There are as many components as the covariance has eigenvalues above zero
    (up to rounding), at most ``components``: fewer vectors than dimensions, constant dimensions and copies give fewer, and
    one vector alone or an empty table gives no row. Equal eigenvalues leave the choice of their components open. Rows
    that repeat an id, and those of a null id, are vectors like others. Other columns are not read.

    ``deviation`` is exact; where it needs more than 64 bits, and where an entry is too large to be squared, the query
    fails with an error.
    """
    rows = vectors.select(vectors[id_col].alias("vec_id"), whole(vectors[vector_col]).alias("x")).where(F.col("x").isNotNull())
    size = rows.agg(F.max(F.size("x"))).first()[0] or 0
    rows = rows.where(F.size("x") == size)
    made = fit(rows, "x", components) if size else None
    kind = vectors.schema[id_col].dataType.simpleString()
    names = ["vec_id", "squares", "products", "w"]
    if made is None or len(made.values) == 0:
        lines = rows.where("false").select("vec_id", *[F.lit(0).cast("long").alias(c) for c in names[1:3]], F.array().cast("array<double>").alias("w"))
        n, rest_squared = 0, 0
    else:
        n, rest_squared = made.n, sum(int(r) ** 2 for r in made.rest)

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                done = 0
                for block in blocks(iter([batch]), "x", size):
                    whole_part = block - made.base
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("vec_id").slice(done, len(block)),
                            pa.array((whole_part * whole_part).sum(1)),
                            pa.array(whole_part @ made.rest),
                            pa.array(list(made.whitened(block)), pa.list_(pa.float64())),
                        ],
                        names=names,
                    )
                    done += len(block)

        lines = rows.mapInArrow(project, f"vec_id {kind}, squares bigint, products bigint, w array<double>")
    # n * x - S = n * (x - base) - rest, so its square is a sum of whole numbers, here in 38 digits
    number = lambda x: F.lit(str(x)).cast("decimal(38,0)")
    deviation = (
        number(n * n) * F.col("squares").cast("decimal(19,0)")
        - number(2 * n) * F.col("products").cast("decimal(19,0)")
        + number(rest_squared)
    )
    shares = F.array(*[F.lit(float(v / made.trace)) for v in made.values]) if n else F.array().cast("array<double>")
    out = lines.select("vec_id", deviation.cast("decimal(38,0)").cast("long").alias("deviation"), F.posexplode("w").alias("i", "whitened"))
    return out.select(
        "vec_id",
        (F.col("i") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("i")).alias("explained"),
        F.lit(made.error if n else 0.0).alias("identity_error"),
    )
