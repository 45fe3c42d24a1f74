import math
import random

import numpy as np
import pytest

from shelfmine.llm import queries, whitening


def plain(rows):
    """Rows by exact sums and numpy's own decomposition."""
    fine = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    size = max((len(x) for _, x in fine), default=0)
    fine = [(i, x) for i, x in fine if len(x) == size]
    n = len(fine)
    sums = [sum(col) for col in zip(*[x for _, x in fine])]
    deviation = [(i, sum((n * a - s) ** 2 for a, s in zip(x, sums))) for i, x in fine]
    z = np.array([[a - s / n for a, s in zip(x, sums)] for _, x in fine])
    values, vectors = np.linalg.eigh(z.T @ z / n)
    return n, deviation, z, values[::-1], vectors[:, ::-1]


def compare(got, rows, components):
    n, deviation, z, values, vectors = plain(rows)
    lines = sorted(got, key=lambda r: (r.component, str(r.vec_id), r.deviation))
    assert len(lines) == components * n and {r.n for r in lines} == {n}
    for k in range(1, components + 1):
        part = [r for r in lines if r.component == k]
        assert sorted((str(r.vec_id), r.deviation) for r in part) == sorted((str(i), d) for i, d in deviation)
        assert part[0].explained == pytest.approx(values[k - 1] / values.sum(), rel=1e-9)
        want = z @ vectors[:, k - 1] / math.sqrt(values[k - 1])
        by_row = sorted(zip([(str(i), d) for i, d in deviation], want))
        mine = [r.whitened for r in part]
        sign = np.sign(np.dot(mine, [w for _, w in by_row]))
        assert np.allclose(np.array(mine) * sign, [w for _, w in by_row], atol=1e-8)
    assert len({r.identity_error for r in lines}) == 1 and lines[0].identity_error <= 1e-4


def test_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    got = queries.QUERIES["op13_embedding_whitening"](spark, "/root/testdata/sf0.001").collect()
    compare(got, [(r.vec_id, r.embedding) for r in rows.collect()], 32)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, w string, n int")


def test_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1 + d) for d in range(5)]) for i in range(80)]
    rows += [(7, rows[7][1]), (None, rows[9][1]), (81, None), (82, [1.0, None, 0.0, 0.0, 0.0]), (83, [float("nan")] * 5)]
    rows += [(84, [float("-inf")] + [0.0] * 4), (85, []), (86, [1.0, 2.0])]
    compare(whitening.whitened(table(spark, rows)).collect(), rows, 5)


def test_rank_and_empty(spark):
    """Constant and dependent dimensions carry no component; one vector or none gives no row."""
    rng = random.Random(4)
    rows = []
    for i in range(60):
        a, b = rng.randrange(-500, 500), rng.randrange(-9, 9)
        rows.append((i, [a / 64, 2 * a / 64, 3.0, b / 64]))
    compare(whitening.whitened(table(spark, rows)).collect(), rows, 2)
    assert whitening.whitened(table(spark, rows[:1])).count() == 0
    assert whitening.whitened(table(spark, rows).where("false")).count() == 0
    assert whitening.whitened(table(spark, [(1, None), (2, [])])).count() == 0


def test_sums_beyond_64_bits_fail(spark):
    large = table(spark, [(i, [5e5 * (-1) ** i, float(i)]) for i in range(30)])
    compare(whitening.whitened(large).collect(), [(r.vec_id, r.embedding) for r in large.collect()], 2)
    many = large.crossJoin(spark.range(9_000)).drop("id")
    with pytest.raises(Exception, match="(?i)overflow|out of range"):
        whitening.whitened(many).count() if whitening.whitened(many).where("deviation is null").count() == 0 else None
    with pytest.raises(Exception, match="lies beyond"):
        whitening.whitened(table(spark, [(1, [1e300]), (2, [1.0])])).count()


@pytest.mark.parametrize("n", [1, 2, 7, 64, 130])
def test_eigen_against_numpy(n):
    rng = np.random.default_rng(n)
    basis = np.linalg.qr(rng.normal(size=(n, n)))[0]
    values = np.sort(10.0 ** rng.uniform(-6, 4, n))[::-1]
    matrix = basis * values @ basis.T
    got, vectors = whitening.eigen((matrix + matrix.T) / 2)
    assert np.allclose(got, values, rtol=1e-6, atol=1e-11 * values[0])
    assert np.allclose(vectors.T @ vectors, np.eye(n), atol=1e-12)
    assert np.allclose(vectors * got @ vectors.T, matrix, atol=1e-11 * values[0])


def test_graded_matrix_keeps_small_values():
    """Scaled rows: eigenvalues of very different size each keep their relative precision."""
    scale = np.diag(10.0 ** -np.arange(6.0))
    inner = np.full((6, 6), 0.1) + np.eye(6)
    got, _ = whitening.eigen(scale @ inner @ scale)
    expected = one_by_one(scale @ inner @ scale)
    assert np.allclose(got, expected, rtol=1e-10)


def one_by_one(matrix):
    """Eigenvalues by rational arithmetic: roots of the characteristic polynomial by Newton steps in fractions."""
    from fractions import Fraction

    n = len(matrix)
    a = [[Fraction(float(x)) for x in row] for row in matrix]
    poly, m = [Fraction(1)], [[Fraction(0)] * n for _ in range(n)]
    for k in range(1, n + 1):  # Faddeev and LeVerrier
        m = [[sum(a[i][l] * m[l][j] for l in range(n)) + (poly[-1] if i == j else 0) for j in range(n)] for i in range(n)]
        poly.append(-sum(a[i][l] * m[l][i] for i in range(n) for l in range(n)) / k)
    out = []
    for start in np.diag(matrix):
        x = Fraction(float(start))
        for _ in range(40):
            value = slope = Fraction(0)
            for c in poly:
                slope = slope * x + value
                value = value * x + c
            x = Fraction(float(x - value / slope))
        out.append(float(x))
    return np.sort(out)[::-1]
