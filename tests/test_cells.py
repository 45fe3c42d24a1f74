"""Vector search in cells beside the search that reads every vector."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmine.operators import cells, vectors


def grouped(seed=3, groups=40, each=50, width=12):
    """Vectors around well separated directions, with copies, zeros and rows that take no part."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, width))
    rows = np.repeat(middle, each, axis=0) + 0.1 * rng.normal(size=(groups * each, width))
    rows[5:200:7] = rows[5]
    rows = [[float(x) for x in r] for r in rows]
    odd = [[0.0] * width, [0.0] * width, None, [float("nan")] * width, [None] * width]
    return [(i, f"g{i % 3}" if i % 4 else None, v) for i, v in enumerate(rows + odd)]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(grouped(), "chunk_id long, group_key string, vector array<double>").repartition(4)


@pytest.fixture(scope="module")
def store(points):
    return cells.celled(points)


def asked(points, bound=False):
    every_ninth = points.where("chunk_id % 9 = 0 or chunk_id >= 1995")
    return every_ninth.select(F.col("chunk_id").alias("qid"), *(["group_key"] if bound else []), "vector")


def same(got, want):
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("bound, skip_self, blocks", [(False, True, (4096, 65536)), (True, False, (64, 512)), (False, False, (64, 512))])
def test_same_lists_as_the_full_search(points, store, bound, skip_self, blocks):
    queries = asked(points, bound)
    # rows bound to a key meet rows of that key, so the full search needs the key on both sides or on none
    all_points = points if bound else points.drop("group_key")
    got = cells.cells_topk(queries, store, 5, skip_self, *blocks)
    same(got, vectors.cosine_topk(queries, all_points, 5, skip_self))


def test_rings_are_left_out(points, store):
    """With groups in the data, a list of 5 needs a small part of the pairs."""
    queries = asked(points).where("qid < 1995")
    first = cells.first_rings(queries, store, 5)
    scored = cells._scored(first, "first", store, 5, False, 4096, 65536)
    both = cells.other_rings(first, store, scored, 5).select("slot", F.explode(F.concat("first", "rest")).alias("ring"))
    assert both.count() == both.distinct().count()
    rows = dict(zip(store.rings["ring"], store.rings["rows"]))
    pairs = sum(rows[r.ring] for r in both.collect())
    assert pairs < 0.2 * queries.count() * int(store.rings["rows"].sum())


def test_no_list_of_rings_travels_with_the_queries_of_the_second_search(points, store, monkeypatch):
    """On vectors without groups such a list would name all rings, whose number grows with the vectors."""
    written, cut = [], cells.cut_lineage
    monkeypatch.setattr(cells, "cut_lineage", lambda df, stem="step": written.append((stem, cut(df, stem))) or written[-1][1])
    queries = asked(points).where("qid < 1995")
    same(cells.cells_topk(queries, store, 5), vectors.cosine_topk(queries, points.drop("group_key"), 5))
    assert "rest" not in dict(written)
    visits = dict(written)["visits"]
    bundles = len({r // cells._bundle_width(store.rings) for r in store.rings["ring"]})
    assert visits.count() == queries.count() and visits.where(F.size("bundles") > bundles).count() == 0


def test_bounds_hold(spark):
    """No vector is closer to a query than the bound of its ring says, with directions that have no groups."""
    rng = np.random.default_rng(8)
    made = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(600, 6)))]
    store = cells.celled(spark.createDataFrame(made, "chunk_id long, vector array<double>"), cells=9, sample_rows=200)
    unit = np.array([v for _, v in made])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    bounds = cells._bounds(unit, store.rings, store.centres)
    column = {ring: i for i, ring in enumerate(store.rings["ring"])}
    at = {r["chunk_id"]: column[r["ring"]] for r in store.rows.collect()}
    assert len(at) == 600 == store.rings["rows"].sum()
    assert (unit @ unit.T <= bounds[:, [at[i] for i in range(600)]] + 1e-7).all()


def test_empty_and_odd_sides(spark, points, store):
    none = cells.celled(points.limit(0))
    assert cells.cells_topk(asked(points), none, 3).count() == 0
    assert cells.cells_topk(asked(points).limit(0), store, 3).count() == 0
    zeros = points.where("chunk_id in (2000, 2001, 2002)")
    got = cells.cells_topk(asked(points).where("qid in (0, 2001)"), cells.celled(zeros), 3)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 2000, 0.0), (0, 2, 2001, 0.0), (2001, 1, 2000, 0.0), (2001, 2, 2001, 0.0)]
    # one vector is its own centre; a null qid gets no list, as in the full search
    one = points.where("chunk_id = 9")
    both = one.select(F.explode(F.array(F.lit(None).cast("long"), F.lit(9))).alias("qid"), "vector")
    assert [tuple(r) for r in cells.cells_topk(both, cells.celled(one), 3).collect()] == [(9, 1, 9, 1.0)]
    assert vectors.cosine_topk(both, one.drop("group_key"), 3).where("qid is null").count() == 0
