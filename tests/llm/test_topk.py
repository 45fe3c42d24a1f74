import math
import random

import pytest

from shelfmine.llm import topk


def plain(rows, k=10):
    fine = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(fine):
        if q is not None and q % 100 == 0:
            others = [(-sum(x * y for x, y in zip(a, b)), i is None, i or 0) for m, (i, b) in enumerate(fine) if m != n]
            out += [(q, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(others)[:k])]
    return sorted(out, key=str)


def test_against_plain_search(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) if rng.random() < 0.7 else 0.0 for _ in range(12)]) for i in range(450)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)]  # ties
    rows += [(2000, None), (2001, [1.0, None]), (2100, [float("nan")] * 12), (2002, [float("inf")] * 12), (None, [1.0] * 12), (2003, []), (2200, [1.0, 2.0])]
    df = spark.createDataFrame(
        [(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, cell string"
    )
    for query_block, candidate_block in ((1024, 65536), (2, 60)):
        got = topk.search(df, df["vec_id"] % 100 == 0, query_block=query_block, candidate_block=candidate_block)
        assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_empty_and_few(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in topk.search(df, df["vec_id"] % 100 == 0).collect()] == [(0, 1, 1, 2 * 1024 * 1024)]
    assert topk.search(df.where("false"), df["vec_id"] % 100 == 0).count() == 0


def test_repeated_and_null_ids_and_large_components(spark):
    rows = [(100, [1.0, 2.0]), (100, [3.0, 1.0]), (7, [3.0, 1.0]), (None, [3.0, 1.0]), (None, [9.0, 9.0]), (200, [-1e6, 5e5]), (8, [1e6, 4e5])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = topk.search(df, df["vec_id"] % 100 == 0, k=4)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, 4)
    # sums of single terms beyond 64 bits that cancel are exact; a score beyond 64 bits is an error
    wide = [(0, [3e6, 3e6]), (1, [4e6, -4e6 + 1]), (2, [1.0, 1.0])]
    df = spark.createDataFrame(wide, "vec_id bigint, embedding array<double>")
    assert sorted(map(tuple, topk.search(df, df["vec_id"] % 100 == 0).collect())) == plain(wide)
    over = spark.createDataFrame([(0, [1e7]), (1, [1e7])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="more than 64 bits"):
        topk.search(over, over["vec_id"] % 100 == 0).collect()
    beyond = spark.createDataFrame([(0, [1e300]), (1, [1.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="more than 64 bits"):
        topk.search(beyond, beyond["vec_id"] % 100 == 0).collect()
