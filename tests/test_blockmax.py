"""Block-max search beside the search that scores every chunk."""

import random

import pytest

from shelfmine.operators import blockmax, lexical

RARE = [f"word{i}" for i in range(400)]


def tables(spark, seed=1, n=600):
    """Texts of a few subjects: most words of a text are its subject's, some are common to all."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        subject = i % 12
        own = RARE[30 * subject : 30 * subject + 30]
        words = [rng.choice(own) if rng.random() < 0.7 else rng.choice(["white", "rabbit", "tea", "hat"]) for _ in range(rng.randrange(1, 60))]
        rows.append((i, f"s{i % 5}", " ".join(words + [f"topic{subject}"] * 5)))
    chunks = spark.createDataFrame([*rows, (9_000, "s1", ""), (9_001, None, "white tea")], "chunk_id long, slug string, text string")
    asked = [(q, " ".join(rows[q * 17 % n][2].split()[:8]), f"s{q % 6}" if q % 2 else None) for q in range(30)]
    asked += [(100, "white white hat", None), (101, "nothing known", None), (102, "", None), (103, "rabbit", "s1")]
    return chunks, spark.createDataFrame(asked, "qid int, query string, slug string")


@pytest.fixture(scope="module")
def made(spark):
    chunks, queries = tables(spark)
    index = lexical.build_index(chunks)
    return index, blockmax.blocked(index, 16), queries


@pytest.mark.parametrize("bound, pad", [(False, True), (True, False)])
def test_same_lists_as_the_full_search(made, bound, pad):
    index, blocks, queries = made
    queries = queries if bound else queries.drop("slug")
    got = blockmax.blockmax_topk(queries, blocks, 5, pad)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, lexical.bm25_topk(queries, index, 5, pad=pad).collect()))


def test_fewer_pairs_are_scored(made):
    index, blocks, queries = made
    queries = queries.drop("slug")
    every = lexical.bm25_scores(queries, index).count()
    scored = blockmax.scored_pairs(queries, blocks, 5)
    assert scored.count() == scored.select("qid", "chunk_id").distinct().count() < every / 2


def test_bounds_hold_for_every_posting(made):
    _, blocks, _ = made
    weight = lambda tf, dl: lexical.term_weight(tf, dl, blocks.avgdl)
    joined = blocks.postings.join(blocks.bounds, ["term", "block"])
    assert joined.where(weight(joined.tf, joined.dl) > weight(joined.max_tf, joined.min_dl) + 1e-12).count() == 0
    assert joined.count() == blocks.postings.count()
    assert blocks.postings.select("chunk_id", "block").distinct().count() == blocks.postings.select("chunk_id").distinct().count()


def test_postings_are_not_exchanged_for_the_bounds(spark, monkeypatch):
    chunks, _ = tables(spark, n=50)
    plans, cut = {}, blockmax.cut_lineage
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(blockmax, "cut_lineage", lambda df, stem: plans.update({stem: plan(df)}) or cut(df, stem))
    blocks = blockmax.blocked(lexical.build_index(chunks), 16)
    for stem in ("bounds", "block-postings"):
        after_unfolding, below = plans[stem].split("Generate", 1)
        assert "Exchange" not in after_unfolding and "Exchange" in below
    expected = {r["term"]: r["idf"] for r in lexical.term_stats(lexical.build_index(chunks)).collect()}
    assert {r["term"]: r["idf"] for r in blocks.stats.collect()} == pytest.approx(expected)


def test_empty_corpus(spark):
    chunks, queries = tables(spark, n=20)
    blocks = blockmax.blocked(lexical.build_index(chunks.where("false")))
    assert blockmax.blockmax_topk(queries.drop("slug"), blocks, 5).count() == 0
