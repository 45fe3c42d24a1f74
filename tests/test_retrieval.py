import math
import pickle
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfmine.operators import evaluation as ev
from shelfmine.operators import fusion, lexical, skew, vectors
from shelfmine.operators.lists import BestLists
from shelfmine.plans.suites import library
from shelfmine.session import fresh_table_path
from shelfmine.sources import index_store

TEXTS = {
    1: ("a", "the white rabbit ran to the white house"),
    2: ("a", "a rabbit and a hat"),
    3: ("b", "white clouds in the sky"),
    4: ("b", "nothing here"),
    5: ("ab", "rabbit rabbit rabbit"),
}


def chunks(spark):
    return spark.createDataFrame([(i, s, t) for i, (s, t) in TEXTS.items()], "chunk_id long, slug string, text string")


def expected_bm25(query):
    stop = {"the", "a", "an", "and", "of", "in", "to"}
    docs = {i: [w for w in t.split() if w not in stop] for i, (_, t) in TEXTS.items()}
    n, avgdl = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(w for d in docs.values() for w in set(d))
    out = {}
    for i, d in docs.items():
        tf, score = Counter(d), 0.0
        for w in query.split():
            if w in tf and w not in stop:
                idf = math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1)
                score += idf * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(d) / avgdl))
        out[i] = round(score, 6)
    return out


def ranked(rows):
    return [(r["chunk_id"], r["score"]) for r in sorted(rows, key=lambda r: r["rank"])]


@pytest.mark.parametrize("query", ["white rabbit", "rabbit rabbit sky", "unknown words"])
def test_bm25_matches_brute_force_with_padding(spark, query):
    queries = spark.createDataFrame([(0, query)], "qid int, query string")
    got = ranked(lexical.bm25_topk(queries, lexical.build_index(chunks(spark)), 4).collect())
    want = sorted(expected_bm25(query).items(), key=lambda x: (-x[1], x[0]))[:4]
    assert got == want


def test_slug_filter_keeps_global_statistics_and_is_exact(spark):
    index = lexical.build_index(chunks(spark))
    queries = spark.createDataFrame([(0, "white rabbit", "a"), (1, "white rabbit", None)], "qid int, query string, slug string")
    rows = lexical.bm25_topk(queries, index, 7, pad=False).collect()
    all_scores = expected_bm25("white rabbit")
    assert {r["chunk_id"] for r in rows if r["qid"] == 0} == {1, 2}
    assert all(r["score"] == all_scores[r["chunk_id"]] for r in rows)
    assert {r["chunk_id"] for r in rows if r["qid"] == 1} == {1, 2, 3, 5}


def test_salted_scoring_equals_broadcast_scoring(spark, monkeypatch):
    queries = spark.createDataFrame([(0, "white rabbit"), (1, "sky")], "qid int, query string")
    plain = lexical.bm25_topk(queries, lexical.build_index(chunks(spark)), 5).collect()
    monkeypatch.setattr(lexical, "fits_broadcast", lambda *_: False)
    salted = lexical.bm25_topk(queries, lexical.build_index(chunks(spark)), 5).collect()
    assert sorted(plain) == sorted(salted)


def many_chunks(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(40)]
    rows = [(f"c{i}", [None, "a", "b", "c"][i % 4], " ".join(rng.choice(words, size=i % 23))) for i in range(300)]
    rows += [(f"copy{i}", "a", "w1 w2 w3") for i in range(120)] + [("none", "b", None)]
    return spark.createDataFrame(rows, "chunk_id string, slug string, text string").repartition(3)


@pytest.mark.parametrize("by_slug", [False, True])
@pytest.mark.parametrize("stored", [False, True])
def test_best_chunks_are_those_of_all_scores(spark, monkeypatch, by_slug, stored):
    """Queries with and without a slug, over small stripes and few held results."""
    monkeypatch.setattr(lexical, "CELLS_HELD", 90)
    monkeypatch.setattr(lexical, "RESULTS_HELD", 60)
    asked = [(0, "w1 w2 w2 w5", None), (1, "w1 w2 w3", "a"), (2, "w7 nowhere", "b"), (3, "nowhere", None), (4, "w9 w30 w31", None), (5, "w3", "zz"), (6, None, None)]
    queries = spark.createDataFrame(asked, "qid int, query string, slug string")
    index = lexical.build_index(many_chunks(spark))
    if stored:
        index = lexical.LexicalIndex(index.lengths, index.postings, lexical.term_stats(index))
    per = ("qid", "slug") if by_slug else ("qid",)
    columns = [*per, "rank", "chunk_id", "score"]
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()), key=str)
    got = rows(lexical.bm25_best(queries, index, 4, by_slug))
    assert got == rows(lexical.top_k(lexical.bm25_scores(queries, index), 4, per))
    assert len(got) > 10


def test_best_chunks_exchange_no_pairs(spark):
    """Every task hands on its best rows only; pairs of queries and chunks are neither exchanged nor grouped."""
    queries = spark.createDataFrame([(i, f"w{i} w{i + 1}") for i in range(30)], "qid int, query string")
    found = lexical.bm25_topk(queries, lexical.build_index(many_chunks(spark)), 2, pad=False)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(chunk_id" not in plan and "keys=[qid" not in plan
    assert "hashpartitioning(qid" in plan


def test_tasks_of_bm25_need_no_package_on_executors(spark, monkeypatch):
    """Broadcast values are pickled by name, so none of them may hold a class of the package."""
    sent, send = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: sent.append(pickle.dumps(value)) or send(value))
    queries = spark.createDataFrame([(1, "white rabbit", None), (2, "rabbit", "a")], "qid int, query string, slug string")
    assert lexical.bm25_best(queries, lexical.build_index(chunks(spark)), 2).count() == 4
    assert len(sent) == 2 and not any(b"shelfmine" in value for value in sent)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_small_salted_equals_plain(spark, how):
    big = spark.range(500).select((F.col("id") % 7).alias("k"), "id")
    small = spark.range(3).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    want = sorted(map(tuple, big.join(small, "k", how).collect()), key=str)
    got = sorted(map(tuple, skew.join_small(big, small, ["k"], "id", how, fits=False, hot_rows=2).collect()), key=str)
    assert got == want


def test_running_sum_across_blocks(spark):
    rows = spark.range(100).select((F.col("id") % 2).alias("g"), F.col("id").alias("o"))
    got = skew.running_sum(rows, ["g"], "o", F.col("o"), "s", block_rows=7).collect()
    for g in (0, 1):
        total = 0
        for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["o"]):
            total += r["o"]
            assert r["s"] == total


def test_written_index_gives_the_same_ranking_without_exchange(spark):
    index = lexical.build_index(chunks(spark))
    queries = spark.createDataFrame([(0, "white rabbit")], "qid int, query string")
    folder = fresh_table_path(spark, "index")
    stored = index_store.write_index(index, "ix_test", folder, buckets=2)
    got = lexical.bm25_topk(queries, stored, 5)
    assert sorted(got.collect()) == sorted(lexical.bm25_topk(queries, index, 5).collect())
    scores = lexical.bm25_scores(queries, stored)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(qid" not in plan and "hashpartitioning(chunk_id" not in plan
    assert "PushedFilters: [In(term, [rabbit,white])" in plan or "PushedFilters: [In(term, [white,rabbit])" in plan
    index_store.drop_index(spark, "ix_test")
    with pytest.raises(index_store.IndexNotFound):
        index_store.open_index(spark, "ix_test")
    again = index_store.attach_index(spark, "ix_again", folder, buckets=2)
    assert sorted(lexical.bm25_topk(queries, again, 5).collect()) == sorted(got.collect())
    with pytest.raises(FileNotFoundError):
        index_store.attach_index(spark, "ix_none", folder + "-absent")


def test_reingestion_replaces_and_removal_keeps_similar_slugs(spark):
    index = lexical.build_index(chunks(spark))
    fresh = spark.createDataFrame([(9, "a", "new words")], "chunk_id long, slug string, text string")
    replaced = index_store.index_replacing(index, fresh)
    assert {r["chunk_id"] for r in replaced.lengths.collect()} == {3, 4, 5, 9}
    assert {r["chunk_id"] for r in replaced.postings.collect()} == {3, 4, 5, 9}


# ---------------------------------------------------------------- vectors


def brute_cosine(qv, pv, k):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(qv) @ unit(pv).T, 6) + 0.0
    return {q: [(int(i), scores[q, i]) for i in sorted(range(len(pv)), key=lambda i: (-scores[q, i], i))[:k]] for q in range(len(qv))}


@pytest.mark.parametrize("blocks", [(1000, 1000), (5, 8)])
@pytest.mark.parametrize("copies", [1, 40])
def test_cosine_blocks_match_brute_force(spark, blocks, copies):
    rng = np.random.default_rng(1)
    qv, base = rng.normal(size=(12, 6)), rng.normal(size=(30, 6))
    pv = np.concatenate([base] + [base[:1]] * (copies - 1))
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(qv)], "qid long, vector array<double>")
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(pv)], "chunk_id long, vector array<double>")
    rows = vectors.cosine_topk(queries, points, 4, query_block=blocks[0], vector_block=blocks[1]).collect()
    want = brute_cosine(qv, pv, 4)
    for q in want:
        assert ranked(r for r in rows if r["qid"] == q) == want[q]


def test_cosine_within_groups_and_empty_side(spark):
    queries = spark.createDataFrame([(1, "x", [1.0, 0.0]), (2, None, [0.0, 1.0])], "qid long, group_key string, vector array<double>")
    points = spark.createDataFrame(
        [("p", "x", [1.0, 1.0]), ("q", "y", [1.0, 0.0]), ("z", "x", [0.0, 0.0])], "chunk_id string, group_key string, vector array<double>"
    )
    rows = vectors.cosine_topk(queries, points, 3).collect()
    assert [r[0] for r in ranked(r for r in rows if r["qid"] == 1)] == ["p", "z"]
    assert [r[0] for r in ranked(r for r in rows if r["qid"] == 2)] == ["p", "q", "z"]
    assert vectors.cosine_topk(queries, points.limit(0), 3).count() == 0


@pytest.mark.parametrize("blocks", [(16_384, 65_536), (5, 8)])
def test_cosine_within_groups_by_blocks(spark, blocks, monkeypatch):
    """Groups of very different sizes, one of them all copies, on the grid of cells."""
    monkeypatch.setattr(vectors, "SHARED_QUERIES", 10)
    rng = np.random.default_rng(4)
    rows = [(i, "ab"[i % 2] if i < 100 else f"g{i}", [1.0, 2.0, 3.0] if i % 2 else [float(x) for x in rng.normal(size=3)]) for i in range(130)]
    points = spark.createDataFrame(rows, "chunk_id long, group_key string, vector array<double>")
    queries = points.withColumnRenamed("chunk_id", "qid")
    got = vectors.cosine_topk(queries, points, 4, True, *blocks).collect()
    unit = np.array([v for _, _, v in rows]) / np.linalg.norm([v for _, _, v in rows], axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 6) + 0.0
    for i, group, _ in rows:
        others = [j for j, g, _ in rows if g == group and j != i]
        want = [(j, scores[i, j]) for j in sorted(others, key=lambda j: (-scores[i, j], j))[:4]]
        assert ranked(r for r in got if r["qid"] == i) == want


def test_queries_of_a_group_meet_no_other_vectors(monkeypatch):
    """The products of a block are those within groups, not all pairs with most of them left out afterwards."""
    pairs = []
    add = vectors._Best.add
    monkeypatch.setattr(vectors._Best, "add", lambda self, part, asked=None: (pairs.append(len(self.qid) * len(part)), add(self, part, asked)))
    rows = pd.DataFrame({"qid": range(400), "group_key": [f"g{i % 10}" for i in range(400)], "vector": [np.array([1.0, i]) for i in range(400)]})
    meeting = vectors._Meeting(rows, 3, False)
    meeting.add(rows.rename(columns={"qid": "chunk_id"}))
    assert sum(pairs) == 10 * 40 * 40
    assert len(meeting.result()) == 400 * 3


@pytest.mark.parametrize("values", [3, 10_000])
def test_best_lists_in_stripes(values):
    """Lists that are kept while stripes pass by, with few distinct scores and with many, beside a full sort."""
    rng = np.random.default_rng(6)
    scores = np.round(rng.integers(0, values, size=(30, 900)) / values, 6)
    scores[0, 200:] = -np.inf
    scores[1] = -np.inf
    ids = rng.permutation(900)
    best = BestLists(30, 5)
    for start in range(0, 900, 150):
        part = scores[:, start : start + 150]
        exact = lambda r, c: part[r] if c is None else part[r, c]
        best.offer((part + np.where(part % 0.002 > 0.001, 1e-7, -1e-7)).astype(np.float32), ids[start : start + 150], exact, 1e-6)
    rows, found, got = best.result()
    for q in range(30):
        fine = [i for i in range(900) if np.isfinite(scores[q, i])]
        want = sorted(fine, key=lambda i: (-scores[q, i], ids[i]))[:5]
        assert list(zip(found[rows == q], got[rows == q])) == [(ids[i], scores[q, i]) for i in want]


def test_latest_points_and_fetch_order(spark):
    points = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "x")], "chunk_id string, seq int, text string")
    latest = vectors.latest_points(points, "seq")
    assert {r["chunk_id"]: r["text"] for r in latest.collect()} == {"a": "new", "b": "x"}
    ids = spark.createDataFrame([("b", 1), ("gone", 2), ("a", 3)], "chunk_id string, rank int")
    assert [r["chunk_id"] for r in vectors.points_by_ids(ids, latest).collect()] == ["b", "a"]


# ---------------------------------------------------------------- fusion and evaluation


def lists(spark, names):
    return spark.createDataFrame([(0, n, i) for i, n in enumerate(names, 1)], "qid int, chunk_id string, rank int")


FUSION = [
    (["a", "b", "c"], ["b", "c", "d"]),
    ([], []),
    (["a", "b"], []),
    (["a", "b"], ["c", "d"]),
    ([f"k{i}" for i in range(10)], [f"k{i}" for i in range(5, 15)]),
]


@pytest.mark.parametrize("keyword, vector", FUSION)
@pytest.mark.parametrize("k", [1, 3, 10])
def test_rrf(spark, keyword, vector, k):
    want = {}
    for names in (keyword, vector):
        for rank, name in enumerate(names, 1):
            want[name] = want.get(name, 0.0) + 1 / (60 + rank)
    order = sorted(want.items(), key=lambda x: -round(x[1], 6))[:k]
    rows = fusion.rrf_fusion(lists(spark, keyword), lists(spark, vector), k).orderBy("rank").collect()
    assert [r["chunk_id"] for r in rows] == [n for n, _ in order]


@pytest.mark.parametrize("alpha", [0.0, 0.5, 0.7, 1.0])
def test_weighted_fusion(spark, alpha):
    keyword, vector = ["a", "b", "c"], ["c", "a", "d"]
    want = {}
    for weight, names in ((alpha, keyword), (1 - alpha, vector)):
        for rank, name in enumerate(names, 1):
            want[name] = want.get(name, 0.0) + weight / rank
    order = [n for n, _ in sorted(want.items(), key=lambda x: -round(x[1], 6))]
    rows = fusion.weighted_fusion(lists(spark, keyword), lists(spark, vector), 7, alpha).orderBy("rank").collect()
    assert [r["chunk_id"] for r in rows] == order


def test_hit_and_mrr(spark):
    golden = spark.createDataFrame([(0, "a"), (1, "x")], "qid int, gold_id string")
    found = spark.createDataFrame([(0, "b", 1), (0, "a", 2), (1, "c", 1)], "qid int, chunk_id string, rank int")
    ranks = ev.gold_ranks(golden, found)
    row = ev.evaluate(ranks).first()
    assert (row["hit_rate_at_5"], row["mrr_at_5"], row["total_queries"]) == (0.5, 0.25, 2)
    assert [r["qid"] for r in ev.misses(ranks).collect()] == [1]
    empty = ev.evaluate(ranks.limit(0)).first()
    assert (empty["hit_rate_at_7"], empty["total_queries"]) == (0.0, 0)


def test_short_passages_are_found_too(spark):
    passages = spark.createDataFrame([(1, "ab"), (2, "quick brown"), (3, "one two three four five six seven eight nine")], "passage_id int, passage string")
    texts = spark.createDataFrame(
        [(1, "xaby"), (2, "the quick brown fox"), (3, "zero one two three four five six seven eight nine ten"), (4, "none")],
        "text_id int, text string",
    )
    got = {(r["passage_id"], r["text_id"]) for r in ev.passages_in_texts(passages, texts).collect()}
    assert got == {(1, 1), (2, 2), (3, 3)}


def test_even_sampling(spark):
    rows = spark.range(23).select(F.lit("g").alias("g"), F.col("id"))
    got = sorted(r["id"] for r in ev.sample_evenly(rows, "g", "id", size=5, skip_first=3).collect())
    assert got == [3, 7, 11, 15, 19]
    few = ev.sample_evenly(rows, "g", "id", size=50, skip_first=3).count()
    assert few == 20


def test_texts_are_embedded_once(spark):
    """Neither side of a vector search computes its vectors twice: one hash function in each plan."""
    from shelfmine.operators.models import HashingEmbedder
    from shelfmine.operators.vectors import cosine_topk

    rows = spark.createDataFrame([("a", "white rabbit"), ("b", None), ("c", "a pool of tears")], "chunk_id string, text string")
    points = HashingEmbedder().embed(rows, "text")
    wanted = points.select(F.col("chunk_id").alias("qid"), "vector")
    found = cosine_topk(wanted, points.select("chunk_id", "vector"), 2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1
    assert {r.qid for r in found.collect()} == {"a", "b", "c"} - ({"b"} if points.where("chunk_id = 'b' and vector is null").count() else set())


def test_second_search_reads_terms_and_not_texts(spark, monkeypatch):
    plans = []
    keep = lexical.cut_lineage

    def watched(df, stem):
        if stem == "matched":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return keep(df, stem)

    monkeypatch.setattr(lexical, "cut_lineage", watched)
    library.rephrase_and_retry(spark, "/root/testdata/sf0.001")
    assert len(plans) == 2 and not any("regexp_extract_all" in plan for plan in plans)
