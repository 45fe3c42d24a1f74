import random

import numpy as np
import pytest
from conftest import prose

from shelfmine.llm import jaccard
from shelfmine.llm.components import components


def plain(docs, similarity=0.8):
    sets = []
    for _, text in docs:
        w = (text or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    n = len(docs)
    links = [[j for j in range(n) if i != j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9] for i in range(n)]
    seen, classes = {}, []
    for i in range(n):
        if i in seen:
            continue
        todo, members = [i], {i}
        while todo:
            for j in links[todo.pop()]:
                if j not in members:
                    members.add(j)
                    todo.append(j)
        seen |= dict.fromkeys(members, min(docs[m][0] for m in members))
    return sorted((docs[i][0], seen[i], len(links[i])) for i in range(n))


def family(seed, base, copies):
    rng = random.Random(seed)
    out = []
    for _ in range(copies):
        words = base.split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"new{rng.randint(0, 999)}"
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def documents():
    texts = [prose(i, 60) for i in range(40)]
    for s in range(8):
        texts += family(s, prose(100 + s, 150), 6)
    texts += family(50, prose(200, 120), 70)  # a large dense group
    shared = prose(300, 30)
    texts += [f"{shared} {prose(400 + i, 90)}" for i in range(60)]  # a common passage alone is no link
    texts += [texts[0]] * 12 + ["two words", "two words", "two  words", "one"]
    random.Random(1).shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("bucket", [256, 8])
def test_against_all_pairs(spark, documents, bucket):
    df = spark.createDataFrame(documents, "doc_id bigint, text string")
    got = sorted(map(tuple, jaccard.join_report(df, bucket=bucket).collect()))
    assert got == plain(documents)


def test_one_of_each_class_stays(spark, documents):
    df = spark.createDataFrame([(*d, "x") for d in documents], "doc_id bigint, text string, node string")
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in plain(documents)})


def test_odd_rows(odd_docs, no_docs):
    rows = jaccard.join_report(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.n_links == 0 and r.class_id == r.doc_id for r in rows if r.doc_id in (2, 3, 4))
    assert [r.n_links for r in rows if r.doc_id == 6] == [1, 1]
    assert jaccard.join_report(no_docs).count() == 0
    kept = sorted(r.doc_id or 0 for r in jaccard.keep_one(odd_docs).collect())
    assert kept == [0, 0, 1, 2, 3, 4, 6, 7, 8, 9, 10]
    assert jaccard.keep_one(no_docs).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, j) for j in range(101, 160)] + [(-5, 7), (300, 300)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == -5 for i in range(1, 61)) and all(got[j] == 100 for j in range(101, 160))
    assert 300 not in got


def test_runs_follow_the_depths(spark):
    """Texts that share a passage fill buckets that are split again: they need more runs than the others."""
    rng = np.random.default_rng(9)
    sketch = rng.integers(1, 2**32, (900, jaccard.SKETCH), dtype=np.uint32)
    hot = rng.random((600, jaccard.SKETCH)) < 0.45
    sketch[:600][hot] = np.broadcast_to(sketch[0], hot.shape)[hot]
    nodes = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sketch)], "node bigint, sketch binary")
    _, runs = jaccard.all_ends(nodes, 0.8, 0.9999, 16)
    miss, taken = np.ones(900), np.zeros(900, dtype=int)
    members = np.arange(900)
    for run in range(runs):
        if run >= jaccard.runs_for(0.8, 0.9999) and (run - jaccard.runs_for(0.8, 0.9999)) % jaccard.MORE_RUNS == 0:
            members = np.flatnonzero(miss > 1e-4)
        path = jaccard.paths_of(sketch[members], run, jaccard.DEPTH)
        depth, here = np.zeros(len(members), dtype=int), np.arange(len(members))
        for d in range(jaccard.DEPTH):
            depth[here] = d
            going = []
            for b in np.unique(path[here, d]):
                own = here[path[here, d] == b]
                most = np.unique(path[own, min(d + 1, jaccard.DEPTH - 1)], return_counts=True)[1].max()
                if len(own) > 16 and most < 0.5 * len(own):
                    going += own.tolist()
            here = np.array(going, dtype=int)
        miss[members] *= 1 - 0.8 ** (depth + 1)
        taken[members] += 1
    assert miss.max() <= 1e-4 and runs > jaccard.runs_for(0.8, 0.9999)
    assert taken[600:].max() == jaccard.runs_for(0.8, 0.9999) and taken[:600].max() == runs
