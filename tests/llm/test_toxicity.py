import random

import numpy as np
import pytest
from conftest import prose

from shelfmine.llm import toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    bad = ["vilegrub", "nastok", "foulmire"]
    docs, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        words = prose(i, 60).split()
        for _ in range(3 if toxic else 0):
            words.insert(rng.randint(0, len(words)), rng.choice(bad))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy_and_evidence(labelled):
    docs, labels = labelled
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.scores(docs, labels).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 600 and len(held) > 60
    assert all(r.predicted == truth[r.doc_id] and 0 <= r.score <= 1 for r in held)
    for r in held:
        assert all(e.label == truth[e.doc_id] for e in r.evidence)
        assert (len(r.evidence) > 0) == (truth[r.doc_id] == 1)


def test_nearest_is_exact(labelled):
    docs, labels = labelled
    index = toxicity.fit(docs, labels)
    n = len(index.labels)
    dense = np.zeros((n, len(index.terms)))
    for t in range(len(index.terms)):
        a, b = index.segments[t, 0], index.segments[t, -1]
        dense[index.examples[a:b], t] = index.values[a:b]
    rng = np.random.default_rng(1)
    for _ in range(50):
        at = np.sort(rng.choice(len(index.terms), rng.integers(1, len(index.terms) + 1), replace=False))
        weights = rng.random(len(at))
        full = (dense[:, at] @ weights).round(12)
        want = [i for i in np.lexsort((np.arange(n), -full))[:7] if full[i] > 0]
        found, scores = index.nearest(at, weights, 7)
        assert found.tolist() == want and np.allclose(scores, full[want])


def test_odd_rows(odd_docs, no_docs, labelled):
    _, labels = labelled
    rows = toxicity.scores(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(r.score is not None for r in rows)
    assert toxicity.scores(odd_docs, labels.where("false")).where("predicted = 0").count() == len(rows)
    assert toxicity.scores(no_docs, labels).count() == 0
    assert toxicity.keep_clean(odd_docs, labels).columns == odd_docs.columns
