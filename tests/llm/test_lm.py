import math
import zlib
from collections import Counter

import numpy as np
from conftest import prose

from shelfmine.llm import lm


def test_counts_and_base_by_plain_sums(spark):
    docs = [(i, prose(i % 37, 20 + i)) for i in range(60)] + [(61, "Only HERE Ünseen"), (62, None)]
    got = {r.doc_id: r for r in lm.scores(spark.createDataFrame(docs, "doc_id bigint, text string"), passes=1).collect()}
    words = lambda t: (t or "").encode().lower().split() + [b"\n"]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter(w for i, t in docs if not held(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in docs:
        row = got[i]
        assert (row.held_out, row.n_tokens, row.train_tokens) == (held(i), len(words(t)), n)
        assert row.n_known == sum(counts[w] > 0 for w in words(t))
        assert math.isclose(row.base_score, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t)), rel_tol=1e-9)


def test_context_is_learned(spark):
    docs = [(i, " ".join(["left right"] * 40 if i % 2 else ["up down"] * 40)) for i in range(400)]
    rows = lm.scores(spark.createDataFrame(docs, "doc_id bigint, text string")).where("held_out").collect()
    assert sum(r.score for r in rows) > 0.9 * sum(r.base_score for r in rows)
    assert all(r.score > r.base_score for r in rows)


def test_probabilities_of_all_words_sum_to_one(spark):
    docs = spark.createDataFrame([(i, prose(i, 200)) for i in range(30)], "doc_id bigint, text string")
    vocabulary = lm.vocabulary_of(lm.word_counts(docs.select("text")))
    model = lm.Model.start(vocabulary.shares())
    scorer = lm.Scorer(model)
    every = np.arange(lm.CLASSES)
    for u, v in ((0, 0), (5, 9)):
        classes = 10 ** scorer.log10(every, np.full(lm.CLASSES, u), np.full(lm.CLASSES, v))
        assert abs(classes.sum() - 1) < 1e-4
    inside = Counter()
    for word, place in vocabulary.place.items():
        c = vocabulary.classes[place]
        if c >= lm.SHORTLIST:
            inside[c] += (vocabulary.counts[place] + lm.SMOOTHING) / vocabulary.tail_mass[c]
    for c, share in inside.items():
        assert abs(share + lm.SMOOTHING / vocabulary.tail_mass[c] - 1) < 1e-9


def test_odd_rows(odd_docs, no_docs):
    rows = lm.scores(odd_docs, passes=1).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.n_tokens == 1 for r in rows if r.doc_id in (2, 3, 4))
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert lm.scores(no_docs).count() == 0
    # only held-out rows: nothing is learned, every word is unknown
    (row,) = lm.scores(odd_docs.where("doc_id = 1").withColumn("doc_id", odd_docs["doc_id"] * 0 + 31), passes=1).collect()
    assert row.held_out is (zlib.crc32(b"31") % 10 == 0)
