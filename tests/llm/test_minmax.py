import random

import numpy as np
import pytest
from conftest import prose

from shelfmine.llm import minmax
from shelfmine.llm.shingles import WordHashes, shingle_hashes


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 4]) for i in range(max(len(words) - 3, min(len(words), 1))))


def plain(rows, percent=80):
    """Components by all pairs of distinct sets."""
    sets = {}
    for doc_id, text in rows:
        sets.setdefault(shingles(text), []).append(doc_id)
    keys = [s for s in sets if s]
    root = list(range(len(keys)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(keys):
        for j in range(i):
            common = len(a & keys[j])
            if 100 * common >= percent * (len(a) + len(keys[j]) - common):
                root[top(i)] = top(j)
    first = {}
    for i, s in enumerate(keys):
        first.setdefault(top(i), []).extend(x for x in sets[s] if x is not None)
    of = {s: min(first[top(i)], default=None) for i, s in enumerate(keys)}
    out = []
    for doc_id, text in rows:
        s = shingles(text)
        component = of[s] if s else doc_id
        out.append((doc_id, len(s), component, doc_id == component))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def edited(text, rng, times):
    words = text.split()
    for _ in range(times):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def families(seed, texts, copies, edits):
    rng, rows = random.Random(seed), []
    for t in range(texts):
        text = prose(1000 * seed + t, rng.randrange(60, 240))
        for _ in range(copies):
            text = edited(text, rng, rng.randrange(edits)) if rng.random() < 0.6 else text
            rows.append((len(rows) + 1, text if rng.random() < 0.5 else text.upper()))
    rng.shuffle(rows)
    return rows


def test_chains_and_families_against_all_pairs(spark):
    rows = families(3, 25, 14, 6)
    assert sorted(map(tuple, minmax.classes(frame(spark, rows)).collect()), key=str) == plain(rows)


def test_small_cells_and_hot_keys(spark, monkeypatch):
    """A template that all share brings texts of many classes into the same buckets."""
    monkeypatch.setattr(minmax, "MEMBERS", 4)
    monkeypatch.setattr(minmax, "OTHERS", 8)
    monkeypatch.setattr(minmax, "HOT_SHARE", 40)
    monkeypatch.setattr(minmax, "SALTS", 3)
    rng, template, rows = random.Random(8), prose(77, 150), []
    for i in range(220):
        own = prose(5000 + i % 60, 18 + i % 23)
        rows.append((i, edited(template, rng, i % 4) + " " + own))
    assert sorted(map(tuple, minmax.classes(frame(spark, rows)).collect()), key=str) == plain(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted(map(tuple, minmax.classes(odd_docs).collect()), key=str) == plain(rows)
    assert minmax.classes(no_docs).count() == 0
    same = [(None, "a b c d e"), (None, "A b c d e"), (5, "a b c d e"), (5, "a b c d e"), (None, "only null ids")]
    got = sorted(map(tuple, minmax.classes(frame(spark, same)).collect()), key=str)
    assert got == sorted([(None, 2, 5, False)] * 2 + [(5, 2, 5, True)] * 2 + [(None, 1, None, True)], key=str)


def test_signature_is_unbiased_and_varies_less():
    """Mean agreement is the similarity; of as many values, min and max together vary less than minima alone. The gain is
    largest in small sets."""
    rng = np.random.default_rng(5)
    both, minima = [], []
    for _ in range(400):
        values = rng.integers(0, 2**63, 8, dtype=np.uint64)
        a, b = values[:6], values[2:]
        sign = lambda s, k: minmax.signatures(s, np.array([0, len(s)]), k)[0]
        both.append((sign(a, 48) == sign(b, 48)).mean())
        minima.append((sign(a, 96).reshape(-1, 2, 4)[:, 0] == sign(b, 96).reshape(-1, 2, 4)[:, 0]).mean())
    assert abs(np.mean(both) - 0.5) < 0.01
    assert np.var(both) < np.var(minima)


@pytest.mark.parametrize("percent", [80, 90])
def test_band_recall(percent):
    """Share of pairs right at the threshold that agree on a band."""
    rng = np.random.default_rng(percent)
    met = 0
    for _ in range(500):
        common, rest = (80, 10) if percent == 80 else (90, 5)
        values = rng.integers(0, 2**63, common + 2 * rest, dtype=np.uint64)
        a, b = np.sort(values[: common + rest]), np.sort(np.r_[values[:common], values[common + rest :]])
        keys = minmax.band_keys(minmax.signatures(np.r_[a, b], np.array([0, len(a), len(a) + len(b)])))
        met += bool((keys[0] == keys[1]).any())
    assert met == 500


def test_equal_word_lists_have_equal_shingles():
    texts = [b"A b  c d e", b"a B c d e"]
    values, bounds = shingle_hashes([t.split() for t in minmax.lowered(texts)], WordHashes(), 4)
    assert bounds.tolist() == [0, 2, 4] and values[:2].tolist() == values[2:].tolist()
