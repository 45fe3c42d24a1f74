import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from conftest import prose
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmine.llm import periods


def plain(words):
    """All runs, from every lag's matches; the smallest lag of a stretch is its period."""
    n, seen = len(words), {}
    for q in range(1, n):
        i = q
        while i < n:
            s = i
            while i < n and words[i] == words[i - q]:
                i += 1
            if i - s + q >= max(12, 2 * q):
                seen.setdefault((s - q, i - s + q), q)
            i += 1
    return sorted((s, length, q) for (s, length), q in seen.items())


def fast(docs):
    rows, bounds = periods.runs_of(docs)
    rows = [(int(s), int(e - s), int(q)) for s, e, q in rows.T]
    return [rows[a:b] for a, b in zip(bounds, bounds[1:])]


def random_texts(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        letters = "ab" if rng.random() < 0.6 else "abcdefghij"
        words = [rng.choice(letters).encode() for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 4)):
            unit = [rng.choice(letters).encode() for _ in range(rng.randrange(1, 40))]
            words += (unit * 6)[: rng.randrange(0, 5 * len(unit) + 1)]
            words += words[-rng.randrange(1, 60) :] if rng.random() < 0.5 else []
        out.append(words)
    return out


def test_runs_against_all_lags():
    docs = random_texts(1, 500)
    assert fast(docs) == [plain(d) for d in docs]


def test_overlapping_runs():
    """Runs whose periods lie close together and overlap by less than both."""
    rng, docs = random.Random(2), []
    for _ in range(1500):
        p = rng.randrange(1, 9)
        unit = [rng.choice("ab").encode() for _ in range(p)]
        inner = (unit * 30)[: rng.randrange(2 * p, 14 * p + 12)]
        outer = inner[: rng.randrange(1, len(inner) + 1)]
        outer = [rng.choice("ab").encode() for _ in range(rng.randrange(0, 5))] + outer
        docs.append((outer * 3)[rng.randrange(0, len(outer)) :] + inner[rng.randrange(0, p) :] + outer)
    assert fast(docs) == [plain(d) for d in docs]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=70), max_size=4))
def test_runs_of_any_words(docs):
    assert fast([d * 2 for d in docs]) == [plain(d * 2) for d in docs]


def fibonacci(n):
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("words", [[b"x"] * 700, [b"x", b"y"] * 300 + [b"x"] * 300, fibonacci(900), list(fibonacci(200)) * 4])
def test_very_periodic_texts(words):
    assert fast([words]) == [plain(words)]


def test_work_is_not_quadratic():
    def seconds(n):
        start = time.perf_counter()
        assert fast([[b"x"] * n]) == [[(0, n, 1)]]
        fast([fibonacci(n)])
        return time.perf_counter() - start

    seconds(50_000)
    assert seconds(200_000) < 12 * max(seconds(50_000), 0.05)


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(("null" if doc_id is None else str(doc_id)).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (
        doc_id,
        len(runs),
        *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()),
        sha(b" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def key(row):
    return tuple(str(x) for x in row)


def test_rows_against_plain_runs(spark, odd_docs, no_docs):
    short = odd_docs.where("length(text) < 20000 or text is null")
    more = spark.createDataFrame([(i, prose(i, 40 + i % 90) + " tail end" * (i % 9)) for i in range(100, 260)], "doc_id bigint, text string")
    docs = short.unionByName(more, allowMissingColumns=True)
    got = periods.found(docs, plant=True).collect()
    assert sorted(map(key, got)) == sorted(key(expected(r.doc_id, r.text)) for r in docs.collect())
    assert any(r.n_runs for r in got) and periods.found(odd_docs).count() == odd_docs.count()
    assert periods.found(no_docs).count() == 0


def test_collapsed_words():
    words = b"a b c a b c a b c a b c a b d".split()
    rows, _ = periods.runs_of([words])
    assert periods.collapsed(words, rows) == b"a b c d".split()
    assert np.array_equal(rows, [[0], [14], [3]])
