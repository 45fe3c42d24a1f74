import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmine.llm import quality


def plain(words, window):
    grams = Counter(tuple(words[i : i + window]) for i in range(len(words) - window + 1))
    return len({p for i in range(len(words) - window + 1) if grams[tuple(words[i : i + window])] > 1 for p in range(i, i + window)})


def longest(words, least):
    size = least
    while any(n > 1 for n in Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1)).values()):
        size += 1
    return size - 1 if size > least else 0


@pytest.mark.parametrize("seed", range(12))
def test_suffix_array_against_counting(seed):
    rng = random.Random(seed)
    docs = []
    for _ in range(8):
        words = [rng.choice("abcdefgh"[: rng.randint(1, 8)]).encode() for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(words))
            words += words[at : at + rng.randint(5, 40)]
        docs.append(words)
    eight, five, most = quality.repeats(docs, 8, 5)
    assert eight.tolist() == [plain(d, 8) for d in docs]
    assert five.tolist() == [plain(d, 5) for d in docs]
    assert most.tolist() == [longest(d, 5) for d in docs]


def test_odd_rows(odd_docs, no_docs):
    rows = quality.verdicts(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    empty = [r for r in rows if r.doc_id in (2, 3, 4)]
    assert all(r.n_words == 0 and r.base_failed and not r.kept and r.word_chars == 0 for r in empty)
    (repeated,) = [r for r in rows if r.doc_id == 10]
    assert repeated.n_dup_lines == 8 and repeated.base_failed
    assert quality.verdicts(no_docs).count() == 0


def test_filter_keeps_columns_and_rows(odd_docs, no_docs):
    kept = quality.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 6, 6, 8, 9]
    assert quality.keep_good(no_docs).count() == 0


def test_long_repeat_is_rejected(spark):
    text = " ".join(f"w{i}" for i in range(2000)) + " " + " ".join(f"w{i}" for i in range(150))
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    (row,) = quality.verdicts(docs).collect()
    assert row.longest_repeat == 150 and not row.base_failed and not row.kept
    assert quality.verdicts(docs, max_longest=150).where(F.col("kept")).count() == 1


def test_a_batch_is_measured_in_small_pieces(monkeypatch):
    """A task's memory goes by the largest piece; each piece gives what the texts give together."""
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 40_000))) for _ in range(60)] + [None, ""]
    whole = quality.measures([(t or "").encode() for t in texts])
    sizes, measures = [], quality.measures
    monkeypatch.setattr(quality, "measures", lambda piece, least: sizes.append(sum(map(len, piece))) or measures(piece, least))
    got = quality.measured(pa.array(texts), quality.MIN_REPEAT)
    assert [[r[f] for r in got.to_pylist()] for f in quality.FIELDS] == [whole[f].tolist() for f in quality.FIELDS]
    assert sum(sizes) > 2 * 2**20 and max(sizes) <= 2**20
    assert len(quality.measured(pa.array([], pa.string()), quality.MIN_REPEAT)) == 0
