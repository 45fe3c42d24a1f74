import random
import zlib

import numpy as np
import pytest

from shelfmine.llm import packing


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_vocabulary())


def test_encoder_gives_the_ids_of_the_library():
    texts = ["", " ", "a b", "a  b", " a b ", "it's\tfine\n\n x", "日本 語 😀 é́", "a<|endoftext|>b", "x" * 5000, "a\xa0 b", "a  b", "1 2345 ...!! ?", "\x1c a"]
    whole, encoder = tokenizer(), packing.Encoder(packing.default_vocabulary())
    for text in texts * 2:
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def best_fit(counts, capacity):
    """Sequences that best-fit decreasing opens, one piece after the other."""
    free = []
    for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        fits = [f for f in free if f >= length]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - length)
        else:
            free.append(capacity - length)
    return len(free)


@pytest.mark.parametrize("seed", range(20))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 100): rng.randint(1, 60) for _ in range(rng.randint(1, 40))}
    plan = packing.plan(counts, 100)
    placed = {}
    for pattern, times in plan:
        assert sum(pattern) <= 100 and times > 0
        for length in pattern:
            placed[length] = placed.get(length, 0) + times
    assert placed == counts
    assert sum(times for _, times in plan) <= best_fit(counts, 100) * 1.01 + 1


def test_pieces_are_whole_and_gapless(odd_docs, no_docs):
    rows = packing.pack(odd_docs, capacity=64).collect()
    whole, ids = tokenizer(), []
    for r in odd_docs.collect():
        ids.append((r.doc_id, [*whole.encode(r.text or "", add_special_tokens=False).ids, 0]))
    for doc, tokens in ids:
        own = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.piece)
        assert all(zlib.crc32(np.array(t[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for r in own for t in [tokens] if sum(d == doc for d, _ in ids) == 1)
        assert all(r.length == 64 for r in own if r.piece > 0)
    assert sum(r.length for r in rows) == sum(len(t) for _, t in ids)
    full = {}
    for r in rows:
        full.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in full.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(full) <= -(-sum(len(t) for _, t in ids) // 64) + 1
    assert packing.pack(no_docs).count() == 0
