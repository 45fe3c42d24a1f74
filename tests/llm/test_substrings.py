import numpy as np
import pyarrow as pa
import pytest
from conftest import prose

from shelfmine.llm import substrings
from shelfmine.llm.common import byte_pieces
from shelfmine.llm.shingles import word_values


@pytest.mark.parametrize("seed", range(8))
def test_compact_windows_by_definition(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 60, 6)
    values = rng.permutation(int(sizes.sum()) + 1)[: sizes.sum()].astype(np.uint64) + np.uint64(1)
    bounds = np.cumsum(np.r_[0, sizes])
    got = sorted(zip(*(x.tolist() for x in substrings.compact_windows(values, bounds, 9, 12))))
    want = []
    for a, b in zip(bounds, bounds[1:]):
        for c in range(a, b):
            low = max([j + 1 for j in range(a, c) if values[j] < values[c]], default=a)
            high = min([j - 1 for j in range(c + 1, b) if values[j] < values[c]], default=b - 1)
            if high - low + 1 >= 9:
                want.append((c, max(low, c - 12), min(high, c + 12)))
    assert got == want


def test_planted_passages(spark):
    passage, near = prose(1, 60), prose(2, 90).split()
    changed = [*near[:45], "otherword", *near[46:]]
    docs = [(i, prose(10 + i, 200)) for i in range(20)]
    docs += [(100 + i, f"{prose(50 + i, 40)} {passage} {prose(70 + i, 30 + i)}") for i in range(5)]
    docs += [(200, f"{prose(80, 100)} {' '.join(near)}"), (201, f"{' '.join(changed)} {prose(81, 100)}")]
    docs += [(300, f"{prose(90, 100)} {prose(91, 40)}"), (301, f"{prose(91, 40)} {prose(92, 100)}")]  # too short
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, rid string")
    found = substrings.repeats(df).collect()
    texts = dict(docs)
    groups, whole = {}, set()
    for r in found:
        own = texts[r.doc_id].split()[r.start : r.stop]
        assert len(own) >= 50
        groups.setdefault(r.doc_id // 100, set()).update((r.doc_id, r.first_doc_id))
        if passage in " ".join(own):
            whole.add(r.doc_id)
    assert groups == {1: {100, 101, 102, 103, 104}, 2: {200, 201}}
    assert len(whole) == len({r.doc_id for r in found if r.doc_id < 200}) == 4

    cut = {r.doc_id: r.text for r in substrings.cut_repeats(df, length_col=None).collect()}
    assert sum(passage in t for t in cut.values()) == 1
    assert all(cut[i] == t for i, t in docs if i < 100 or i >= 300)


def test_odd_rows(odd_docs, no_docs):
    assert substrings.repeats(no_docs).count() == 0
    rows = substrings.repeats(odd_docs).collect()
    assert {r.doc_id for r in rows} <= {1, None, 6, 8, 9, 10}
    cut = substrings.cut_repeats(odd_docs)
    assert cut.columns == odd_docs.columns and cut.count() == odd_docs.count()
    assert substrings.cut_repeats(no_docs).count() == 0


def test_words_are_cut_with_the_space_after_them():
    assert substrings.without(b" a b\tc  d\n", [(1, 3)]) == b" a d\n"
    assert substrings.without(b"a b", [(0, 2)]) == b""
    assert substrings.without(b"a b c d", [(0, 2), (1, 3)]) == b"d"


def test_variant_families_against_all_pairs(spark):
    """Exact copies meet although a third document, the first by hash, holds the signatures with two words changed."""
    rng = np.random.default_rng(5)
    docs, held = [], {}
    for family in range(60):
        passage = prose(1000 + family, 50).split()
        changed = list(passage)
        for place in rng.choice(np.arange(8, 42), 2, replace=False):
            changed[place] = f"other{place}"
        for k, own in enumerate((passage, passage, changed, changed)):
            doc = 10 * family + k
            before = prose(5000 + doc, 60).split()
            docs.append((doc, " ".join([*before, *own, *prose(9000 + doc, 60).split()])))
            held[doc] = tuple(own)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    order = {r.doc_id: r.rid for r in df.select("doc_id", substrings.row_id(df, "doc_id", "text").alias("rid")).collect()}
    want = {(a, b) for a in held for b in held if held[a] == held[b] and order[b] < order[a]}
    got = set()
    for r in substrings.repeats(df).collect():
        if r.start <= 60 and r.stop >= 110:
            got.add((r.doc_id, r.first_doc_id))
    assert len(want) == 120 and want <= got


@pytest.mark.parametrize("length", [50, 95, 140])
def test_recall_of_changed_passages(spark, length):
    """Passages at a similarity just above the threshold, by brute force, of which a third document holds another form."""
    rng = np.random.default_rng(length)
    docs, held = [], {}
    for family in range(120):
        passage = prose(20_000 + 1000 * length + family, length).split()
        for k in range(3):
            own = list(passage)
            if k:
                for place in rng.choice(np.arange(5, length - 5), length // 47, replace=False):
                    own[place] = f"other{place}{k}"
            doc = 10 * family + k
            docs.append((doc, " ".join([*prose(5000 + doc, 60).split(), *own, *prose(9000 + doc, 60).split()])))
            held[doc] = {tuple(own[i : i + 5]) for i in range(length - 4)}
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    order = {r.doc_id: r.rid for r in df.select("doc_id", substrings.row_id(df, "doc_id", "text").alias("rid")).collect()}
    families = [[10 * f + k for k in range(3)] for f in range(120)]
    alike = [
        (a, b)
        for docs_ in families
        for a in docs_
        for b in docs_
        if order[b] < order[a] and len(held[a] & held[b]) >= 0.8 * len(held[a] | held[b])
    ]
    want = {a for a, _ in alike}
    rows = substrings.repeats(df).collect()
    assert {(r.doc_id // 10, r.first_doc_id // 10) for r in rows} <= {(f, f) for f in range(120)}
    covered = {}
    for r in rows:
        covered.setdefault(r.doc_id, set()).update(range(max(r.start, 60), min(r.stop, 60 + length)))
    # a passage counts as found if it is covered but for what changed at its ends
    got = {a for a in want if len(covered.get(a, ())) >= length - 10}
    touched = want & covered.keys()
    assert len(want) >= 120 and len(touched) >= 0.95 * len(want) and len(got) >= 0.85 * len(want)


def test_hot_line_between_exact_copies(spark):
    """Passages repeat in two documents each, and all hold one line that every document has: each pair is found."""
    line = prose(77, 30)
    docs = []
    for pair in range(60):
        passage = f"{prose(300 + pair, 10)} {line} {prose(500 + pair, 10)}"
        docs += [(2 * pair + k, f"{prose(700 + 2 * pair + k, 40)} {passage} {prose(900 + 2 * pair + k, 40)}") for k in range(2)]
    docs += [(1000 + i, f"{prose(2000 + i, 50)} {line} {prose(3000 + i, 50)}") for i in range(100)]
    rows = substrings.repeats(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r.doc_id // 2 for r in rows if r.start <= 40 and r.stop >= 90} == set(range(60))
    assert all(r.doc_id // 2 == r.first_doc_id // 2 for r in rows)


def test_word_values_by_definition():
    texts = [b"", b" ", b"a b c d e", b"\x00 \x00\x00 a b c", b"x" * 64 + b" " + b"x" * 65 + b" c d " + b"x" * 64, b"\xc2\xa0a b\x0bc d\n"]
    values, n = word_values(texts)
    words = [w for t in texts for w in t.split()]
    assert n.tolist() == [len(t.split()) for t in texts]
    assert len(set(values.tolist())) == len(set(words)) == len(set(zip(words, values.tolist())))


def test_windows_are_exchanged_once(spark, monkeypatch):
    """The largest table is dealt by signature a single time; its shuffle files are the most that the job has on disk."""
    exchanges = {}
    keep = substrings.written

    def watched(df, stem):
        plan = df._jdf.queryExecution().executedPlan().toString()
        exchanges.setdefault(stem, plan.count("Exchange hashpartitioning"))
        return keep(df, stem)

    monkeypatch.setattr(substrings, "written", watched)
    passage = " ".join(f"w{i}" for i in range(120))
    docs = spark.createDataFrame([(1, "a b c " + passage), (2, passage + " d e f"), (3, "short text")], "doc_id long, text string")
    found = substrings.repeats(docs).collect()
    assert {(r["stop"] - r["start"]) for r in found} == {120}
    assert exchanges["met"] == 1
    assert "windows" not in exchanges  # and goes to that exchange without being a table before
    # its points go to the regions by one exchange by pairs of documents, without a join with the signatures
    assert exchanges["regions"] == 1


def test_places_outside_passages_by_definition(spark):
    rng = np.random.default_rng(3)
    places = [(int(k), int(r), int(a), 1, 2, bool((k + r) % 2)) for k, r, a in rng.integers(0, [20, 6, 60], (300, 3))]
    # documents 4 and 5 have no passages, document 3 no exact ones
    spans = [(int(r), int(a), int(a + n), bool(e and r != 3)) for r, a, n, e in rng.integers(0, [4, 50, 15, 2], (12, 4))]
    passages = spark.createDataFrame(spans + spans, "rid long, start int, stop int, exact boolean")
    frame = spark.createDataFrame(places, "key long, rid long, at int, back int, forth int, open boolean")
    inside = lambda r, at, exact: any(r == s[0] and s[1] <= at < s[2] - 4 and (s[3] or not exact) for s in spans)
    want = [(k, r, at, b, f, o and not inside(r, at, False)) for k, r, at, b, f, o in places if not inside(r, at, True)]
    rest = substrings.outside(frame, passages, 5)
    # one read of the places answers both questions
    assert rest._jdf.queryExecution().executedPlan().toString().count("ExistingRDD[key") == 1
    assert sorted(map(tuple, rest.collect())) == sorted(want) and len(want) < len(places)

    by_key = {}
    for row in want:
        by_key.setdefault(row[0], []).append(row)
    left = set()
    for rows in by_key.values():
        last = max((r[1] for r in rows if r[5]), default=None)
        if last is not None and min(r[1] for r in rows) < last:
            left |= {(r[1], r[2]) for r in rows if r[1] <= last}
    assert {(r.rid, r.at) for r in substrings.unmatched(frame, passages, 5).collect()} == left


def plainly_alike(a, b, least, similarity, words):
    """``substrings.alike`` with sets of values."""
    found, places = [], np.flatnonzero(np.isin(a, b))
    todo = np.split(places, np.flatnonzero(np.diff(places) > 2 * words + 1) + 1)
    while todo:
        some = todo.pop()
        if len(some) == 0 or some[-1] - some[0] + 1 < least - words + 1:
            continue
        first, last = some[0], some[-1] + 1
        own = set(a[first:last].tolist())
        at = np.array([i for i, x in enumerate(b.tolist()) if x in own])
        length = last - first
        if at[-1] - at[0] + 1 > length * 5 // 4:
            counts = [int(((at >= x) & (at < x + length * 5 // 4)).sum()) for x in at]
            k = int(np.argmax(counts))
            at = at[k : k + counts[k]]
        other = set(b[at[0] : at[-1] + 1].tolist())
        if len(own & other) >= similarity * len(own | other) - 1e-9:
            found.append((first, last, at[0], at[-1] + 1))
            continue
        gaps = np.diff(some)
        if len(gaps) and gaps.max() > 1:
            k = int(gaps.argmax()) + 1
            todo += [some[:k], some[k:]]
    return sorted(found)


@pytest.mark.parametrize("seed", range(30))
def test_alike_by_sets(seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 400, 300).astype(np.uint64)
    b = np.concatenate([rng.integers(0, 400, 20).astype(np.uint64), a[50:200], a[80:140], rng.integers(0, 400, 50).astype(np.uint64)])
    b[rng.integers(0, len(b), seed)] = 7
    assert substrings.alike(a, b, 50, 0.8, 5) == plainly_alike(a, b, 50, 0.8, 5)
    assert substrings.alike(a[:0], b, 50, 0.8, 5) == substrings.alike(a, b[:0], 50, 0.8, 5) == []


def test_texts_become_bytes_a_piece_at_a_time():
    texts = pa.array(["ab", None, "", "é", "x" * 9, "c", "de", None])
    assert list(byte_pieces(texts, 4)) == [[b"ab", b"", b"", "é".encode()], [b"x" * 9], [b"c", b"de", b""]]
    assert list(byte_pieces(texts.slice(5), 2)) == [[b"c"], [b"de", b""]]
    assert list(byte_pieces(texts[:0])) == []
