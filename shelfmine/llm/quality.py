"""Quality rules by repetition, from a suffix array over the words of each text."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmine.llm.common import PIECE_BYTES, SPACES, byte_pieces, word_lists

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
BASE_REPEAT_PERCENT = 30
# a repeated substring counts from this many words on
MIN_REPEAT = 5
# verdict: share of the words that lie in repeated substrings, and length of the longest of them
MAX_COVERED = 0.3
MAX_LONGEST = 100
# bytes of texts that a task works on at once; a word has a rank per level of doubling
HELD = PIECE_BYTES // 4

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")


def repeats(docs: list[list[bytes]], window: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: words in ``window``-word windows found twice or more, words covered by maximal repeated
    substrings of ``least`` words or more, and the length of the longest repeat.

    One suffix array over the words of all documents of the piece, by prefix doubling. A rank is the place at which
    the group of equal prefixes starts, so it says both order and equality. Ranks carry the document, hence prefixes
    of different documents never compare equal. Only groups that still hold several suffixes are refined.
    """
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    n = int(sizes.sum())
    none = np.zeros(len(docs), dtype=np.int64)
    if n == 0:
        return none, none.copy(), none.copy()
    ids: defaultdict = defaultdict()
    ids.default_factory = ids.__len__
    words = np.fromiter((ids[w] for d in docs for w in d), dtype=np.int64, count=n)
    doc = np.repeat(np.arange(len(docs)), sizes)
    end = np.repeat(np.cumsum(sizes), sizes)

    rank = np.empty(n, dtype=np.int64)
    at = np.arange(n)
    active, key1, key2 = at, np.zeros(n, dtype=np.int64), doc * len(ids) + words
    levels: dict[int, np.ndarray] = {}
    length = 1
    while True:
        order = np.lexsort((key2, key1)) if length > 1 else np.argsort(key2)
        k1, k2 = key1[order], key2[order]
        here = np.arange(len(order))
        run = np.r_[True, k1[1:] != k1[:-1]]
        new = run | np.r_[True, k2[1:] != k2[:-1]]
        start = np.maximum.accumulate(np.where(new, here, 0))
        rank[active[order]] = k1 + start - np.maximum.accumulate(np.where(run, here, 0))
        levels[length] = rank.copy()
        several = ~(new & np.r_[new[1:], True])
        active = active[order[several]]
        if len(active) == 0:
            break
        key1 = rank[active]
        beyond = active + length
        inside = beyond < end[active]
        key2 = np.where(inside, rank[np.minimum(beyond, n - 1)], -1)
        length *= 2

    suffixes = np.empty(n, dtype=np.int64)
    suffixes[rank] = at
    # longest common prefix of neighbours in the suffix array, by descent through the levels
    a, b = suffixes[:-1].copy(), suffixes[1:].copy()
    both = np.flatnonzero(levels[1][a] == levels[1][b])
    a, b = a[both], b[both]
    common = np.zeros(len(both), dtype=np.int64)
    stop = end[a]
    for size in sorted(levels, reverse=True):
        r = levels[size]
        live = (a < stop) & (b < stop)
        same = live & (r[np.minimum(a, n - 1)] == r[np.minimum(b, n - 1)])
        common += np.where(same, size, 0)
        a, b = np.where(same, a + size, a), np.where(same, b + size, b)
    lcp = np.zeros(n + 1, dtype=np.int64)  # lcp[i]: of places i - 1 and i
    lcp[both + 1] = common
    best = np.empty(n, dtype=np.int64)
    best[suffixes] = np.maximum(lcp[:-1], lcp[1:])

    def covered(span: np.ndarray) -> np.ndarray:
        edge = np.zeros(n + 1, dtype=np.int64)
        edge[:n] += span > 0
        np.subtract.at(edge, (at + span)[span > 0], 1)
        return np.bincount(doc[np.cumsum(edge[:n]) > 0], minlength=len(docs))

    longest = none.copy()
    np.maximum.at(longest, doc, np.where(best >= least, best, 0))
    return (
        covered(np.where(best >= window, window, 0)),
        covered(np.where(best >= least, best, 0)),
        longest,
    )


def measures(texts: list[bytes], least: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    docs = word_lists(texts)
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    repeated, covered, longest = repeats(docs, WINDOW, least)
    return {
        "n_words": np.array([len(d) for d in docs], dtype=np.int64),
        "word_chars": np.array([len(t.translate(None, SPACES).decode("utf-8", "replace")) for t in texts], dtype=np.int64),
        "n_symbols": np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], dtype=np.int64),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], dtype=np.int64),
        "n_repeat_words": repeated,
        "covered_words": covered,
        "longest_repeat": longest,
    }


def measured(column: pa.Array, least: int) -> pa.Array:
    """Struct of counts for each text of a batch, of which ``HELD`` bytes are worked on at once."""
    parts = [measures(p, least) for p in byte_pieces(column, HELD)]
    data = [np.concatenate([p[f] for p in parts]) if parts else np.zeros(0, dtype=np.int64) for f in FIELDS]
    return pa.StructArray.from_arrays([pa.array(d, pa.int64()) for d in data], names=list(FIELDS))


def repetition(text: Column, least: int = MIN_REPEAT) -> Column:
    """Struct of counts for a text column; null counts as a text without words."""
    kind = ", ".join(f"{f} bigint" for f in FIELDS)

    def measure(column: pa.Array) -> pa.Array:
        return measured(column, least)

    measure.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(measure, kind)(text)


def verdicts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_repeat: int = MIN_REPEAT,
    max_covered: float = MAX_COVERED,
    max_longest: int = MAX_LONGEST,
) -> DataFrame:
    """One row per input row: counts, ``base_failed`` and ``kept``.

    Rows are judged each by itself, so null ids, repeated rows and ties need no rule. Null and empty texts have no
    words and fail the base rule; an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), repetition(docs[text_col], min_repeat).alias("m")).select("doc_id", "m.*")
    return rows.select("*", *_decision(max_covered, max_longest))


def _decision(max_covered: float, max_longest: int) -> list[Column]:
    words = F.col("n_words")
    failed = (words < MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT_PERCENT * words)
    good = (F.col("covered_words") <= F.lit(max_covered) * words) & (F.col("longest_repeat") <= max_longest)
    return [failed.alias("base_failed"), (~failed & good).alias("kept")]


def keep_good(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    limits = {"max_covered": MAX_COVERED, "max_longest": MAX_LONGEST} | limits
    columns = [f"`{c}`" for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("row"), repetition(docs[text_col]).alias("m")).select("row", "m.*")
    return rows.select("row", *_decision(**limits)).where("kept").select("row.*")
