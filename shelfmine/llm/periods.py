"""Periodic runs in word sequences, by match lengths on sparse diagonals.

On the diagonal of lag q a word matches if it equals the word q before it. A run of period q is a stretch of matches that
neither neighbour extends, so the length of the match that ends at each word is all that must be known. Words are taken
in order; the earlier occurrences of what stands there raise the match lengths of their lags; a diagonal whose match
ends is closed, and if it is long enough it gives a run at once.

What makes it sparse: a run of period q has at least ``max(SHORTEST - q, q)`` matches in a row. Lags are taken by octaves,
and a lag of the octave [L, 2L) is opened only by a gram of L / 2 words, at a place that is a multiple of L / 2, which
occurred L to 2L words before. Every run holds such a gram. So an octave opens at most 2n diagonals in n words, even if
they are all the same word, and none where no gram of its length repeats. Lags below the first octave are few; their
diagonals are followed in full.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmine.llm.common import as_bytes, pieces, word_lists

# words of the shortest run
SHORTEST = 12
FIELDS = (
    "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, "
    "collapsed_sha256 string"
)
PLANTED_SHARE = 10


class Runs:
    """Runs found so far in the words of a piece, and which of them reaches back furthest from each word."""

    def __init__(self, n: int) -> None:
        self.start, self.end, self.period = [], [], []
        self.spans: set[tuple[int, int]] = set()
        self.back = np.arange(n, dtype=np.int64)
        self.lag = np.ones(n, dtype=np.int64)

    def emit(self, start: int, end: int, period: int) -> None:
        """Add a run, unless the span is known: divisors come first, so it has a smaller period then."""
        if (start, end) in self.spans:
            return
        self.spans.add((start, end))
        self.start.append(start)
        self.end.append(end)
        self.period.append(period)
        part = slice(start, end)
        longer = self.back[part] > start
        self.back[part][longer] = start
        self.lag[part][longer] = period

    def implied(self, at: np.ndarray, lag: np.ndarray) -> np.ndarray:
        """Whether a run of a divisor of the lag holds the word and all words back to its match: a run of the lag itself
        would then have the smaller period all along."""
        return (self.back[at] <= at - lag) & (lag % self.lag[at] == 0)

    def sorted(self) -> np.ndarray:
        rows = np.array([self.start, self.end, self.period], dtype=np.int64).reshape(3, -1)
        return rows[:, np.lexsort(rows[::-1])]


def same_ahead(words: np.ndarray, a: int, b: int, limit: int) -> int:
    """How many of at most ``limit`` words from ``a`` on equal those from ``b`` on."""
    done, step = 0, 16
    while done < limit:
        size = min(step, limit - done)
        differ = words[a + done : a + done + size] != words[b + done : b + done + size]
        first = int(differ.argmax())
        if differ[first]:
            return done + first
        done += size
        step = min(2 * step, 65_536)
    return limit


def same_behind(words: np.ndarray, a: int, b: int, limit: int) -> int:
    """How many of at most ``limit`` words before ``a`` equal those before ``b``."""
    if limit <= 0:
        return 0
    differ = (words[a - limit : a] != words[b - limit : b])[::-1]
    first = int(differ.argmax())
    return first if differ[first] else limit


def short_lags(words: np.ndarray, runs: Runs) -> None:
    """Runs of periods below ``SHORTEST``: each of these diagonals from its first word to its last."""
    n = len(words)
    for q in range(1, min(SHORTEST, n)):
        # texts have no words in common, so a match never crosses into the text before
        match = np.zeros(n + 1, dtype=np.int8)
        match[q:n] = words[q:] == words[:-q]
        edges = np.flatnonzero(np.diff(match, prepend=np.int8(0)))
        begin, end = edges[::2], edges[1::2]
        enough = end - begin >= max(SHORTEST - q, q)
        begin, end = begin[enough], end[enough]
        new = ~runs.implied(end - 1, np.full(len(end), q))
        for s, e in zip(begin[new].tolist(), end[new].tolist()):
            runs.emit(s - q, e, q)


def grams(words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(size, places, names)`` of the grams of 6, 12, 24 ... words that a text repeats; equal grams have one name.

    A gram is two of half its size, so names double; a place whose half is no repeated gram is dropped. Names rank the
    pairs of halves, hence two different grams never share one, and every name belongs to one text.
    """
    n = len(words)
    size, places, names = 1, np.arange(n), words
    for size, parts in ((3, 3), *((6 << k, 2) for k in range(60))):
        part = size // parts
        index = np.full(n + size, -1, dtype=np.int64)
        index[places] = names
        key = names
        keep = np.ones(len(places), dtype=bool)
        for i in range(1, parts):
            following = index[places + i * part]
            keep &= following >= 0
            key = key * (n + 1) + following  # parts are names below n, three of them are renamed in between
            if i + 1 < parts:
                key = np.unique(key, return_inverse=True)[1]
        places, key = places[keep], key[keep]
        if len(places) == 0:
            return
        _, names, counts = np.unique(key, return_inverse=True, return_counts=True)
        several = counts[names] > 1
        places, names = places[several], names[several]
        if len(places) == 0:
            return
        if size >= 6:
            yield size, places, names


def openings(size: int, places: np.ndarray, names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(place, lag)`` of the diagonals that an octave opens: grams at multiples of their size, with the occurrences
    that lie two to four sizes before."""
    order = np.lexsort((places, names))
    where, name = places[order], names[order]
    anchor = (where - first[where]) % size == 0
    at, of = where[anchor], name[anchor]
    span = int(where.max()) + 1
    flat = name * span + where  # ascending: by name, then by place
    low = np.searchsorted(flat, of * span + np.maximum(at - 4 * size + 1, 0))
    high = np.searchsorted(flat, of * span + np.maximum(at - 2 * size + 1, 0))
    n = np.maximum(high - low, 0)
    which = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
    place = np.repeat(at, n)
    return place, place - where[which]


def long_lags(words: np.ndarray, first: np.ndarray, last: np.ndarray, runs: Runs) -> None:
    """Runs of periods from ``SHORTEST`` on, octave by octave; in each, words in order."""
    for size, places, names in grams(words, first):
        place, lag = openings(size, places, names, first)
        # divisors of a lag lie in lower octaves, so all runs that make a lag superfluous are known
        new = ~runs.implied(place + size - 1, lag)
        place, lag = place[new], lag[new]
        order = np.lexsort((lag, place))
        reach: dict[int, int] = {}  # of each lag: where its last match ended
        for i, q in zip(place[order].tolist(), lag[order].tolist()):
            if reach.get(q, -1) > i:
                continue
            begin = i - same_behind(words, i, i - q, min(size, i - q - int(first[i])))
            end = i + size + same_ahead(words, i + size, i + size - q, int(last[i]) - i - size)
            reach[q] = end
            if end - begin >= q:
                runs.emit(begin - q, end, q)


def runs_of(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, bounds)``: start, end and period of every run, by text, start and period; ``bounds`` cuts the rows by
    text. Starts and ends count from the text's first word."""
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    n = int(sizes.sum())
    starts = np.cumsum(sizes) - sizes
    first = np.repeat(starts, sizes)
    ids: defaultdict = defaultdict()
    ids.default_factory = ids.__len__
    words = np.fromiter((ids[w] for d in docs for w in d), dtype=np.int64, count=n)
    if n:  # the same word of two texts has two numbers
        words = np.unique(np.repeat(np.arange(len(docs)), sizes) * len(ids) + words, return_inverse=True)[1]
    runs = Runs(n)
    short_lags(words, runs)
    long_lags(words, first, first + np.repeat(sizes, sizes), runs)
    rows = runs.sorted()
    text = np.searchsorted(np.cumsum(sizes), rows[0], side="right")
    rows[:2] -= starts[text]
    return rows, np.searchsorted(text, np.arange(len(docs) + 1))


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run contains after its first period."""
    if runs.shape[1] == 0:
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, runs[0] + runs[2], 1)
    np.subtract.at(edge, runs[1], 1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def facts(words: list[bytes], runs: np.ndarray) -> tuple:
    start, end, period = runs
    length = end - start
    listed = b"".join(b"%d,%d,%d\n" % x for x in zip(start.tolist(), length.tolist(), period.tolist()))
    best = (None,) * 4
    if len(start):
        i = int(np.lexsort((period, start, -length))[0])
        best = (int(start[i]), int(length[i]), int(period[i]), 1000 * int(length[i]) // int(period[i]))
    return (
        len(start),
        *best,
        hashlib.sha256(listed).hexdigest(),
        hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest(),
    )


def planted(words: list[bytes], hashed: int | None) -> list[bytes]:
    """The words with a periodic end, for one text in ``PLANTED_SHARE``, chosen by the hash of its id; as they are
    without a hash."""
    n = len(words)
    if hashed is None or hashed % PLANTED_SHARE or n == 0:
        return words
    part = hashed // PLANTED_SHARE
    at = part % n
    period = 1 + (n - at) // (3 + part % 8)
    unit = words[at : at + period]
    return words[:at] + (unit * (-(-(n - at) // period)))[: n - at]


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """One row per input row: its number of runs, the longest of them (ties: smallest start, then period; nulls without a
    run), and the digests of all runs and of the words that stay once every run keeps its first period only.

    Rows are worked on each by itself, so null ids, repeated rows and ties need no rule. Null and empty texts have no words
    and no runs. An empty table gives an empty result; other columns are not read. Memory grows with one text, or a
    piece of 4 MB of shorter ones. With ``plant`` texts get periodic ends by the hash of their id, for tests that need
    known runs; a null id counts as the text "null".
    """
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for piece in pieces(as_bytes(batch.column(2))):
                hashes = batch.column(1).slice(done, len(piece)).to_pylist()
                texts = [planted(w, h) for w, h in zip(word_lists(piece), hashes)]
                runs, bounds = runs_of(texts)
                rows = [facts(w, runs[:, a:b]) for w, a, b in zip(texts, bounds, bounds[1:])]
                columns = [pa.array(c, pa.string() if n.endswith("sha256") else pa.int64()) for n, c in zip(names, zip(*rows))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(piece)), *columns], names=["doc_id", *names])
                done += len(piece)

    kind = docs.schema[id_col].dataType.simpleString()
    hashed = F.crc32(F.coalesce(docs[id_col].cast("string"), F.lit("null")).cast("binary")) if plant else F.lit(None).cast("long")
    rows = docs.select(docs[id_col].alias("doc_id"), hashed.alias("hashed"), docs[text_col].alias("text"))
    return rows.mapInArrow(search, f"doc_id {kind}, {FIELDS}")
