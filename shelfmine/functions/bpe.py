"""Tokens of a byte-pair vocabulary as column expressions.

The JVM splits texts into words by the vocabulary's pattern. A task then sees each batch as one flat column of words, in
which every distinct word is merged once; the tokens of a text are looked up by word. Merging takes the pair of lowest
rank first, as the vocabulary was made. The vocabulary goes to the tasks as a broadcast value: it is one file of a fixed
size, read on the driver from the path that the caller gives.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Fixed value: how the vocabulary's texts are split before merging.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# words of a task that are worked on together, and distinct words that it remembers
WORDS_AT_ONCE = 100_000
REMEMBERED = 200_000
# bytes of a word that is merged by looking through all pairs
SCANNED = 64

WINDOWS = "array<struct<chunk:int,text:string,num_tokens:int,ids:array<int>,start:int,end:int>>"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"not a vocabulary of bytes: {path} has no token for {len(missing)} bytes")
    return ranks


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of a word. Neighbours that form a token are merged, lowest rank first and leftmost of equal ones.

    Possible merges wait in a heap, so a word of n bytes takes about n log n steps.
    """
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    if n <= SCANNED:
        return _merged_by_scan(word, ranks)
    end = list(range(1, n + 1))  # where the part that starts here ends; 0 where no part starts
    before = list(range(-1, n - 1))  # start of the part in front

    def candidate(i: int) -> tuple[int, int, int] | None:
        j = end[i]
        rank = ranks.get(word[i : end[j]]) if j < n else None
        return None if rank is None else (rank, i, end[j])

    heap = [c for c in map(candidate, range(n)) if c]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        j = end[i]
        if not 0 < j < n or end[j] != stop:
            continue  # one of the two has been merged with another part since
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
        for x in (before[i], i):
            if x >= 0 and (c := candidate(x)):
                heappush(heap, c)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def _merged_by_scan(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for a short word, where looking through all pairs costs less than a heap."""
    get, none = ranks.get, 2**62  # above every rank
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pairs and (low := min(pairs)) != none:
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


class _Encoder:
    """Ids and byte lengths of the words of a task; a bounded number of words is remembered."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
        # ids as the bytes of 32-bit numbers, a fraction of the size of a list
        self.known: dict[bytes, bytes] = {}

    def ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, counts)``: the tokens of all words in a row, and how many each word has."""
        coded = words.dictionary_encode()
        if len(self.known) > REMEMBERED:
            self.known = {}
        lists = []
        for word in coded.dictionary.to_pylist():
            if (found := self.known.get(word)) is None:
                found = self.known[word] = array("i", merged(word, self.ranks)).tobytes()
            lists.append(found)
        sizes = np.array([len(x) for x in lists], dtype=np.int64) // 4
        flat = np.frombuffer(b"".join(lists), dtype=np.int32)
        first = np.cumsum(sizes) - sizes
        at = coded.indices.to_numpy()
        counts = sizes[at]
        place = np.repeat(first[at] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return flat[place], counts


class _Texts:
    """Rows of words with their tokens, all in one line: ``ids``, the bytes at which tokens end, and for each row where its
    tokens begin."""

    def __init__(self, rows: pa.Array, encoder: _Encoder) -> None:
        words = rows.flatten().cast(pa.binary())
        self.ids, counts = encoder.ids(words)
        n_words = pc.list_value_length(rows).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.rows = np.r_[0, np.cumsum(counts)][np.r_[0, np.cumsum(n_words)]]
        self.byte = np.r_[0, np.cumsum(encoder.sizes[self.ids])]
        self.text = _bytes_of(words)
        self.missing = rows.is_null()
        self._started: np.ndarray | None = None

    @property
    def started(self) -> np.ndarray:
        """For each byte border, how many characters start before it."""
        if self._started is None:
            starts = (np.frombuffer(self.text, dtype=np.uint8) & 0xC0) != 0x80
            self._started = np.r_[0, np.cumsum(starts)]
        return self._started

    def covered(self, first: np.ndarray, last: np.ndarray, row: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """First and last character, counted in the row, of token ranges that are not empty."""
        at, low, high = self.started, self.byte[first], self.byte[last]
        within = at[low + 1] == at[low]  # the range begins inside a character
        base = at[self.byte[self.rows[row]]]
        return pa.array((at[low] - within - base).astype(np.int32)), pa.array((at[high] - base).astype(np.int32))

    def listed(self, values: pa.Array, bounds: np.ndarray) -> pa.Array:
        """One list per row; null for a row without a text."""
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values, mask=self.missing)


def _bytes_of(words: pa.Array) -> bytes:
    """All words in a row, straight from the buffer that holds them."""
    if len(words) == 0:
        return b""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[words.offset : words.offset + len(words) + 1]
    return data[int(ends[0]) : int(ends[-1])].to_pybytes() if ends[-1] > ends[0] else b""


def _parts(rows: pa.Array) -> Iterator[pa.Array]:
    sizes = pc.list_value_length(rows).fill_null(0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > WORDS_AT_ONCE:
            yield rows.slice(start, i - start)
            start, held = i, 0
        held += n
    yield rows.slice(start)


class BytePairs:
    """Column expressions over one vocabulary. Null texts give null everywhere."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.ranks = spark.sparkContext.broadcast(read_ranks(path))

    def _over(self, text: Column, kind: str, of_texts: Callable[[_Texts], pa.Array]) -> Column:
        shared = self.ranks
        held: list[_Encoder] = []

        def work(column: pa.Array) -> pa.Array:
            if not held:
                held.append(_Encoder(shared.value))
            return pa.chunked_array([of_texts(_Texts(rows, held[0])) for rows in _parts(column)]).combine_chunks()

        work.__annotations__ = {"column": pa.Array, "return": pa.Array}
        return F.arrow_udf(work, kind)(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))

    def ids(self, text: Column) -> Column:
        """``array<int>`` of token ids; an empty text has none."""
        return self._over(text, "array<int>", lambda texts: texts.listed(pa.array(texts.ids), texts.rows))

    def count(self, text: Column) -> Column:
        numbers = lambda texts: np.diff(texts.rows).astype(np.int32)
        return self._over(
            text, "int", lambda texts: pa.array(numbers(texts), mask=texts.missing.to_numpy(zero_copy_only=False))
        )

    def tokens(self, text: Column) -> Column:
        """``array<struct<id, start, end>>``: the characters that a token covers. Neighbours that share a character both
        cover it."""

        def spans(texts: _Texts) -> pa.Array:
            place = np.arange(len(texts.ids))
            row = np.repeat(np.arange(len(texts.rows) - 1), np.diff(texts.rows))
            start, end = texts.covered(place, place + 1, row)
            cells = pa.StructArray.from_arrays([pa.array(texts.ids), start, end], names=["id", "start", "end"])
            return texts.listed(cells, texts.rows)

        return self._over(text, "array<struct<id:int,start:int,end:int>>", spans)

    def windows(self, text: Column, max_tokens: int, overlap: int) -> Column:
        """``array<struct<chunk, text, num_tokens, ids, start, end>>``, as ``chunking.windows`` cuts them; an empty text
        gives an empty array.

        ``text`` decodes the tokens of the window: a character that the window's border cuts appears as U+FFFD. The
        characters ``start`` to ``end`` of the source are those that the window covers, cut ones included.
        """
        step = max_tokens - overlap
        if step <= 0:
            raise ValueError("overlap must be smaller than max_tokens")

        def cut(texts: _Texts) -> pa.Array:
            n = -(-np.diff(texts.rows) // step)  # windows of each row
            row = np.repeat(np.arange(len(n)), n)
            chunk = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            first = texts.rows[row] + chunk * step
            last = np.minimum(first + max_tokens, texts.rows[row + 1])
            size = last - first
            bounds = np.r_[0, np.cumsum(size)]
            place = np.repeat(first - bounds[:-1], size) + np.arange(bounds[-1])
            start, end = texts.covered(first, last, row)
            low, high = texts.byte[first].tolist(), texts.byte[last].tolist()
            cells = {
                "chunk": pa.array((chunk + 1).astype(np.int32)),
                "text": pa.array([texts.text[a:b].decode("utf-8", "replace") for a, b in zip(low, high)], pa.string()),
                "num_tokens": pa.array(size.astype(np.int32)),
                "ids": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(texts.ids[place])),
                "start": start,
                "end": end,
            }
            return texts.listed(pa.StructArray.from_arrays(list(cells.values()), names=list(cells)), np.r_[0, np.cumsum(n)])

        return self._over(text, WINDOWS, cut)
