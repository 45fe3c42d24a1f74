"""Word shingles as 64-bit hashes, for many texts at once."""

from __future__ import annotations

import numpy as np
import xxhash

from shelfmine.llm.common import SPACES, mixed

WORDS = 5
SIMILARITY = 0.8


class WordHashes:
    """64-bit hashes of words, equal on every machine; a bounded number of words is remembered."""

    LIMIT = 500_000

    def __init__(self) -> None:
        self.at: dict[bytes, int] = {}
        self.values = np.zeros(0, dtype=np.uint64)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.at) > self.LIMIT:
            self.__init__()
        found = list(map(self.at.get, words))
        if None in found:
            new = []
            for i, x in enumerate(found):
                if x is None:
                    word = words[i]
                    if (x := self.at.get(word)) is None:
                        x = self.at[word] = len(self.values) + len(new)
                        new.append(xxhash.xxh3_64_intdigest(word))
                    found[i] = x
            self.values = np.concatenate([self.values, np.array(new, dtype=np.uint64)])
        return self.values[np.array(found, dtype=np.int64)]


def shingle_hashes(docs: list[list[bytes]], hashes: WordHashes, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, bounds)`` of the shingles of each text in order of place.

    A text of fewer words than ``size`` has all its words as its one shingle; a text without words has none.
    """
    n = np.array([len(d) for d in docs], dtype=np.int64)
    words = hashes([w for d in docs for w in d])
    total = len(words)
    folded = np.zeros(total, dtype=np.uint64)
    counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    bounds = np.cumsum(np.r_[0, counts])
    start = np.repeat(np.cumsum(n) - n, n)
    left = np.repeat(n, n) - (np.arange(total) - start)  # words from here to the end of the text
    with np.errstate(over="ignore"):
        for i in range(size):
            part = np.zeros(total, dtype=np.uint64)
            part[: max(total - i, 0)] = words[i:]
            part = np.where(left > i, part, np.uint64(0))
            folded = folded * np.uint64(0x9E3779B97F4A7C15) + part
    first = np.arange(total) - start
    keep = first < np.repeat(counts, n)
    return mixed(folded[keep]), bounds


# words beyond this many bytes are hashed one by one
LONG = 64
SPACE = np.isin(np.arange(256), np.frombuffer(SPACES, dtype=np.uint8))
# the lowest bytes of an eight-byte block
LOWEST = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)


def word_values(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, eight bytes of all words at a time, and the number of words of each."""
    data = b"\n".join([b"", *texts, bytes(8)])
    raw = np.frombuffer(data, dtype=np.uint8)
    space = SPACE[raw]
    space[len(raw) - 8 :] = True
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    length = np.flatnonzero(~space[:-1] & space[1:]) + 1 - start
    blocks = np.ndarray(len(raw) - 7, dtype="<u8", buffer=data, strides=(1,))
    out = np.zeros(len(start), dtype=np.uint64)
    some = np.flatnonzero(length <= LONG)
    done = 0
    with np.errstate(over="ignore"):
        while len(some):
            block = blocks[start[some] + done] & LOWEST[np.minimum(length[some] - done, 8)]
            value = (out[some] ^ block) * np.uint64(0x9E3779B97F4A7C15)
            out[some] = value ^ (value >> np.uint64(32))
            done += 8
            some = some[length[some] > done]
        for i in np.flatnonzero(length > LONG):
            out[i] = xxhash.xxh3_64_intdigest(data[start[i] : start[i] + length[i]])
        out = mixed(out + length.astype(np.uint64))
    ends = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return out, np.diff(np.searchsorted(start, ends))


def text_shingles(texts: list[bytes], size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, bounds)`` of the shingles of each text in order of place, none of a text of fewer words than ``size``.
    The hashes are not those of ``shingle_hashes``."""
    words, n = word_values(texts)
    bounds = np.cumsum(np.r_[0, np.maximum(n - size + 1, 0)])
    # first word of each shingle
    first = np.arange(bounds[-1]) + np.repeat(np.cumsum(n) - n - bounds[:-1], np.diff(bounds))
    folded = np.zeros(len(first), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            folded = folded * np.uint64(0x9E3779B97F4A7C15) + words[first + i]
    return mixed(folded), bounds
