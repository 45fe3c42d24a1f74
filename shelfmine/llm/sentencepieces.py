"""Encoding and decoding with a SentencePiece vocabulary, by suffix-array matching.

The distinct words of a batch are one text with a suffix array over it. Binary search finds the range of suffixes that
start with each piece; these occurrences are edges of a lattice, sorted by the place where they end, and relaxed in
that order. In a vocabulary of merges the encoding of a prefix is the one path whose neighbouring pieces stay apart
when both are encoded together, so an edge relaxes its end if it stays apart from the piece that ends at its start.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmine.llm.common import as_bytes, pieces

SPACE = "▁"
# words, and pairs of pieces, that a task remembers
KNOWN_WORDS = 700_000
KNOWN_PAIRS = 2_000_000

IDS = "doc_id bigint, ids array<int>, n_ids bigint, restored boolean"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces with their scores, read from a model file by the public library."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {self.pieces[i]: model.get_score(i) for i in plain}
        self.unknown = model.unk_id()
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece goes on after a space inside it: words cannot be encoded one by one")
        table = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for value, i in self.bytes.items():
            table[i] = bytes([value])
        for i in range(n):
            if model.is_control(i):
                table[i] = b""
            elif i == self.unknown:
                table[i] = " ⁇ ".encode()
        self.table = table

    def merged(self, symbols: list[str]) -> list[str]:
        """Merges the neighbours whose joint piece has the highest score, the leftmost of equals, until none is left."""
        scores = self.scores
        joined = [scores.get(a + b) for a, b in zip(symbols, symbols[1:])]
        while True:
            best, at = None, -1
            for i, s in enumerate(joined):
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return symbols
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
            del joined[at]
            if at > 0:
                joined[at - 1] = scores.get(symbols[at - 1] + symbols[at])
            if at < len(joined):
                joined[at] = scores.get(symbols[at] + symbols[at + 1])


class Encoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.texts = [p for p in vocabulary.ids if vocabulary.merged(list(p)) == [p]]
        chars = sorted({c for p in self.texts for c in p})
        # code 0 ends a word, code 1 is a character of no piece
        self.codes = {c: i + 2 for i, c in enumerate(chars)}
        self.bits = max(2, (len(chars) + 2).bit_length())
        self.per_key = 64 // self.bits
        self.longest = max(map(len, self.texts))
        self.n_keys = -(-self.longest // self.per_key)
        points = np.array([ord(c) for c in chars], dtype=np.int64)
        self.points, self.point_codes = points, np.arange(2, len(chars) + 2)
        self.piece_ids = np.array([vocabulary.ids[p] for p in self.texts], dtype=np.int64)
        self.lengths = np.array([len(p) for p in self.texts], dtype=np.int64)
        coded = np.zeros((len(self.texts), self.n_keys * self.per_key), dtype=np.uint64)
        upper = np.full_like(coded, (1 << self.bits) - 1)
        for i, p in enumerate(self.texts):
            coded[i, : len(p)] = upper[i, : len(p)] = [self.codes[c] for c in p]
        self.low_keys, self.high_keys = self._packed(coded), self._packed(upper)
        self.known: dict[str, bytes] = {}
        self.apart: dict[int, bool] = {}
        self.size = len(vocabulary.pieces)
        self.single = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def _packed(self, coded: np.ndarray) -> list[np.ndarray]:
        out = []
        for k in range(self.n_keys):
            key = np.zeros(len(coded), dtype=np.uint64)
            for j in range(k * self.per_key, (k + 1) * self.per_key):
                key = (key << np.uint64(self.bits)) | coded[:, j]
            out.append(key)
        return out

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(start, piece)`` of all occurrences of pieces in the coded text."""
        n = len(text)
        padded = np.r_[text, np.zeros(self.n_keys * self.per_key, dtype=np.uint64)]
        keys = []
        for k in range(self.n_keys):
            key = np.zeros(n, dtype=np.uint64)
            for j in range(k * self.per_key, (k + 1) * self.per_key):
                key = (key << np.uint64(self.bits)) | padded[j : j + n]
            keys.append(key)
        # by the first characters, then the groups that these leave equal by the rest
        suffixes = np.argsort(keys[0], kind="stable")
        for k in range(1, self.n_keys):
            equal = np.ones(n - 1, dtype=bool)
            for key in keys[:k]:
                equal &= key[suffixes[1:]] == key[suffixes[:-1]]
            inside = np.r_[equal, False] | np.r_[False, equal]
            some = np.flatnonzero(inside)
            group = np.cumsum(~np.r_[False, equal])[some]
            suffixes[some] = suffixes[some][np.lexsort((keys[k][suffixes[some]], group))]
        keys = [k[suffixes] for k in keys]

        def bound(wanted: list[np.ndarray], after: bool) -> np.ndarray:
            low, high = np.zeros(len(self.texts), dtype=np.int64), np.full(len(self.texts), n, dtype=np.int64)
            while (low < high).any():
                middle = (low + high) // 2
                at = np.minimum(middle, n - 1)
                less = np.zeros(len(low), dtype=bool)
                same = np.ones(len(low), dtype=bool)
                for k, w in zip(keys, wanted):
                    less |= same & (k[at] < w)
                    same &= k[at] == w
                go = (less | (same if after else False)) & (low < high)
                low, high = np.where(go, middle + 1, low), np.where(go | (low >= high), high, middle)
            return low

        first, last = bound(self.low_keys, False), bound(self.high_keys, True)
        count = last - first
        piece = np.repeat(np.arange(len(self.texts), dtype=np.int32), count)
        at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return suffixes.astype(np.int32)[at], piece

    def stays_apart(self, key: int) -> bool:
        known = self.apart.get(key)
        if known is None:
            a, b = self.texts[key // len(self.texts)], self.texts[key % len(self.texts)]
            known = self.apart[key] = self.v.merged([*a, *b]) == [a, b]
        return known

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids (little-endian 32-bit) of each word; words have no space but at their start."""
        joined = "\0".join(words) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        place = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        text = np.where(self.points[place] == points, self.point_codes[place], 1).astype(np.uint64)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        text[starts + sizes] = 0
        start, piece = self.edges(text)
        # a character of no piece is an edge of its own; it never joins its neighbours
        none = len(self.texts)
        lone = np.flatnonzero(text == 1).astype(np.int32)
        start, piece = np.r_[start, lone], np.r_[piece, np.full(len(lone), none, dtype=np.int32)]
        length = np.r_[self.lengths, 1].astype(np.int32)[piece]
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes + 1)[start]
        end = start + length - starts.astype(np.int32)[word]
        # by end, then word, longer pieces first
        order = np.argsort((end * np.int64(len(words)) + word) * (self.longest + 1) + self.longest - length)
        del length
        start, piece, word, end = start[order], piece[order], word[order], end[order]
        last = np.full(len(text) + 1, -1, dtype=np.int64)  # by place: the piece that ends there
        steps = np.searchsorted(end, np.arange(1, (end.max() if len(end) else 0) + 2))
        for a, b in zip(steps, steps[1:]):
            live = np.arange(a, b)
            while len(live):
                # the next candidate of each word that has none at this end yet
                lead = live[np.r_[True, word[live][1:] != word[live][:-1]]]
                before = last[start[lead]]
                first = start[lead] == starts[word[lead]]
                free = first | (before == none) | (piece[lead] == none)
                good = free & (first | (before >= 0))
                ask = ~free & (before >= 0)
                keys, back = np.unique(before[ask] * np.int64(none) + piece[lead[ask]], return_inverse=True)
                good[ask] = np.fromiter(map(self.stays_apart, keys.tolist()), dtype=bool, count=len(keys))[back]
                won = lead[good]
                last[starts[word[won]] + end[won]] = piece[won]
                done = np.zeros(len(words), dtype=bool)
                done[word[won]] = True
                rest = np.ones(b - a, dtype=bool)
                rest[lead - a] = False
                live = live[rest[live - a] & ~done[word[live]]]
        if len(self.apart) > KNOWN_PAIRS:
            self.apart.clear()
        # back from the ends
        sizes_of = np.r_[self.lengths, 1]
        at, who = starts + sizes, np.arange(len(words))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(who):
            here = last[at]
            begin = at - sizes_of[here]
            found.append((who, begin, here))
            more = begin > starts[who]
            who, at = who[more], begin[more]
        if not found:
            return [b""] * len(words)
        who, begin, here = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(begin, kind="stable")
        who, begin, here = who[order], begin[order], here[order]
        ids = np.r_[self.piece_ids, -1][here].astype("<i4")
        edges = np.searchsorted(who, np.arange(len(words) + 1))
        out = []
        odd = set(who[here == none].tolist())
        raw = ids.tobytes()
        for i in range(len(words)):
            if i in odd:
                own: list[int] = []
                for p, x in zip(begin[edges[i] : edges[i + 1]], ids[edges[i] : edges[i + 1]]):
                    if x >= 0:
                        own.append(int(x))
                    else:
                        char = chr(points[p])
                        own += [self.v.bytes[c] for c in char.encode()] if self.v.bytes else [self.v.unknown]
                out.append(np.array(own, dtype="<i4").tobytes())
            else:
                out.append(raw[4 * edges[i] : 4 * edges[i + 1]])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. A text gets a space before it; every space is the mark of a word."""
        split = []
        for text in texts:
            words = text.replace(" ", SPACE).split(SPACE) if text else []
            if "" in words:  # several spaces meet
                words = self.single.findall(SPACE + text.replace(" ", SPACE))
                words = [w[1:] if len(w) > 1 and w[1] != SPACE else w for w in words]
            split.append(words)
        if len(self.known) > KNOWN_WORDS:
            self.known = {}
        new = list({w for words in split for w in words} - self.known.keys())
        if new:
            full = [w if w.startswith(SPACE) else SPACE + w for w in new]
            self.known.update(zip(new, self.encode_words(full)))
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, ids: list[int]) -> bytes:
        """Text of the ids, without the space that encoding puts first."""
        text = b"".join(map(self.v.table.__getitem__, ids))
        return text[1:] if text.startswith(b" ") else text


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """``(doc_id, ids, n_ids, restored)``, one row per input row; ``restored`` says that the ids decode to the text.

    Null and empty texts have no ids. Repeated rows and null ids are rows like others; an empty table gives an empty
    result; other columns are not read. A text that holds the word mark itself (U+2581) decodes to a space there.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(model or default_model()))
        for batch in batches:
            done = 0
            for piece in pieces(as_bytes(batch.column(1)), 3 * 1024 * 1024):
                ids = encoder.encode([t.decode("utf-8", "replace") for t in piece])
                n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                whole = np.frombuffer(b"".join(ids), dtype="<i4")
                restored = [encoder.decode(np.frombuffer(x, dtype="<i4").tolist()) == t for x, t in zip(ids, piece)]
                offsets = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(done, len(piece)),
                        pa.ListArray.from_arrays(offsets, pa.array(whole)),
                        pa.array(n),
                        pa.array(restored, pa.bool_()),
                    ],
                    names=["doc_id", "ids", "n_ids", "restored"],
                )
                done += len(piece)

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(encode, IDS)


def decoded(rows: DataFrame, ids_col: str = "ids", text_col: str = "text", model: str | None = None):
    """``rows`` with the text of their ids; null ids give a null text."""

    def decode(column: pa.Array) -> pa.Array:
        encoder = Encoder.__new__(Encoder)
        encoder.v = Vocabulary(model or default_model())
        return pa.array([None if x is None else encoder.decode(x).decode("utf-8", "replace") for x in column.to_pylist()], pa.string())

    decode.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return rows.withColumn(text_col, F.arrow_udf(decode, "string")(rows[ids_col]))
