"""Best-fit packing of tokenised documents, planned over the histogram of lengths.

Only counts of lengths meet on the driver: at most ``capacity`` numbers, however many documents there are. The plan
is a list of patterns, each a multiset of lengths and the number of sequences filled that way. Pieces take their slots
by a join on (length, rank), where the rank is a number within the length.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmine.session import cut_lineage

CAPACITY = 2048
END_ID = 0
# words whose ids are remembered by a task
KNOWN_WORDS = 600_000
# fixed value: the pattern that byte-level BPE vocabularies of this kind split text by before merging
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# nth: number of the piece among those of its length that the same task made
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, nth bigint"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in the vocabulary file: printable bytes are themselves, others follow 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of a byte-level BPE vocabulary file, as the tokenizers library gives them.

    Text is cut before each single space between two characters that are not white space; no token crosses such a
    place, as the pattern starts a match there. The cut parts repeat a lot, so their ids are remembered as bytes, and
    new ones are encoded by the same vocabulary as ranks. Texts with added tokens, other white space at a cut, or a
    vocabulary that is not plain byte-level BPE go to the tokenizers library whole.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.added = [t["content"] for t in spec["added_tokens"]]
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        self.plain = (
            model["type"] == "BPE"
            and spec["normalizer"] is None
            and before.get("type") == "ByteLevel"
            and not before.get("add_prefix_space")
            and before.get("use_regex", True)
            and not model.get("ignore_merges")
            and not model.get("dropout")
        )
        if self.plain:
            alphabet = byte_alphabet()
            ranks = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items() if t not in self.added}
            self.words = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes | bool] = {}

    def _part(self, word: str) -> bytes | bool:
        """Ids of a space and the word; False if white space touches that space or the next one."""
        if not word or word[0].isspace() or word[-1].isspace():
            return False
        return np.array(self.words.encode_ordinary(" " + word), dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not self.plain or any(t in text for t in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        first, *rest = text.split(" ")
        parts = list(map(self.known.get, rest))
        if None in parts:
            if len(self.known) > KNOWN_WORDS:
                self.known = {}
            for i, ids in enumerate(parts):
                if ids is None:
                    word = rest[i]
                    if (ids := self.known.get(word)) is None:
                        ids = self.known[word] = self._part(word)
                    parts[i] = ids
        if False in parts or first[-1:].isspace():
            return np.array(self.words.encode_ordinary(text), dtype="<u4").tobytes()
        return np.array(self.words.encode_ordinary(first), dtype="<u4").tobytes() + b"".join(parts)


def cut(ids: bytes, capacity: int) -> list[tuple[int, int, int]]:
    """``(start, length, crc32)`` of a document's pieces: all are full but the first, which holds the rest."""
    n = len(ids) // 4
    first = (n - 1) % capacity + 1
    edges = [0, *range(first, n + 1, capacity)]
    return [(a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for a, b in zip(edges, edges[1:])]


def token_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, vocabulary: str | None) -> DataFrame:
    """One row per piece of each document. ``vocabulary`` is a path on the executors; None: the public file there."""
    end = np.array([END_ID], dtype="<u4").tobytes()
    names = [f.split()[0] for f in PIECES.split(", ")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary or default_vocabulary())
        made: Counter = Counter()
        schema = pa.schema([(c, pa.int32() if c == "piece" else pa.int64()) for c in names])
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                doc, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for k, (start, length, crc) in enumerate(cut(encoder.ids(text or "") + end, capacity)):
                    rows.append((doc, k, start, length, crc, made[length]))
                    made[length] += 1
            columns = zip(*rows) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(encode, PIECES).withColumn("part", F.spark_partition_id())


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing over counts: ``(lengths, times)`` patterns that use every piece once.

    Lengths are taken from long to short. All open sequences with the same free space are one entry, so a step places
    many pieces at once: a length goes to the entries that it fits best, several times into each where it fits.
    """
    open_: dict[int, list[tuple[list[int], int]]] = {}
    spaces: list[int] = []

    def put(free: int, pattern: list[int], times: int) -> None:
        if free not in open_:
            insort(spaces, free)
            open_[free] = []
        open_[free].append((pattern, times))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                fit = capacity // length
                times, rest = divmod(left, fit)
                if times:
                    put(capacity - fit * length, [length] * fit, times)
                if rest:
                    put(capacity - rest * length, [length] * rest, 1)
                break
            free = spaces[at]
            pattern, times = open_[free].pop()
            if not open_[free]:
                del open_[free]
                spaces.pop(at)
            # one more into each of them; best fit goes on with the same sequence while it still fits best
            used = min(times, left)
            if used < times:
                put(free, pattern, times - used)
            put(free - length, [*pattern, length], used)
            left -= used
    return [(pattern, times) for entries in open_.values() for pattern, times in entries]


def slots(spark: SparkSession, patterns: list[tuple[list[int], int]]) -> DataFrame:
    """One row per length: the first rank of each of its slots, with the sequence and the offset there.

    Ranks from one ``lows`` value to the next lie in consecutive sequences. The table has at most ``capacity`` rows.
    """
    taken: Counter = Counter()
    places: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            places.setdefault(length, []).append((taken[length], sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    rows = [(length, *map(list, zip(*found))) for length, found in places.items()]
    return spark.createDataFrame(rows, "length bigint, lows array<bigint>, sequences array<bigint>, offsets array<bigint>")


def ranked(pieces: DataFrame) -> DataFrame:
    """Number of each piece within its length, from 0: its number in its task, after the counts of earlier tasks."""
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    return pieces.join(offsets, ["length", "part"]).withColumn("rank", F.col("nth") + F.col("earlier"))


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    vocabulary: str | None = None,
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, one row per piece of each document.

    Null and empty texts are one piece that holds the end id. Repeated rows and null ids are packed as rows of their
    own; ties between pieces of a length go by the order in which tasks made them. An empty table gives an empty
    result; other columns are not read.
    """
    pieces = cut_lineage(token_pieces(docs, id_col, text_col, capacity, vocabulary), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = slots(docs.sparkSession, plan(counts, capacity))
    placed = ranked(pieces).join(F.broadcast(table), "length")
    at = F.expr("size(filter(lows, x -> x <= rank)) - 1")
    return placed.withColumn("at", at).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.expr("sequences[at] + rank - lows[at]").alias("sequence_id"),
        F.expr("offsets[at]").alias("offset"),
    )
