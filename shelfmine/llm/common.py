"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmine.session import cut_lineage

# white space of the word definition [^\x20\x09-\x0D]+; also what bytes.split() splits at
SPACES = b"\x09\x0a\x0b\x0c\x0d\x20"
# texts are worked on in pieces of about this many bytes, so that memory does not grow with a batch
PIECE_BYTES = 4 * 1024 * 1024


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, stem: str) -> DataFrame:
    """``cut_lineage``, where the shuffle files of the job go as soon as the table is written."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return cut_lineage(df, stem)
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(texts: list[bytes], limit: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """Consecutive texts of about ``limit`` bytes together; one longer text is a piece of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield texts[start:i]
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield texts[start:]


def byte_pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The texts of a column as ``pieces`` of bytes, of which one is held at a time."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.r_[0, sizes], dtype=np.int64)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1)
        yield as_bytes(column.slice(start, stop - start))
        start = stop


def fold(doc_id: Column, parts: int) -> Column:
    """``crc32(doc_id as text) mod parts``; a null id counts as the text "null"."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), F.lit(parts)).cast("int")


def word_lists(texts: list[bytes]) -> list[list[bytes]]:
    return [t.split() for t in texts]


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Bijective scrambling of 64-bit values (splitmix finalizer)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
