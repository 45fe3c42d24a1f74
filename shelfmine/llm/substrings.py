"""Near-duplicate passages across documents, from compact windows.

A compact window (l, c, r) of a hash function stands for all subsequences that start in [l, c] and end in [c, r]: their
min-hash is that of the shingle at c. Windows of at least the shortest passage are the large nodes of the Cartesian
tree over the hashes of a text. A passage of 50 words with a similarity of 0.8 has at most one changed word, so some 25
words in a row stay as they are: the signature of a window is its shingle and the 15 words before it, and once more the
15 words after it. Windows of one signature point to the window of the document that holds it first; windows that point
to one document close to one diagonal are joined to a region, and the texts of the regions are compared in full.

Windows outside the passages found so have met a first document that is no match. They and the other places of their
signature are grouped again by longer stretches around the window: first by 16 to 41 shingles, then, where stretches of
these still agree, by each stretch of the shortest passage. Each group points to its first place, so the work of a
level is proportional to its windows, and exact copies always meet, however many texts share a line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmine.llm.common import PIECE_BYTES, byte_pieces, mixed, written
from shelfmine.llm.shingles import SIMILARITY, WORDS, text_shingles
from shelfmine.session import drop_steps

# shortest passage, in words
LEAST = 50
FUNCTIONS = 3
# windows that must agree on a region; each has 15 words in common with the other document
MIN_HASHES = 1
# shingles of a signature on one side of its place, the place included
STRETCH = 11
# windows of a region: how far their diagonals and their places may lie apart
DRIFT = 16
# bounds of the first document's part are rounded, so that regions of many documents ask for the same text
ROUND = 32
# bytes of texts that a task works on at once
HELD = PIECE_BYTES // 2
# back, forth: how far the window goes on both sides of its place, up to the shortest passage
# the three are one number while all windows are exchanged and sorted
WINDOWS = "rid bigint, key bigint, place bigint"
PLACE = "int(shiftright(place, 32)) at", "smallint(shiftright(place, 16) & 65535) back", "smallint(place & 65535) forth"
PLACES = "key bigint, rid bigint, at int, back smallint, forth smallint, open boolean, long boolean"
REGIONS = "rid bigint, hub bigint, low int, high int, hub_low int, hub_high int"
PASSAGES = "doc_id bigint, rid bigint, start int, stop int, first_doc_id bigint, first_start int, first_stop int"
# exact: the passage is the first document's, word by word
COMPARED = f"{PASSAGES}, exact boolean"


def sliding(values: np.ndarray, size: int, op: np.ufunc, fill: int) -> np.ndarray:
    """``op`` over ``values[i : i + size]`` for each i that has so many, by prefixes and suffixes of blocks."""
    n = len(values)
    padded = np.full(-(-n // size) * size, fill, dtype=values.dtype)
    padded[:n] = values
    block = padded.reshape(-1, size)
    prefix = op.accumulate(block, axis=1).ravel()
    suffix = op.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(suffix[: n - size + 1], prefix[size - 1 : n])


def compact_windows(values: np.ndarray, bounds: np.ndarray, size: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places c with the first and last place of their windows, of all texts: the nodes of the Cartesian trees whose
    subtrees hold ``size`` places or more. Windows are cut off at ``reach`` places from c.

    A place is such a node if it is the smallest of some run of ``size`` places. The ancestors of a node are nodes, so
    the next smaller values on both sides are found among the nodes alone, neighbours first. Values are distinct.
    """
    n = len(values)
    none = np.zeros(0, dtype=np.int64)
    if n < size:
        return none, none, none
    least = sliding(values, size, np.minimum, np.iinfo(np.uint64).max)
    end = np.repeat(bounds[1:], np.diff(bounds))
    runs = np.zeros(n + size - 1, dtype=np.uint64)
    inside = np.arange(len(least)) + size <= end[: len(least)]
    runs[size - 1 : size - 1 + len(least)] = np.where(inside, least, 0)
    node = np.flatnonzero(values == sliding(runs, size, np.maximum, 0))
    doc = np.searchsorted(bounds, node, side="right") - 1
    low, high = np.maximum(bounds[doc], node - reach), np.minimum(bounds[doc + 1] - 1, node + reach)
    height = values[node]
    for k in range(1, len(node)):
        left, right = node[:-k], node[k:]
        near = right - left <= reach
        if not near.any():
            break
        smaller = height[:-k] < height[k:]
        low[k:] = np.where(near & smaller, np.maximum(low[k:], left + 1), low[k:])
        high[:-k] = np.where(near & ~smaller, np.minimum(high[:-k], right - 1), high[:-k])
    return node, low, high


def leftmost(values: np.ndarray) -> np.ndarray:
    """The values with the place in their low 20 bits, so that equal ones differ and the first counts as smaller."""
    low = np.uint64(2**20 - 1)
    return (values & ~low) | (np.arange(len(values), dtype=np.uint64) & low) | np.uint64(2**20)


def row_id(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """64-bit identity of a row by its id and text: rows that repeat both are one document."""
    text = F.coalesce(docs[text_col], F.lit(""))
    return F.xxhash64(docs[id_col].isNull(), docs[id_col], text)


def prefixes(values: np.ndarray) -> np.ndarray:
    """``p`` such that ``p[j] ^ p[i]`` is a fingerprint of the shingles from i to j."""
    return np.r_[np.uint64(0), np.bitwise_xor.accumulate(mixed(values, seed=99))]


def stretch_keys(prefix: np.ndarray, at: np.ndarray, first: np.ndarray, end: np.ndarray, before: int, after: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the places have so many shingles before and after them in their text, and the fingerprints of these."""
    fits = np.flatnonzero((at - before >= first) & (at + after < end))
    own = at[fits]
    return fits, mixed(prefix[own + after + 1] ^ prefix[own - before], seed=1000 * before + after)


def windows(docs: DataFrame, id_col: str, text_col: str, least: int, functions: int, words: int) -> DataFrame:
    size = least - words + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for piece in byte_pieces(batch.column(1), HELD):
                ids = batch.column(0).slice(done, len(piece)).to_numpy()
                done += len(piece)
                values, bounds = text_shingles(piece, words)
                prefix = prefixes(values)
                for f in range(functions):
                    height = mixed(values, seed=f + 1)
                    at, low, high = compact_windows(leftmost(height), bounds, size, size)
                    doc = np.searchsorted(bounds, at, side="right") - 1
                    place = ((at - bounds[doc]) << 32) | ((at - low) << 16) | (high - at)
                    for before, after in ((STRETCH - 1, 0), (0, STRETCH - 1)):
                        fits, stretch = stretch_keys(prefix, at, bounds[doc], bounds[doc + 1], before, after)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(ids[doc[fits]]),
                                pa.array(mixed(height[at[fits]] ^ stretch).view(np.int64)),
                                pa.array(place[fits]),
                            ],
                            names=["rid", "key", "place"],
                        )

    rows = docs.select(row_id(docs, id_col, text_col).alias("rid"), docs[text_col].alias("text"))
    return rows.mapInArrow(cut, WINDOWS)


def longer_stretches(size: int) -> list[tuple[int, int]]:
    """Shingles before and after a place: some for passages with a changed word, and such that a passage of ``size``
    shingles around a place holds one of the last kind whole."""
    near = [(size // 3, 0), (0, size // 3), ((size - 1) // 2, 0), (0, (size - 1) // 2), (STRETCH - 1, STRETCH - 1)]
    return near + [(i, max(size - 6, 0) - i) for i in range(0, max(size - 6, 0) + 1, 5)]


def keyed(places: DataFrame, texts: DataFrame, stretches: list[tuple[int, int]], words: int) -> DataFrame:
    """A row per place of ``places`` and stretch around it that the text has, with a fingerprint of the stretch."""
    place = F.struct("at", "back", "forth", "open")
    own = places.groupBy("rid").agg(F.collect_list(place).alias("places"))
    names = [c.split()[0] for c in PLACES.split(", ")]
    longest = max(before + after for before, after in stretches)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for piece in byte_pieces(batch.column("text"), HELD):
                part = batch.slice(done, len(piece))
                done += len(piece)
                values, bounds = text_shingles(piece, words)
                prefix = prefixes(values)
                lists = part.column("places")
                doc = np.repeat(np.arange(len(piece)), np.diff(lists.offsets.to_numpy()))
                fields = dict(zip(("at", "back", "forth", "open"), lists.flatten().flatten()))
                at = fields["at"].to_numpy() + bounds[doc]
                ids = part.column("rid").to_numpy()[doc]
                for before, after in stretches:
                    fits, stretch = stretch_keys(prefix, at, bounds[doc], bounds[doc + 1], before, after)
                    rows = [x.take(pa.array(fits)) for x in fields.values()]
                    long = pa.array(np.full(len(fits), before + after == longest))
                    yield pa.RecordBatch.from_arrays([pa.array(stretch.view(np.int64)), pa.array(ids[fits]), *rows, long], names=names)

    return own.join(texts, "rid").select("rid", "text", "places").mapInArrow(cut, PLACES)


def first_places(places: DataFrame) -> DataFrame:
    """Open places beside the first place of their key, if another document holds that."""
    first = places.groupBy("key").agg(F.min(F.struct("rid", "at")).alias("first"), F.max(F.when(F.col("open"), F.col("rid"))).alias("last"))
    first = first.where("first.rid < last").select("key", F.col("first.rid").alias("hub"), F.col("first.at").alias("hub_at"))
    return places.where("open").join(first, "key").where("hub < rid").select("rid", "hub", "at", "back", "forth", "hub_at").distinct()


def joined_regions(at: np.ndarray, low: np.ndarray, high: np.ndarray, hub_at: np.ndarray, least: int) -> list[tuple[int, ...]]:
    """Regions ``(low, high, hub first, hub last)`` of windows of a pair of documents that follow each other near one
    diagonal: the union of the windows, and the places in the other document. A region needs ``MIN_HASHES`` windows."""
    band = (at - hub_at) // DRIFT
    order = np.lexsort((at, band))
    at, low, high, hub_at, band = at[order], low[order], high[order], hub_at[order], band[order]
    first = np.flatnonzero(np.r_[True, (band[1:] != band[:-1]) | (np.diff(at) > least)])
    found = zip(
        at[first].tolist(),
        np.maximum.reduceat(at, first).tolist(),
        np.minimum.reduceat(hub_at, first).tolist(),
        np.maximum.reduceat(hub_at, first).tolist(),
        np.minimum.reduceat(low, first).tolist(),
        np.maximum.reduceat(high, first).tolist(),
        np.diff(np.r_[first, len(at)]).tolist(),
    )
    # neighbouring diagonals: an inserted word moves the rest of a passage to the next one
    out: list[list[int]] = []
    near: list[list[int]] = []
    for a, b, c, d, lo, hi, n in sorted(found):
        near = [x for x in near if a - x[1] <= least]
        for x in reversed(near):
            if abs((a - c) - (x[1] - x[3])) <= 2 * DRIFT and c - x[3] <= least:
                x[:] = [x[0], max(x[1], b), min(x[2], c), max(x[3], d), min(x[4], lo), max(x[5], hi), x[6] + n]
                break
        else:
            out.append([a, b, c, d, lo, hi, n])
            near.append(out[-1])
    return [(x[4], x[5], x[2], x[3]) for x in out if x[6] >= MIN_HASHES]


def regions(found: DataFrame, least: int, words: int) -> DataFrame:
    """Regions of each pair of a document and the first document of its signatures, as ranges of shingles. The first
    document's range is wider than its places by the shortest passage, as a passage need not end with a place."""
    place = F.struct("at", "back", "forth", "hub_at")
    pairs = found.groupBy("rid", "hub").agg(F.collect_list(place).alias("places")).where(F.size("places") >= MIN_HASHES)
    wide = least - words + 1
    names = [c.split()[0] for c in REGIONS.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            places = batch.column(2)
            edges = places.offsets.to_numpy() - places.offsets[0].as_py()
            at, back, forth, hub_at = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in places.flatten().flatten())
            low, high = at - back, at + forth
            for rid, hub, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), edges, edges[1:]):
                for start, stop, c, d in joined_regions(at[a:b], low[a:b], high[a:b], hub_at[a:b], least):
                    rows.append((rid, hub, start, stop, max(c - wide, 0) // ROUND * ROUND, -(-(d + wide) // ROUND) * ROUND))
            columns = zip(*rows) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return pairs.mapInArrow(join, REGIONS)


def alike(a: np.ndarray, b: np.ndarray, least: int, similarity: float, words: int) -> list[tuple[int, int, int, int]]:
    """Passages ``(start, stop, start, stop)`` of shingles of ``a`` that repeat in ``b``: stretches that start and end
    with a common shingle, are long enough, and have a Jaccard similarity of the threshold or more.

    A stretch goes on over gaps of up to two changed words, and is halved at its largest gap where it is not similar
    enough as a whole.
    """
    # numbers instead of values, so that sets are masks and only the one sort is needed
    known, number = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = number[: len(a)], number[len(a) :]
    inside = np.zeros(len(known), dtype=bool)
    inside[b] = True
    size = least - words + 1
    found = []
    places = np.flatnonzero(inside[a])
    todo = np.split(places, np.flatnonzero(np.diff(places) > 2 * words + 1) + 1)
    while todo:
        some = todo.pop()
        if len(some) == 0 or some[-1] - some[0] + 1 < size:
            continue
        first, last = some[0], some[-1] + 1
        own = np.zeros(len(known), dtype=bool)
        own[a[first:last]] = True
        at = np.flatnonzero(own[b])
        # the densest part of b as long as the stretch holds its counterpart, if b repeats shingles elsewhere
        length = last - first
        if at[-1] - at[0] + 1 > length * 5 // 4:
            near = np.searchsorted(at, at + length * 5 // 4) - np.arange(len(at))
            k = int(near.argmax())
            at = at[k : k + near[k]]
        other = np.zeros(len(known), dtype=bool)
        other[b[at[0] : at[-1] + 1]] = True
        if np.count_nonzero(own & other) >= similarity * np.count_nonzero(own | other) - 1e-9:
            found.append((int(first), int(last), int(at[0]), int(at[-1]) + 1))
            continue
        gaps = np.diff(some)
        if len(gaps) and gaps.max() > 1:
            k = int(gaps.argmax()) + 1
            todo += [some[:k], some[k:]]
    return sorted(found)


def texts_of(docs: DataFrame, needed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(rid, doc_id, text)`` of the documents of ``needed``, one row each."""
    texts = docs.select(row_id(docs, id_col, text_col).alias("rid"), docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    # a merge join at any size: the documents with regions grow with the corpus
    return written(texts.join(needed.distinct().hint("merge"), "rid").dropDuplicates(["rid"]), "texts")


def compared(asked: DataFrame, texts: DataFrame, least: int, similarity: float, words: int) -> DataFrame:
    """Passages of the regions whose texts are alike."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (x.as_py() for x in batch.column("text").cast(pa.binary()))
            for hub, doc, text, ranges in zip(*(batch.column(c).to_pylist() for c in ("hub", "doc_id")), texts, batch.column("ranges")):
                own = (text or b"").split()
                low, high = (np.array(x) for x in zip(*((r["hub_low"], r["hub_high"]) for r in ranges.as_py())))
                part = [b" ".join(own[a : b + words - 1]) for a, b in zip(low, high)]
                columns = [pa.array([x] * len(part), pa.int64()) for x in (hub, doc)] + [pa.array(low, pa.int32()), pa.array(high, pa.int32())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(part, pa.binary())], names=["hub", "first_doc_id", "hub_low", "hub_high", "part"])

    # each text is read once for all its parts
    wanted = asked.groupBy("hub").agg(F.collect_set(F.struct("hub_low", "hub_high")).alias("ranges"))
    parts = wanted.join(texts, wanted["hub"] == texts["rid"]).select("hub", "doc_id", "text", "ranges")
    parts = parts.mapInArrow(slices, "hub bigint, first_doc_id bigint, hub_low int, hub_high int, part binary")
    parts = asked.join(parts, ["hub", "hub_low", "hub_high"])
    grouped = parts.groupBy("rid").agg(F.collect_list(F.struct("low", "high", "hub_low", "first_doc_id", "part")).alias("parts"))

    names = [c.split()[0] for c in COMPARED.split(", ")]
    types = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    kinds = [types[c.split()[1]] for c in COMPARED.split(", ")]

    def compare(some: list[tuple]) -> pa.RecordBatch:
        """Passages of some documents; the shingles of all their texts and parts are made together."""
        texts_ = [t for _, _, text, parts in some for t in (text, *(p["part"] for p in parts))]
        values, bounds = text_shingles(texts_, words)
        rows, at, more = [], 0, words - 1
        for rid, doc, _, parts in some:
            own = values[bounds[at] : bounds[at + 1]]
            for k, p in enumerate(parts, at + 1):
                other = values[bounds[k] : bounds[k + 1]]
                part = own[p["low"] : p["high"] + 1]
                for a, b, c, d in alike(part, other, least, similarity, words):
                    ends = (a + p["low"], b + p["low"] + more, p["first_doc_id"], c + p["hub_low"], d + p["hub_low"] + more)
                    rows.append((doc, rid, *ends, np.array_equal(part[a:b], other[c:d])))
            at += len(parts) + 1
        columns = zip(*rows) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some, size = [], 0
            rows = zip(
                batch.column("rid").to_pylist(),
                batch.column("doc_id").to_pylist(),
                (x.as_py() or b"" for x in batch.column("text").cast(pa.binary())),
                (x.as_py() for x in batch.column("parts")),
            )
            for row in rows:
                some.append(row)
                size += len(row[2]) + sum(len(p["part"]) for p in row[3])
                if size > HELD:
                    yield compare(some)
                    some, size = [], 0
            yield compare(some)

    return grouped.join(texts, "rid").select("rid", "doc_id", "text", "parts").mapInArrow(verify, COMPARED)


def outside(places: DataFrame, passages: DataFrame, words: int) -> DataFrame:
    """The places that lie in no exact passage of their document; one that lies in any other passage is not open any more.
    Each document has its passages as a list, so that its places are exchanged once for both questions."""
    spans = passages.select("rid", "exact", F.struct("start", (F.col("stop") - (words - 1)).alias("end")).alias("span")).distinct()
    lists = [F.collect_list(F.when(kind, F.col("span"))) for kind in (F.col("exact"), ~F.col("exact"))]
    spans = spans.groupBy("rid").agg(lists[0].alias("copies"), lists[1].alias("others"))

    def inside(spans: str) -> Column:
        found = F.exists(spans, lambda s: (F.col("at") >= s["start"]) & (F.col("at") < s["end"]))
        return F.coalesce(found, F.lit(False))

    rest = places.join(spans, "rid", "left").where(~inside("copies"))
    return rest.select("key", "rid", "at", "back", "forth", (F.col("open") & ~inside("others")).alias("open"))


def unmatched(places: DataFrame, passages: DataFrame, words: int) -> DataFrame:
    """``(rid, at, back, forth, open)`` of places whose key has an open place outside all passages, and an earlier
    place in another document that is no exact copy. Whether a place is open goes by its key and document."""
    # written, as both the ends of the keys and the places read it
    rest = written(outside(places, passages, words), "rest")
    ends = rest.groupBy("key").agg(F.min("rid").alias("first"), F.max(F.when(F.col("open"), F.col("rid"))).alias("last"))
    found = rest.join(ends.where("first < last"), "key").where("rid <= last")
    found = found.groupBy("rid", "at").agg(F.max("back").alias("back"), F.max("forth").alias("forth"), F.max("open").alias("open"))
    found = written(found, "places")
    drop_steps(rest)
    return found


def repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = LEAST,
    similarity: float = SIMILARITY,
    functions: int = FUNCTIONS,
    words: int = WORDS,
) -> DataFrame:
    """``(doc_id, rid, start, stop, first_doc_id, first_start, first_stop)``: passages of ``least`` words or more, as
    ranges of words, that repeat a passage of another document, the one that keeps it.

    Which document keeps a passage goes by a hash of id and text. Rows that repeat both are one document; a null id is
    an id like others. Null, empty and shorter texts have no passages; an empty table gives an empty result; other
    columns are not read.
    """
    # dealt and sorted here, so that the window function's pairs of columns are made after the exchange
    found = windows(docs, id_col, text_col, least, functions, words).repartition("key").sortWithinPartitions("key")
    # only windows whose signature two documents have; they are few, and everything after works on them. A window function, so
    # that all windows are exchanged once, straight from the texts, and not a second time for the first and last document of
    # each signature
    same = W.partitionBy("key")
    # the first place, too, so that no join with the signatures is needed to know where their first document holds them
    first = F.min(F.struct("rid", "place")).over(same)
    both = found.withColumns({"first": first, "last": F.max("rid").over(same)}).where("first.rid < last")
    met = written(both.selectExpr("key", "rid", "first.rid hub", "int(shiftright(first.place, 32)) hub_at", *PLACE), "met")
    # dealt by pairs of documents once, for equal points and for the regions
    points = met.where("rid <> hub").select("rid", "hub", "at", "back", "forth", "hub_at").repartition("rid", "hub").distinct()

    def passages_of(points: DataFrame) -> DataFrame:
        asked = written(regions(points, least, words), "regions")
        texts = texts_of(docs, asked.select("rid").unionByName(asked.select(F.col("hub").alias("rid"))), id_col, text_col)
        passages = written(compared(asked, texts, least, similarity, words), "passages")
        drop_steps(asked, texts)
        return passages

    def levelled(places: DataFrame, stretches: list[tuple[int, int]]) -> DataFrame:
        texts = texts_of(docs, places.select("rid"), id_col, text_col)
        level = written(keyed(places, texts, stretches, words), "level")
        drop_steps(texts)
        return level

    out = passages_of(points)
    # open places met their first document only; an exact copy stands for nothing that its first document has not shown
    other = met.where("rid <> hub or at <> hub_at").select("key", "rid", "at", "back", "forth", (F.col("rid") != F.col("hub")).alias("open"))
    size = least - words + 1
    for stretches in (longer_stretches(size), [(i, size - 1 - i) for i in range(size)]):
        places = unmatched(other, out, words)
        drop_steps(met)
        if places.isEmpty():
            drop_steps(places)
            break
        met = levelled(places, stretches)
        drop_steps(places)
        new = passages_of(first_places(met))
        out = out.unionByName(new)
        # passages without a change have one of the longest stretches in common
        other = met.where("long").drop("long")
    else:
        drop_steps(met)
    # two signatures may have led to one passage
    return out.drop("exact").distinct()


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and the white space after each of them."""
    at = [m.start() for m in regex.finditer(rb"[^\x20\x09-\x0D]+", text)] + [len(text)]
    out, done = [], 0
    for start, stop in sorted(spans):
        a, b = at[min(start, len(at) - 1)], at[min(stop, len(at) - 1)]
        if a > done:
            out.append(text[done:a])
        done = max(done, b)
    return b"".join([*out, text[done:]])


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """The rows of ``docs`` with repeated passages taken out of their texts, and ``length_col`` set to the new number
    of code points of texts that changed. All rows stay; one whose whole text repeats is left with an empty text."""
    spans = repeats(docs, id_col, text_col, **options).groupBy("rid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, s in zip(text.to_pylist(), spans.to_pylist()):
            out.append(without(t.encode(), [(x["start"], x["stop"]) for x in s]).decode("utf-8", "replace") if s else t)
        return pa.array(out, pa.string())

    cut.__annotations__ = {"text": pa.Array, "spans": pa.Array, "return": pa.Array}
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), row_id(docs, id_col, text_col).alias("rid")).join(spans.hint("merge"), "rid", "left")
    new = F.arrow_udf(cut, "string")(F.col("row")[text_col], F.col("spans"))
    rows = rows.withColumn("new", new)
    changed = F.col("spans").isNotNull()
    columns = []
    for name in docs.columns:
        value = F.col("row")[name]
        if name == text_col:
            value = F.when(changed, F.col("new")).otherwise(value)
        elif name == length_col:
            value = F.when(changed, F.length("new").cast(docs.schema[name].dataType)).otherwise(value)
        columns.append(value.alias(name))
    return rows.select(*columns)
