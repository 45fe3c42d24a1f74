"""Near-duplicate documents by min-max hashing.

Every permutation of the shingles gives two signature values, its minimum and its maximum. Both are the same in two sets
with a probability of their Jaccard similarity, so a signature of ``2 * permutations`` values costs half of the usual
hash evaluations, and as the two are not independent its mean varies less. The values are cut into bands; sets that agree
on a band are candidates, and links are confirmed on full shingle sets.

A class of n near copies does not need its n * n pairs. First every set is compared with one set of its bucket, the hub;
this joins dense groups by n comparisons. Only buckets that then still hold several classes are compared further, their
sets outside the largest class with all others, by signature first. So nothing is left out: two sets that share a bucket
are of one class, or their signatures are too far apart, or they were compared in full.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmine.llm.common import as_bytes, pieces, word_lists
from shelfmine.llm.components import components
from shelfmine.llm.shingles import WordHashes, shingle_hashes
from shelfmine.session import cut_lineage, drop_steps

WORDS = 4
SIMILARITY_PERCENT = 80
# a pair at 80 % misses all bands with a chance of (1 - 0.8 ** 4) ** 24, below 4 in a million
PERMUTATIONS = 48
BAND = 4
# asked sets of a cell, and others that they are compared with
MEMBERS = 256
OTHERS = 2_048
# a key is hot if it has more than one in so many of all rows; there are at most so many hot ones
HOT_SHARE = 4_096
SALTS = 64

_SEEDS = np.random.default_rng(12).integers(1, 2**63, size=(2, 1024), dtype=np.uint64) | np.uint64(1)


def signatures(values: np.ndarray, bounds: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """Minimum and maximum of each set under every permutation, as 32-bit values; sets need an element each.

    Minima come in blocks of ``BAND`` permutations, each followed by the maxima of the same ones, so no band holds both
    values of one permutation.
    """
    out = np.empty((len(bounds) - 1, permutations // BAND, 2, BAND), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for i in range(permutations):
            hashed = ((values ^ _SEEDS[1, i]) * _SEEDS[0, i]) >> np.uint64(32)
            out[:, i // BAND, 0, i % BAND] = np.minimum.reduceat(hashed, bounds[:-1])
            out[:, i // BAND, 1, i % BAND] = np.maximum.reduceat(hashed, bounds[:-1])
    return out.reshape(len(out), -1)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each set and band; keys of different bands differ."""
    bands = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), -1, BAND // 2)
    key = np.arange(bands.shape[1], dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for i in range(bands.shape[2]):
            key = (key ^ bands[:, :, i]) * np.uint64(0xBF58476D1CE4E5B9)
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            key ^= key >> np.uint64(32)
    return key.view(np.int64)


def least_agreement(percent: int, size: int) -> int:
    """Places of two signatures that must agree: five standard deviations of independent places below the threshold."""
    p = percent / 100
    return max(1, math.floor(size * p - 5 * math.sqrt(size * p * (1 - p))))


def lowered(texts: list[bytes]) -> list[bytes]:
    return [t.lower() for t in texts]  # bytes have A-Z only


def signed(docs: DataFrame, id_col: str, text_col: str, words: int, permutations: int) -> DataFrame:
    """``(doc_id, content, n_shingles, signature)``; equal word sequences have equal 128-bit contents, and texts without
    words have neither content nor signature."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            done = 0
            for piece in pieces(as_bytes(batch.column(1))):
                lists = word_lists(lowered(piece))
                values, bounds = shingle_hashes(lists, hashes, words)
                full = np.flatnonzero(np.diff(bounds))
                content: list[bytes | None] = [None] * len(piece)
                made: list[bytes | None] = [None] * len(piece)
                if len(full):
                    for i, s in zip(full, signatures(values, np.r_[bounds[full], bounds[-1]], permutations)):
                        made[i] = s.tobytes()
                        content[i] = xxhash.xxh3_128_digest(b" ".join(lists[i]))
                sizes = [len(np.unique(values[a:b])) for a, b in zip(bounds, bounds[1:])]
                ids = batch.column(0).slice(done, len(piece))
                done += len(piece)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(content, pa.binary()), pa.array(sizes, pa.int64()), pa.array(made, pa.binary())],
                    names=["doc_id", "content", "n_shingles", "signature"],
                )

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(sign, "doc_id bigint, content binary, n_shingles bigint, signature binary")


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(n, -1)


def bucket_rows(nodes: DataFrame) -> DataFrame:
    """``(key, node)`` of every band of every set."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = band_keys(_matrix(batch.column(1), batch.num_rows))
            node = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(node)], names=["key", "node"])

    return nodes.select("node", "signature").mapInArrow(keyed, "key bigint, node bigint")


def with_facts(rows: DataFrame, facts: DataFrame, total: int, key: str, salt_on: str, how: str = "inner") -> DataFrame:
    """``rows`` with the facts of their keys; ``facts`` has a row per key with its number of rows ``n``.

    Rows of hot keys spread over ``SALTS`` tasks. As a hot key holds more than a ``HOT_SHARE``-th of ``total`` rows, the
    broadcast list of hot keys has at most ``HOT_SHARE`` entries.
    """
    is_hot = F.col("n") * HOT_SHARE > total
    hot = facts.where(is_hot).select(key, F.lit(True).alias("hot"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(salt_on), F.lit(SALTS)).cast("int")).otherwise(0)
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = facts.withColumn("salt", F.explode(every))
    marked = rows.join(F.broadcast(hot), key, "left").withColumn("salt", salt).drop("hot")
    return marked.join(salted, [key, "salt"], how).drop("salt")


def sets_of(texts: list[bytes], hashes: WordHashes, words: int) -> list[np.ndarray]:
    values, bounds = shingle_hashes(word_lists(lowered(texts)), hashes, words)
    return [np.unique(values[a:b]) for a, b in zip(bounds, bounds[1:])]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough, in whole numbers."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    common = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
    return 100 * common >= percent * (len(a) + len(b) - common)


def runs_by(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Parts of batches with one value of a column that rows are sorted by, and whether the value is new."""
    last = None
    for batch in batches:
        values = batch.column(name).to_numpy()
        if len(values) == 0:
            continue
        edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1), len(values)]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a), values[a] != last
            last = values[a]


def hub_pairs(pairs: DataFrame, payload: DataFrame, prepare: Callable, good: Callable) -> DataFrame:
    """The pairs ``(node, hub)`` whose payloads are good together. The partners of a hub stream past its own payload,
    which comes first; a hub with more than a ``HOT_SHARE``-th of all pairs has a copy in each of ``SALTS`` groups."""
    sizes = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n"))
    total = pairs.count()
    hot = cut_lineage(sizes.where(F.col("n") * HOT_SHARE > total).select("hub", F.lit(SALTS).alias("groups")), "hot-hubs")
    grouped = lambda df: df.join(F.broadcast(hot), "hub", "left").withColumn("groups", F.coalesce("groups", F.lit(1)))
    hubs = grouped(pairs.select("hub").distinct()).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    placed = grouped(pairs).withColumn("part", F.pmod(F.xxhash64("node"), F.col("groups")).cast("int"))
    rows = hubs.select("hub", F.col("hub").alias("node"), "part").unionByName(placed.select("hub", "node", "part"))
    rows = rows.join(payload.hint("merge"), "node")
    rows = rows.select("hub", "part", (F.col("hub") != F.col("node")).alias("member"), "node", payload.columns[1])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, hub, own = prepare(), None, None
        for batch in batches:
            for start in range(0, batch.num_rows, MEMBERS):
                part = batch.slice(start, MEMBERS)
                node, owner = part.column("node").to_numpy(), part.column("hub").to_numpy()
                found = []
                for i, x in enumerate(ready(part.column(4))):
                    if node[i] == owner[i]:
                        hub, own = owner[i], x
                    elif owner[i] == hub and good(own, x):
                        found.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(node[found]), pa.array(owner[found])], names=["node", "hub"])

    ordered = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "member")
    return ordered.mapInArrow(compare, "node bigint, hub bigint")


def hub_links(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, percent: int, least: int) -> DataFrame:
    """The pairs ``(node, hub)`` that are linked: of those whose signatures agree well enough, by their full sets."""

    def read_signatures() -> Callable:
        return lambda column: _matrix(column, len(column)) if len(column) else []

    def read_sets() -> Callable:
        hashes = WordHashes()
        return lambda column: sets_of(as_bytes(column), hashes, words)

    near = hub_pairs(pairs, nodes.select("node", "signature"), read_signatures, lambda a, b: (a == b).sum() >= least)
    near = cut_lineage(near, "near")
    links = cut_lineage(hub_pairs(near, texts, read_sets, lambda a, b: linked(a, b, percent)), "links")
    drop_steps(near)
    return links


class Cell:
    """Sets of one bucket; the asked ones are compared with the others that are of another class."""

    def __init__(self, rows: pa.RecordBatch) -> None:
        flag = lambda name: rows.column(name).to_numpy(zero_copy_only=False)
        self.node, self.label = rows.column("node").to_numpy(), rows.column("label").to_numpy()
        self.asked, self.other, self.outside = np.flatnonzero(flag("asked")), flag("other"), flag("outside")
        self.signature = _matrix(rows.column("signature"), rows.num_rows)
        self.keys = band_keys(self.signature)
        self.band = int(np.flatnonzero(self.keys[0] == rows.column("key").to_numpy()[0])[0])

    def alike(self, least: int) -> Iterator[tuple[int, int]]:
        """Pairs of different classes with signatures that agree well enough, in the first bucket that holds both. Two
        sets that are both outside the largest class ask each other; the one of the smaller number does so here."""
        for i in self.asked.tolist():
            j = np.flatnonzero(self.other & (self.label != self.label[i]) & ~(self.outside & (self.node <= self.node[i])))
            j = j[(self.signature[j] == self.signature[i]).sum(1) >= least]
            j = j[~(self.keys[j, : self.band] == self.keys[i, : self.band]).any(1)]
            for x in j.tolist():
                yield i, x


def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for part, new in runs_by(batches, "cell"):
        if new and held:
            yield pa.concat_batches(held)
            held = []
        held.append(part)
    if held:
        yield pa.concat_batches(held)


def mixed_links(
    shared: DataFrame, labels: DataFrame, nodes: DataFrame, texts: DataFrame, total: int, words: int, percent: int, least: int
) -> DataFrame:
    """``(a, b)``: links between classes that buckets of several classes hold; the hubs have met all sets already.

    In such a bucket all sets outside its largest class are asked. A cell has about ``MEMBERS`` of them, and ``OTHERS`` of
    all. Cells are looked through by signature, and only sets with a partner bring their texts.
    """
    rows = shared.where("node <> hub").select("key", "node").join(labels, "node", "left")
    rows = cut_lineage(rows.withColumn("label", F.coalesce("label", "node")), "labelled")
    per_class = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("held"))
    facts = per_class.groupBy("key").agg(
        F.max_by("label", F.struct("held", "label")).alias("main"), F.max("held").alias("most"), F.sum("held").alias("n")
    )
    placed = with_facts(rows, facts.where("n > most"), total, "key", "node").select(
        "key",
        "node",
        "label",
        (F.col("label") != F.col("main")).alias("outside"),
        F.ceil((F.col("n") - F.col("most")) / F.lit(MEMBERS)).cast("int").alias("down"),
        F.ceil(F.col("n") / F.lit(OTHERS)).cast("int").alias("across"),
    )
    one = lambda parts, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    flags = lambda df, asked: df.withColumns({"asked": F.lit(asked), "other": F.lit(not asked)})
    # an asked set stands in every column of its row of cells, the others in one column of every row
    asked = flags(placed.where("outside").withColumn("row", one("down", 1)).withColumn("column", each("across")), True)
    other = flags(placed.withColumn("column", one("across", 2)).withColumn("row", each("down")), False)
    cell = F.xxhash64("key", "row", "column")
    both = asked.unionByName(other).groupBy(cell.alias("cell"), "key", "node", "label", "outside")
    joined = both.agg(F.max("asked").alias("asked"), F.max("other").alias("other")).join(nodes.select("node", "signature"), "node")

    def need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in cells_of(batches):
            wanted = np.unique([x for pair in Cell(cell).alike(least) for x in pair]).astype(np.int64)
            if len(wanted):
                yield cell.take(pa.array(wanted))

    kinds = "cell bigint, key bigint, node bigint, label bigint, outside boolean, asked boolean, other boolean, signature binary"
    names = [k.split()[0] for k in kinds.split(", ")]
    by_cell = lambda df: df.repartition("cell", "key").sortWithinPartitions("cell", "key", "node")
    needed = cut_lineage(by_cell(joined.select(*names)).mapInArrow(need, kinds), "needed")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in cells_of(batches):
            cell, sets = Cell(batch), sets_of(as_bytes(batch.column("text")), hashes, words)
            root: dict[int, int] = {}

            def top(x: int) -> int:
                while (up := root.get(x, x)) != x:
                    x = up
                return x

            found = []
            for i, j in cell.alike(least):
                a, b = top(cell.label[i]), top(cell.label[j])
                if a != b and linked(sets[i], sets[j], percent):
                    root[a] = b
                    found.append((i, j))
            if found:
                i, j = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(cell.node[i]), pa.array(cell.node[j])], names=["a", "b"])

    links = by_cell(needed.join(texts.hint("merge"), "node").select(*names, "text")).mapInArrow(verify, "a bigint, b bigint")
    links = cut_lineage(links, "more-links")
    drop_steps(rows, needed)
    return links


def classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    percent: int = SIMILARITY_PERCENT,
    permutations: int = PERMUTATIONS,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per input row.

    Texts are linked if ``100 * common >= percent * union`` of their shingle sets; a component is what links reach, and
    its id is the smallest id in it. Texts without words (null, empty) have an empty set, no links, and their own id as
    component. Copies and rows that repeat an id are rows of their own in one component. A null id counts only where no
    row of the component has another; the component id is null then. ``kept`` marks the rows whose id is the component's,
    so rows that repeat it are all kept. An empty table gives an empty result; other columns are not read.
    """
    rows = cut_lineage(signed(docs, id_col, text_col, words, permutations), "signed")
    distinct = rows.where("content is not null").groupBy("content").agg(
        F.min("doc_id").alias("first"), F.max("signature").alias("signature"), F.count(F.lit(1)).alias("n")
    )
    # numbers are written with the rows, so that every later read sees the same ones
    nodes = cut_lineage(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")
    least = least_agreement(percent, 2 * permutations)
    every = bucket_rows(nodes)
    facts = every.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    facts = cut_lineage(facts, "buckets")
    total = facts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = cut_lineage(with_facts(every, facts, total, "key", "node").select("key", "node", "hub"), "shared")

    # one text of each set that shares a bucket: a row of its content's first id
    wanted = shared.select("node").distinct().join(nodes.select("node", "content", "first"), "node")
    texts = cut_lineage(texts_of(docs, id_col, text_col, wanted), "texts")
    pairs = cut_lineage(shared.where("node <> hub").select("node", "hub").distinct(), "pairs")
    near = hub_links(pairs, nodes, texts, words, percent, least).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    labels = cut_lineage(components(near).select(F.col("id").alias("node"), F.col("root").alias("label")), "labels")
    more = mixed_links(shared, labels, nodes, texts, total, words, percent, least)
    found = components(near.unionByName(more)).select(F.col("id").alias("node"), "root")
    of = nodes.select("content", "node", "first", "n").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = of.join(of.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("content", "n", "component_id")
    copies = named.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    plain = rows.drop("signature")
    columns = ["doc_id", "n_shingles", "component_id"]
    out = with_facts(plain.where("content is not null"), named, copies, "content", "doc_id").select(columns)
    empty = plain.where("content is null").withColumn("component_id", F.col("doc_id")).select(columns)
    out = cut_lineage(out.unionByName(empty), "components")
    drop_steps(rows, nodes, facts, shared, texts, pairs, labels)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def texts_of(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """``(node, text)`` for rows ``(node, content, first)``: a text of this content from a row of this id."""

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [xxhash.xxh3_128_digest(b" ".join(w)) if w else None for w in word_lists(lowered(as_bytes(batch.column(1))))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()), batch.column(1)], names=["own", "held", "text"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    # ids are looked up before texts are read into words; a null id meets the contents that only null ids have
    ids = wanted.select(F.col("first").alias("asked")).distinct()
    rows = rows.join(ids.hint("merge"), F.col("doc_id").eqNullSafe(F.col("asked")), "left_semi")
    held = rows.mapInArrow(contents, "own bigint, held binary, text string")
    same = F.col("own").eqNullSafe(F.col("first")) & (F.col("held") == F.col("content"))
    return held.join(wanted.hint("merge"), same).select("node", "text").dropDuplicates(["node"])
