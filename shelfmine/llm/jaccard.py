"""Similarity join of texts by the Jaccard similarity of their word shingles, by chosen paths.

Every run splits the texts recursively on tokens that they share: at each node of a run's tree a place of the min-hash
sketch is chosen by the node's path, and texts with the same sampled token there go on together. Small buckets, and
buckets that a split leaves mostly whole, are compared in full, by sketches first and by their shingles then. Runs are
repeated, for the texts that need them, until a pair at the threshold is missed with a chance below ``1 - RECALL``: the
chance that a run brings a text's pair together follows from the depth at which the text ends in it.

A pair is counted in the first run that brings it together, which both texts know from their own paths. So no list of
pairs is formed: a cell returns the number of links of each of its texts and the edges of a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmine.llm.common import PIECE_BYTES, as_bytes, byte_pieces, mixed, word_lists
from shelfmine.llm.components import components
from shelfmine.llm.shingles import SIMILARITY, WORDS, WordHashes, shingle_hashes
from shelfmine.session import cut_lineage, drop_steps

SKETCH = 64
DEPTH = 5
# texts of a bucket that is compared in full, and of a block of a larger one
BUCKET = 256
RECALL = 0.9999
# bytes of texts that a task signs at once
HELD = PIECE_BYTES // 4
# runs that are added at a time
MORE_RUNS = 4
# a bucket with a child of this share is dense: its texts are alike, further splits would only lose pairs
DENSE = 0.5


def runs_for(similarity: float, recall: float) -> int:
    """Runs after which a pair at the threshold that is compared one split below the root is found with ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity)) + 2)


def least_agreement(similarity: float, size: int = SKETCH) -> int:
    """Places of the sketch that must agree: four standard deviations below the mean at the threshold."""
    return max(1, math.floor(size * similarity - 4 * math.sqrt(size * similarity * (1 - similarity))))


_SEEDS = np.random.default_rng(3).integers(1, 2**63, size=(2, 256), dtype=np.uint64) | np.uint64(1)


def sketches(values: np.ndarray, bounds: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """Min-hash sketch of each text, as 32-bit values; texts need a shingle each."""
    out = np.empty((len(bounds) - 1, size), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for i in range(size):
            hashed = ((values ^ _SEEDS[1, i]) * _SEEDS[0, i]) >> np.uint64(32)
            out[:, i] = np.minimum.reduceat(hashed, bounds[:-1])
    return out


def signed(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``(doc_id, node, sketch)``; the node is the 64-bit hash of the text, the sketch is null without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            done = 0
            for piece in byte_pieces(batch.column(2), HELD):
                values, bounds = shingle_hashes(word_lists(piece), hashes, words)
                full = np.flatnonzero(np.diff(bounds))
                made: list[bytes | None] = [None] * len(piece)
                if len(full):
                    for i, s in zip(full, sketches(values, np.r_[bounds[full], bounds[-1]])):
                        made[i] = s.tobytes()
                ids = batch.slice(done, len(piece))
                done += len(piece)
                yield pa.RecordBatch.from_arrays(
                    [ids.column(0), ids.column(1), pa.array(made, pa.binary())], names=["doc_id", "node", "sketch"]
                )

    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("node"), text.alias("text"))
    return rows.mapInArrow(sign, "doc_id bigint, node bigint, sketch binary")


def paths_of(sketch: np.ndarray, run: int, depth: int) -> np.ndarray:
    """Path of each text at each depth of a run's tree. The chosen place of the sketch depends on the path alone."""
    path = np.full(len(sketch), run, dtype=np.uint64)
    out = np.empty((len(sketch), depth), dtype=np.int64)
    rows = np.arange(len(sketch))
    for d in range(depth):
        node = mixed(path, seed=d + 1)
        chosen = (node % np.uint64(sketch.shape[1])).astype(np.int64)
        path = mixed(node ^ sketch[rows, chosen].astype(np.uint64), seed=17)
        out[:, d] = path.view(np.int64)
    return out


def paths(nodes: DataFrame, runs: range, depth: int) -> DataFrame:
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            sketch = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(batch.num_rows, -1)
            for run in runs:
                path = paths_of(sketch, run, depth)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(np.full(len(path), run, dtype=np.int32)),
                        pa.array(list(path), pa.list_(pa.int64())),
                    ],
                    names=["node", "run", "paths"],
                )

    return nodes.select("node", "sketch").mapInArrow(walk, "node bigint, run int, paths array<bigint>")


def buckets(rest: DataFrame, depth: int, bucket: int, dense: float) -> tuple[DataFrame, list[DataFrame]]:
    """``(node, run, bucket, n)``: the bucket in which each text ends in each run, where it has company there; and the
    tables that this reads."""
    ended, splits = [], []
    for d in range(depth):
        here = rest.withColumns({"bucket": F.col("paths")[d], "child": F.col("paths")[min(d + 1, depth - 1)]})
        children = here.groupBy("bucket", "child").agg(F.count(F.lit(1)).alias("n"))
        sizes = children.groupBy("bucket").agg(F.sum("n").alias("n"), F.max("n").alias("most")).where("n > 1")
        met = here.join(sizes, "bucket")
        stop = (F.col("n") <= bucket) | (F.col("most") >= dense * F.col("n")) | F.lit(d == depth - 1)
        split = cut_lineage(met.withColumn("stop", stop).drop("child"), "split")
        splits.append(split)
        ended.append(split.where("stop").select("node", "run", "bucket", "n"))
        rest = split.where(~F.col("stop")).select("node", "run", "paths")
        if d == depth - 1 or rest.isEmpty():
            break
    out = ended[0]
    for more in ended[1:]:
        out = out.unionByName(more)
    return out, splits


def log_misses(splits: list[DataFrame], similarity: float) -> DataFrame:
    """``(node, more)`` of the texts that do not end at the first split in every run: by how much the logarithm of the
    chance that a pair at the threshold is missed lies above that of a text that does. A text that a split leaves alone
    ends there."""
    depths = None
    for d, split in enumerate(splits):
        here = split.select("node", "run", F.when(F.col("stop"), d).otherwise(d + 1).alias("depth"))
        depths = here if depths is None else depths.unionByName(here)
    ends = depths.where("depth > 0").groupBy("node", "run").agg(F.max("depth").alias("depth"))
    miss = F.log1p(-F.pow(F.lit(float(similarity)), F.col("depth") + 1))
    return ends.groupBy("node").agg(F.sum(miss - F.log1p(F.lit(-float(similarity)))).alias("more"))


def all_ends(nodes: DataFrame, similarity: float, recall: float, bucket: int) -> tuple[list[DataFrame], int]:
    """Tables ``(node, run, bucket, n)`` of the runs, and the number of runs. Further runs are made of the texts whose
    chance of a miss, from their own depths, is still too large; a pair needs them only if both of its texts do."""
    tables, runs, more = [], 0, runs_for(similarity, recall)
    need, steps = nodes.select("node", "sketch", F.lit(0.0).alias("miss")), []
    if similarity >= 1:  # texts at the threshold are together at every depth
        recall = 0.0
    while more:
        walked = cut_lineage(paths(need, range(runs, runs + more), DEPTH), "paths")
        found, splits = buckets(walked, DEPTH, bucket, DENSE)
        tables.append(cut_lineage(found, "buckets"))
        runs += more
        if recall <= 0:
            drop_steps(walked, *splits, *steps)
            break
        miss = F.col("miss") + F.lit(more * math.log(1 - similarity)) + F.coalesce("more", F.lit(0.0))
        left = need.join(log_misses(splits, similarity), "node", "left").withColumn("miss", miss).drop("more")
        left = cut_lineage(left.where(F.col("miss") > math.log(1 - recall)), "need")
        drop_steps(walked, *splits, *steps)
        need, steps, more = left, [left], 0 if left.isEmpty() else MORE_RUNS
    else:
        drop_steps(*steps)
    return tables, runs


def cells(ended: DataFrame, bucket: int) -> DataFrame:
    """``(node, run, bucket, block, cell)``: a bucket of several blocks has a cell for each pair of them."""
    blocks = F.ceil(F.col("n") / F.lit(bucket)).cast("int")
    placed = ended.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int"))
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.xxhash64("bucket", "run", F.least("block", "other"), F.greatest("block", "other"))
    return other.select("node", "run", "block", cell.alias("cell"))


class Group:
    """Texts of a cell: those of one block are compared with each other, those of two with the other block."""

    def __init__(self, run: int, block: np.ndarray, sketch: np.ndarray, ends: np.ndarray) -> None:
        self.run, self.block, self.sketch, self.ends = run, block, sketch, ends

    def alike(self, least: int) -> np.ndarray:
        """Pairs (i < j) that belong to this cell and whose sketches agree well enough."""
        n = len(self.block)
        found = []
        two = len(np.unique(self.block)) > 1
        for a in range(0, n, 64):
            part = slice(a, min(a + 64, n))
            agree = np.zeros((part.stop - a, n), dtype=np.int32)
            for s in range(self.sketch.shape[1]):
                agree += self.sketch[part, s, None] == self.sketch[None, :, s]
            good = (agree >= least) & (np.arange(a, part.stop)[:, None] < np.arange(n)[None, :])
            if two:
                good &= self.block[part, None] != self.block[None, :]
            i, j = np.nonzero(good)
            i = i + a
            # the first run in which both end in the same bucket
            same = (self.ends[i] == self.ends[j]) & (self.ends[i] != 0)
            own = same[:, self.run] & (same.argmax(1) == self.run)
            found.append(np.c_[i[own], j[own]])
        return np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``cell``, one batch for each cell."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        cell = batch.column("cell").to_numpy()
        edges = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1), len(cell)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if held and held[0].column("cell")[0].as_py() != cell[a]:
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.concat_batches(held)


def _group(rows: pa.RecordBatch, runs: int) -> Group:
    n = rows.num_rows
    sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), dtype=np.uint32).reshape(n, -1)
    ends = rows.column("ends").flatten().to_numpy().reshape(n, runs)
    return Group(rows.column("run")[0].as_py(), rows.column("block").to_numpy(), sketch, ends)


def by_cell(rows: DataFrame) -> DataFrame:
    return rows.repartition("cell").sortWithinPartitions("cell")


def common_counts(sets: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each set the number of elements that it shares with every set, from lists of sets by element."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(place, kind="stable")
    lists = owner[order]
    first = np.searchsorted(place[order], np.arange(len(values) + 1))
    bounds = np.cumsum(np.r_[0, sizes])
    for i in range(len(sets)):
        own = place[bounds[i] : bounds[i + 1]]
        n = first[own + 1] - first[own]
        at = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        yield np.bincount(lists[at], minlength=len(sets))


def verified(pairs: np.ndarray, sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """The pairs whose sets are similar enough."""
    if len(pairs) == 0:
        return pairs
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(pairs[:, 0], kind="stable")
    pairs = pairs[order]
    edges = np.searchsorted(pairs[:, 0], np.arange(len(sets) + 1))
    keep = np.zeros(len(pairs), dtype=bool)
    for i, common in enumerate(common_counts(sets)):
        j = pairs[edges[i] : edges[i + 1], 1]
        # in whole numbers: common / union >= similarity
        keep[edges[i] : edges[i + 1]] = common[j] >= similarity * (sizes[i] + sizes[j] - common[j]) - 1e-9
    return pairs[keep]


def forest(n: int, pairs: np.ndarray) -> np.ndarray:
    """Smallest member of each one's component."""
    root = np.arange(n)
    while len(pairs):
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        before = root.copy()
        np.minimum.at(root, root[pairs[:, 0]], low)
        np.minimum.at(root, root[pairs[:, 1]], low)
        root = root[root]
        if (root == before).all():
            break
    return root


def links(
    docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, recall: float, bucket: int
) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, node, sketch)`` of all rows, and ``(node, root, links, copies)`` of nodes with links."""
    least = least_agreement(similarity)
    rows = cut_lineage(signed(docs, id_col, text_col, words), "signed")
    nodes = cut_lineage(
        rows.where(F.col("sketch").isNotNull())
        .groupBy("node")
        .agg(F.min("doc_id").alias("first"), F.max("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies")),
        "nodes",
    )
    tables, runs = all_ends(nodes, similarity, recall, bucket)
    ended = reduce(DataFrame.unionByName, tables)
    at_runs = F.map_from_entries(F.collect_list(F.struct("run", "bucket")))
    ends = F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.coalesce(F.col("at")[r], F.lit(0).cast("long")))
    known = ended.groupBy("node").agg(at_runs.alias("at")).select("node", ends.alias("ends")).join(nodes, "node")
    placed = cells(ended, bucket).join(known, "node")

    def need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in grouped(batches):
            wanted = np.unique(_group(cell, runs).alike(least)) if cell.num_rows > 1 else []
            if len(wanted):
                yield cell.take(pa.array(wanted))

    kinds = "cell bigint, run int, block int, node bigint, first bigint, copies bigint, sketch binary, ends array<bigint>"
    columns = [k.split()[0] for k in kinds.split(", ")]
    needed = cut_lineage(by_cell(placed.select(*columns)).mapInArrow(need, kinds), "needed")
    drop_steps(*tables, nodes)

    text = F.coalesce(docs[text_col], F.lit(""))
    texts = docs.select(docs[id_col].cast("long").alias("own"), F.xxhash64(text).alias("key"), text.alias("text"))
    wanted = needed.select("node", "first").distinct()
    # one text of each node, from the row of its smallest id; rows that repeat id and text are one. A merge join at any
    # size: the wanted nodes grow with the corpus
    texts = texts.join(wanted.hint("merge"), (F.col("key") == F.col("node")) & F.col("own").eqNullSafe(F.col("first")))
    texts = cut_lineage(texts.select("node", "text").dropDuplicates(["node"]), "texts")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for cell in grouped(batches):
            group = _group(cell, runs)
            values, bounds = shingle_hashes(word_lists(as_bytes(cell.column("text"))), hashes, words)
            sets = [np.unique(values[a:b]) for a, b in zip(bounds, bounds[1:])]
            pairs = verified(group.alike(least), sets, similarity)
            if len(pairs) == 0:
                continue
            node, copies = cell.column("node").to_numpy(), cell.column("copies").to_numpy()
            i, j = pairs.T
            n = len(node)
            weight = np.bincount(i, copies[j], minlength=n) + np.bincount(j, copies[i], minlength=n)
            linked = np.flatnonzero(weight)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(node[linked]),
                    pa.array(node[forest(n, pairs)][linked]),
                    pa.array(weight[linked].astype(np.int64)),
                ],
                names=["node", "root", "links"],
            )

    found = by_cell(needed.join(texts, "node").select(*columns, "text")).mapInArrow(verify, "node bigint, root bigint, links bigint")
    found = cut_lineage(found, "links")
    drop_steps(needed, texts)
    return rows, found


def classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    bucket: int = BUCKET,
) -> DataFrame:
    """``(doc_id, node, has_words, class_node, n_links)``, one row per input row.

    Texts with the same ``class_node`` are joined by a chain of links; ``n_links`` counts the other rows, copies
    included, whose similarity to this one is at least the threshold. Texts without words (null, empty) have no
    shingles and no links. Rows that repeat an id and a text are rows of their own and copies of each other; a null id
    is an id like others. An empty table gives an empty result; other columns are not read.
    """
    rows, found = links(docs, id_col, text_col, words, similarity, recall, bucket)
    roots = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    copies = rows.where(F.col("sketch").isNotNull()).groupBy("node").agg((F.count(F.lit(1)) - 1).alias("copies"))
    facts = copies.join(counted, "node", "left").join(roots.withColumnRenamed("id", "node"), "node", "left")
    facts = facts.select(
        "node",
        F.coalesce("root", "node").alias("class_node"),
        (F.col("copies") + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    has = F.col("sketch").isNotNull()
    return rows.select("doc_id", "node", has.alias("has_words")).join(facts, "node", "left").select(
        "doc_id",
        "node",
        "has_words",
        F.when(F.col("has_words"), F.col("class_node")).alias("class_node"),
        F.when(F.col("has_words"), F.col("n_links")).otherwise(0).alias("n_links"),
    )


def join_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(doc_id, class_id, n_links)``, one row per input row. The class id is the smallest id of the class; a text
    without words is a class of its own."""
    found = cut_lineage(classes(docs, id_col, text_col, **options), "classes")
    first = found.where("has_words").groupBy("class_node").agg(F.min("doc_id").alias("class_id"))
    return found.join(first, "class_node", "left").select(
        "doc_id", F.when(F.col("has_words"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), "n_links"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, without near-duplicates: each class keeps the row of its smallest
    id (nulls last). Of rows that repeat id and text one stays; rows without words all stay."""
    found = cut_lineage(classes(docs, id_col, text_col, **options), "classes")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")
    kept = found.where("has_words").groupBy("class_node").agg(F.min(order).alias("k"), F.count(F.lit(1)).alias("n"))
    times = found.where("has_words").groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("times"))
    kept = kept.select(F.col("k.doc_id").alias("own"), F.col("k.node").alias("key"))
    kept = kept.join(times, F.col("own").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("node"))).select("own", "key", "times")
    text = F.coalesce(docs[text_col], F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("node"), text.rlike(r"[^\x20\x09-\x0D]").alias("words"))
    stay = rows.where("words").join(kept.hint("merge"), F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("node") == F.col("key")))
    once = stay.where("times = 1").select("row")
    several = stay.where("times > 1").dropDuplicates(["doc_id", "node"]).select("row")
    return once.unionByName(several).unionByName(rows.where("not words").select("row")).select("row.*")
