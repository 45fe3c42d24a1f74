"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Labelled examples are a bounded sample; every document is scored against all of them. Terms are chosen on that sample
by their association with the label, so a vector holds few terms and the index stays small enough for every task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmine.llm.common import as_bytes, fold
from shelfmine.session import cut_lineage

FOLDS = 5
# bound of the labelled sample: rows of each label, those with the smallest hash of their id
EXAMPLES_PER_LABEL = 3_000
# bound of the vocabulary and least association (log-likelihood ratio, 1 degree of freedom) of a term with the label
TERMS = 1_024
LEAST_ASSOCIATION = 25.0
NEIGHBOURS = 15
BLOCK = 64
# bytes of the word starts that are terms besides whole words
STARTS = (4, 6)

# words are runs of letters and digits; bytes above 127 belong to letters
_SEPARATE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes) -> Counter:
    """Words with their counts, and the starts of longer words: inflected forms of a word share their start."""
    words = Counter(text.lower().translate(_SEPARATE).split())
    starts: Counter = Counter()
    for word, n in words.items():
        for size in STARTS:
            if len(word) > size:
                starts[b"^" + word[:size]] += n
    words.update(starts)
    return words


@dataclass
class Index:
    """Unit TF-IDF vectors of the examples, by term, with the largest weight of each term in each block of examples."""

    terms: dict[bytes, int]
    idf: np.ndarray
    examples: np.ndarray  # postings by term, then example
    values: np.ndarray
    segments: np.ndarray  # terms x (blocks + 1): where the postings of a term in a block start
    block_max: np.ndarray  # terms x blocks
    labels: np.ndarray
    weights: np.ndarray  # of the examples' votes, so that both labels count as often as among all labelled rows
    ids: np.ndarray
    prior: float
    slope: float = 1.0
    shift: float = 0.0

    def vector(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        counts = {self.terms[t]: n for t, n in terms_of(text).items() if t in self.terms}
        at = np.array(sorted(counts), dtype=np.int64)
        weights = np.array([1 + math.log(counts[t]) for t in at]) * self.idf[at]
        return at, weights / (np.sqrt((weights**2).sum()) or 1.0)

    def nearest(self, at: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Exact best ``k`` examples with a cosine above 0; ties go to the earlier example.

        Blocks are taken by falling upper bound, some at a time, until the next bound lies below the k-th best cosine.
        """
        found, scores = np.zeros(0, dtype=np.int64), np.zeros(0)
        if len(at) == 0:
            return found, scores
        bounds = weights @ self.block_max[at]
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        done, step = 0, 8
        while done < len(order):
            if len(found) >= k and bounds[order[done]] < scores[k - 1] - 1e-12:
                break
            blocks = order[done : done + step]
            done, step = done + step, 2 * step
            first, last = self.segments[at][:, blocks].ravel(), self.segments[at][:, blocks + 1].ravel()
            size = last - first
            flat = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
            local = np.repeat(np.tile(np.arange(len(blocks)) * BLOCK, len(at)), size) + self.examples[flat] % BLOCK
            product = np.repeat(np.repeat(weights, len(blocks)), size) * self.values[flat]
            score = np.bincount(local, product, minlength=len(blocks) * BLOCK)
            own = np.flatnonzero(score > 0)
            example = blocks[own // BLOCK] * BLOCK + own % BLOCK
            other = example != without
            found, scores = np.r_[found, example[other]], np.r_[scores, score[own][other]]
            best = np.lexsort((found, -scores.round(12)))[:k]
            found, scores = found[best], scores[best]
        return found, scores

    def vote(self, found: np.ndarray, scores: np.ndarray) -> float:
        """Log odds of label 1: votes weighted by closeness, smoothed by the share of label 1."""
        votes = scores * self.weights[found]
        toxic = (votes * self.labels[found]).sum() + self.prior
        clean = (votes * (1 - self.labels[found])).sum() + 1 - self.prior
        return math.log(toxic / clean)

    def score(self, vote: float) -> float:
        return 1 / (1 + math.exp(-(self.slope * vote + self.shift)))


def sample_labels(labels: DataFrame, id_col: str, label_col: str, folds: int, per_label: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_label`` training rows of each label, with the count of all of them.

    An id with several labels counts with the largest; rows without id or label, or with other labels, are left out.
    """
    rows = (
        labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
        .where(fold(F.col("doc_id"), folds) != 0)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = 2**40
    rows = rows.withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(size)))
    # twice the share that is wanted: so many rows of the smallest hashes are there for sure, and few reach the sort
    part = lambda label: rows.where(
        (F.col("label") == label) & (F.col("place") <= size * (2 * per_label + 100) // max(totals.get(label, 0), 1))
    )
    parts = [part(label).orderBy("place", "doc_id").limit(per_label).drop("place") for label in (0, 1)]
    return parts[0].unionByName(parts[1]), totals


def association(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Log-likelihood ratio of the table (a of n1, b of n0), positive where the term goes with label 1."""

    def part(x, e):
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-300) / np.maximum(e, 1e-300)), 0.0)

    share1, n = n1 / (n1 + n0), a + b
    m = n1 + n0 - n
    value = 2 * (
        part(a, n * share1) + part(b, n * (1 - share1)) + part(n1 - a, m * share1) + part(n0 - b, m * (1 - share1))
    )
    return np.where(a * n0 > b * n1, value, -value)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    folds: int = FOLDS,
    per_label: int = EXAMPLES_PER_LABEL,
    terms: int = TERMS,
    neighbours: int = NEIGHBOURS,
) -> Index:
    """Index and calibration from labelled rows outside fold 0. Collects the bounded sample's chosen terms only."""
    chosen, totals = sample_labels(labels, id_col, label_col, folds, per_label)
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    # repeated rows of an id: one of the texts, the same one every time
    texts = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    # bounded by the sample: written once, read for the choice of terms and for the vectors
    texts = cut_lineage(texts.select(F.col("doc_id").cast("long"), F.col("label").cast("int"), "text"), "examples")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for label, text in zip(batch.column(1).to_pylist(), as_bytes(batch.column(2))):
                rows[label].update(terms_of(text).keys())
        terms = list(rows[0].keys() | rows[1].keys())
        for first in range(0, len(terms), 50_000):
            some = terms[first : first + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.binary()), *(pa.array([r[t] for t in some], pa.int64()) for r in (rows[1], rows[0]))],
                names=["term", "a", "b"],
            )

    heads = [(r["doc_id"], r["label"]) for r in texts.select("doc_id", "label").collect()]
    n1 = sum(label for _, label in heads)
    n0 = len(heads) - n1
    per_term = texts.mapInArrow(count, "term binary, a bigint, b bigint").groupBy("term").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b")
    )
    # terms of the largest difference between the labels; a term of fewer rows cannot be associated strongly enough
    difference = F.col("a") / max(n1, 1) - F.col("b") / max(n0, 1)
    table = per_term.where(F.col("a") >= 3).orderBy(difference.desc(), "term").limit(16 * terms).collect()
    a, b = (np.array([r[c] for r in table], dtype=float) for c in ("a", "b"))
    value = association(a, b, n1, n0) if n1 and n0 else np.zeros(len(a))
    order = [i for i in np.argsort(-value, kind="stable")[:terms] if value[i] >= LEAST_ASSOCIATION]
    names = [bytes(table[i]["term"]) for i in order]
    idf = np.log((1 + n1 + n0) / (1 + a[order] + b[order])) if order else np.zeros(0)
    place = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(names)})

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(2))):
                found = [(doc, place.value[t], n) for t, n in terms_of(text).items() if t in place.value]
                columns = zip(*found) if found else [()] * 3
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], names=["doc_id", "term", "n"]
                )

    hits = texts.mapInArrow(vectors, "doc_id bigint, term bigint, n bigint").collect()
    return build(names, idf, heads, hits, totals, neighbours)


def build(names, idf, heads, hits, totals, neighbours) -> Index:
    heads = sorted(heads)
    place = {doc: i for i, (doc, _) in enumerate(heads)}
    labels = np.array([y for _, y in heads], dtype=np.int64)
    at = np.array([r["term"] for r in hits], dtype=np.int64)
    row = np.array([place[r["doc_id"]] for r in hits], dtype=np.int64)
    tf = 1 + np.log(np.array([r["n"] for r in hits], dtype=float))
    weight = tf * idf[at] if len(at) else tf
    norm = np.sqrt(np.bincount(row, weight**2, minlength=len(heads))) if len(heads) else np.zeros(0)
    weight = weight / np.maximum(norm[row], 1e-300) if len(row) else weight
    order = np.lexsort((row, at))
    at, row, weight = at[order], row[order], weight[order]
    blocks = -(-max(len(heads), 1) // BLOCK)
    block_max = np.zeros((len(names), blocks))
    np.maximum.at(block_max, (at, row // BLOCK), weight)
    wanted = np.arange(len(names))[:, None] * (blocks + 1) + np.arange(blocks + 1)
    segments = np.searchsorted(at * (blocks + 1) + row // BLOCK, wanted)
    n = {y: max(int((labels == y).sum()), 1) for y in (0, 1)}
    share = totals.get(1, 0) / max(sum(totals.values()), 1)
    share = min(max(share, 1e-6), 1 - 1e-6)
    scale = sum(n.values())
    votes = np.where(labels == 1, share * scale / n[1], (1 - share) * scale / n[0]) if len(labels) else np.zeros(0)
    index = Index(
        {t: i for i, t in enumerate(names)},
        idf,
        row,
        weight,
        segments,
        block_max,
        labels,
        votes,
        np.array([d for d, _ in heads], dtype=np.int64),
        share,
    )
    calibrate(index, at, row, weight, neighbours)
    return index


def calibrate(index: Index, at: np.ndarray, row: np.ndarray, weight: np.ndarray, neighbours: int) -> None:
    """Logistic curve from the examples' own votes, each without itself, to their labels; Newton's method."""
    n = len(index.labels)
    if n == 0 or index.labels.min() == index.labels.max():
        return
    order = np.argsort(row, kind="stable")
    edges = np.searchsorted(row[order], np.arange(n + 1))
    votes = np.empty(n)
    for i in range(n):
        own = order[edges[i] : edges[i + 1]]
        own = own[np.argsort(at[own])]
        votes[i] = index.vote(*index.nearest(at[own], weight[own], neighbours, without=i))
    x = np.c_[votes, np.ones(n)]
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        # a small pull towards the plain vote keeps separable samples finite
        gradient = x.T @ (index.weights * (index.labels - p)) - 0.1 * (beta - [1.0, 0.0])
        hessian = (x * (index.weights * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    index.slope, index.shift = float(max(beta[0], 0.0)), float(beta[1])


SCORED = "score double, evidence array<struct<doc_id: bigint, cosine: double, label: int>>"


def scorer(index: Index, spark, neighbours: int = NEIGHBOURS):
    """Function from a text column to its score and the examples that it rests on."""
    shared = spark.sparkContext.broadcast(index)

    def score(column: pa.Array) -> pa.Array:
        index = shared.value
        known: dict = {}
        scores, evidence = [], []
        for text in as_bytes(column):
            at, weights = index.vector(text)
            key = (at.tobytes(), weights.tobytes())
            if key not in known:
                found, cosines = index.nearest(at, weights, neighbours)
                known[key] = (
                    index.score(index.vote(found, cosines)),
                    [
                        {"doc_id": int(index.ids[i]), "cosine": float(c), "label": int(index.labels[i])}
                        for i, c in zip(found, cosines)
                    ],
                )
            one, near = known[key]
            scores.append(one)
            evidence.append(near)
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
        return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(evidence, kind)], ["score", "evidence"])

    score.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(score, SCORED)


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(doc_id, held_out, score, predicted, evidence)``, one row per input row.

    Null and empty texts have no terms: they get the score of a text without neighbours. Repeated rows get equal
    scores; a null id belongs to the fold of the text "null". Without labels of both kinds every score is the share of
    label 1 (near 0 if there are none). Other columns are not read.
    """
    folds = options.get("folds", FOLDS)
    index = fit(docs, labels, id_col, text_col, **options)
    score = scorer(index, docs.sparkSession, options.get("neighbours", NEIGHBOURS))
    rows = docs.select(docs[id_col].alias("doc_id"), score(docs[text_col]).alias("s"))
    return rows.select(
        "doc_id",
        (fold(F.col("doc_id"), folds) == 0).alias("held_out"),
        F.col("s.score").alias("score"),
        (F.col("s.score") >= 0.5).cast("int").alias("predicted"),
        F.col("s.evidence").alias("evidence"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with a score below one half, with all their columns."""
    score = scorer(fit(docs, labels, id_col, text_col, **options), docs.sparkSession)
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), score(docs[text_col]).alias("s"))
    return rows.where(F.col("s.score") < 0.5).select("row.*")
