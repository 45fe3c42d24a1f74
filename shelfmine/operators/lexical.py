"""Inverted index and BM25.

Terms are counted inside each document row, so building postings needs no shuffle. Scoring keeps the terms of
a document together: the counted query terms go to every task, which adds up the scores of bounded stripes of chunks and keeps
the best of each query, so only these are exchanged and no list of pairs is made. ``bm25_scores`` makes that list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfmine.functions.arrays import run_lengths, spans
from shelfmine.functions.text import index_terms
from shelfmine.operators.lists import SCORE_DIGITS, BestLists
from shelfmine.operators.rows import unfolded
from shelfmine.operators.skew import fits_broadcast, join_small
from shelfmine.session import cut_lineage

K1 = 1.5
B = 0.75


@dataclass(frozen=True)
class LexicalIndex:
    """``lengths(chunk_id, slug, dl)``, ``postings(chunk_id, slug, dl, term, tf)``, ``term_stats(term, df, idf)``.

    ``tokens(chunk_id, slug, dl, runs)`` is the row-per-chunk form of a lazy index. ``term_stats`` is set for a
    stored index, whose postings are already partitioned by chunk (bucketed tables). ``totals`` holds the numbers of
    chunks and of tokens where they are known without counting.
    """

    lengths: DataFrame
    postings: DataFrame
    term_stats: DataFrame | None = None
    tokens: DataFrame | None = None
    totals: tuple[int, int] | None = None


def tokenised(chunks: DataFrame, id_col: str, text_col: str, slug_col: str | None, keep: tuple[str, ...] = ()) -> DataFrame:
    slug = F.col(slug_col) if slug_col else F.lit(None).cast("string")
    return chunks.select(
        F.col(id_col).alias("chunk_id"), slug.alias("slug"), index_terms(F.col(text_col)).alias("terms"), *keep
    )


def build_index(
    chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", slug_col: str | None = "slug", keep: tuple[str, ...] = ()
) -> LexicalIndex:
    """Lazy index over a chunk table; nothing runs until it is queried or written. ``tokens`` has the columns of ``keep`` too."""
    tokens = tokenised(chunks, id_col, text_col, slug_col, keep).select(
        "chunk_id", "slug", F.size("terms").alias("dl"), run_lengths(F.col("terms")).alias("runs"), *keep
    )
    return index_of_tokens(tokens)


def index_of_tokens(tokens: DataFrame) -> LexicalIndex:
    postings = unfolded(tokens, F.col("runs"), "term", "chunk_id", "slug", "dl")
    return LexicalIndex(lengths=tokens.select("chunk_id", "slug", "dl"), postings=postings, tokens=tokens)


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: number of chunks and their average length, 0 for an empty corpus."""
    return lengths.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl")
    )


def idf_of(n: Column, df: Column) -> Column:
    return F.log((n - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def document_frequency(postings: DataFrame) -> DataFrame:
    """Chunks per term; hot terms are combined before the shuffle."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def term_stats(index: LexicalIndex) -> DataFrame:
    if index.term_stats is not None:
        return index.term_stats
    n = corpus_stats(index.lengths).select("n").scalar()
    return document_frequency(index.postings).select("term", "df", idf_of(n, F.col("df")).alias("idf"))


# vocabularies up to this size are pushed to the reader of a stored index
PUSHED_TERMS = 1_000

# No token is empty, so the empty term can mark one row per chunk that carries its length.
LENGTH_MARK = ""


def _marked_postings(index: LexicalIndex) -> DataFrame:
    """Postings plus one length row per chunk, from a single pass over the texts of a lazy index."""
    if index.tokens is None:
        lengths = index.lengths.select("chunk_id", "slug", "dl", F.lit(LENGTH_MARK).alias("term"), F.lit(0).alias("tf"))
        return index.postings.select(*lengths.columns).unionByName(lengths)
    mark = F.array(F.struct(F.lit(LENGTH_MARK).alias("term"), F.lit(0).alias("tf")))
    runs = F.when(F.col("runs").isNull(), mark).otherwise(F.concat(mark, F.col("runs")))
    return unfolded(index.tokens, runs, "term", "chunk_id", "slug", "dl")


def query_terms(queries: DataFrame, text_col: str = "query") -> DataFrame:
    """``(qid, slug?, term, qtf)``; a repeated query term counts as often as it occurs."""
    keep = [c for c in ("qid", "slug") if c in queries.columns]
    runs = run_lengths(index_terms(F.col(text_col)), "term", "qtf")
    return unfolded(queries, runs, "term", *keep)


def term_weight(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return tf * F.lit(k1 + 1.0) / (tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * dl / avgdl))


def _pushed(postings: DataFrame, vocabulary: DataFrame, small: bool) -> DataFrame:
    """The postings behind a filter on the query terms that reaches the reader, if these are few.

    Stored postings are sorted by term inside their files, so page and row-group statistics skip what no query asks.
    """
    words = [r[0] for r in vocabulary.limit(PUSHED_TERMS + 1).collect()] if small else []
    return postings.where(F.col("term").isin(words)) if 0 < len(words) <= PUSHED_TERMS else postings


def bm25_scores(
    queries: DataFrame, index: LexicalIndex, text_col: str = "query", k1: float = K1, b: float = B
) -> DataFrame:
    """``(qid, slug, chunk_id, score)`` of every chunk that shares a term with the query.

    ``queries`` is ``(qid, query)``, optionally with ``slug``: a query with a slug only meets chunks of that
    slug, while document frequencies and the average length stay those of the whole corpus.
    """
    by_slug = "slug" in queries.columns
    terms = query_terms(queries, text_col)
    if by_slug:
        terms = terms.withColumnRenamed("slug", "only_slug")
    small = fits_broadcast(terms)
    vocabulary = terms.select("term").distinct()
    if index.term_stats is not None:
        if index.totals is None:
            corpus = corpus_stats(index.lengths).select(F.struct("n", "avgdl")).scalar()
        else:
            n, total = index.totals
            corpus = F.struct(F.lit(n).alias("n"), F.lit(total / n if n else 0.0).alias("avgdl"))
        wanted = join_small(_pushed(index.postings, vocabulary, small), vocabulary, ["term"], "chunk_id", "left_semi", fits=small)
        stats = join_small(index.term_stats, vocabulary, ["term"], "term", "left_semi", fits=small)
    else:
        # The texts are tokenised once: what the queries need of them is written, and read three times.
        marks = queries.sparkSession.createDataFrame([(LENGTH_MARK,)], "term string")
        needed = vocabulary.unionByName(marks)
        found = join_small(_marked_postings(index), needed, ["term"], "chunk_id", "left_semi", fits=small)
        matched = cut_lineage(found.select("chunk_id", "slug", "dl", "term", "tf"), "postings")
        lengths = matched.where(F.col("term") == LENGTH_MARK)
        corpus = corpus_stats(lengths).select(F.struct("n", "avgdl")).scalar()
        wanted = matched.where(F.col("term") != LENGTH_MARK)
        stats = document_frequency(wanted).select("term", idf_of(corpus["n"], F.col("df")).alias("idf"))
        if small:
            # one exchange of the matching postings, whatever the number of queries; the sum below reuses it
            wanted = wanted.repartition("chunk_id")
    avgdl = corpus["avgdl"]

    # one row per vocabulary term, hence no larger than the counted query terms
    weighted_terms = join_small(terms, stats.select("term", "idf"), ["term"], "qid", fits=small)
    if by_slug:
        # a bound query only ever meets the postings of its own slug
        bound = weighted_terms.where(F.col("only_slug").isNotNull()).withColumnRenamed("only_slug", "slug")
        free = weighted_terms.where(F.col("only_slug").isNull()).drop("only_slug")
        hits = join_small(wanted, bound, ["term", "slug"], "chunk_id", fits=small).unionByName(
            join_small(wanted, free, ["term"], "chunk_id", fits=small)
        )
    else:
        hits = join_small(wanted, weighted_terms, ["term"], "chunk_id", fits=small)
    part = F.col("qtf") * F.col("idf") * term_weight(F.col("tf"), F.col("dl"), avgdl, k1, b)
    return hits.groupBy("qid", "slug", "chunk_id").agg(F.round(F.sum(part), SCORE_DIGITS).alias("score"))


# pairs, and occurrences of query terms, that a task holds at once
CELLS_HELD = 1_000_000
# results that a task holds before it hands them on
RESULTS_HELD = 1_000_000


@dataclass(frozen=True)
class _Wanted:
    """Weighted query terms by key: ``query`` and ``weight`` from ``ends[i]`` to ``ends[i + 1]`` belong to ``keys[i]``.

    A broadcast value names its class, which executors need not know, so tasks are sent the ``arrays``.
    """

    keys: np.ndarray
    ends: np.ndarray
    query: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, int, float]]) -> _Wanted:
        key, query, weight = (np.array(x, dtype=t) for x, t in zip(zip(*rows) if rows else ((), (), ()), (np.int64, np.int64, float)))
        order = np.argsort(key, kind="stable")
        keys, first = np.unique(key[order], return_index=True)
        return cls(keys, np.append(first, len(order)), query[order], weight[order])

    @property
    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.keys, self.ends, self.query, self.weight

    def found(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of the entries of each key."""
        if len(self.keys) == 0:
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.ends[at], np.where(self.keys[at] == keys, self.ends[at + 1] - self.ends[at], 0)


def _matched(index: LexicalIndex, words: list[str]) -> tuple[DataFrame, dict[int, float], float]:
    """``(chunk_id, slug, dl, codes, tfs)`` of the chunks with the numbers of the given words in them, the idf of these
    numbers, and the average length."""
    spark = index.lengths.sparkSession
    if index.tokens is None:
        known = spark.createDataFrame(list(enumerate(words)), "code int, term string")
        vocabulary = known.select("term")
        small = F.broadcast(known)
        rows = _pushed(index.postings, vocabulary, True).join(small, "term").groupBy("chunk_id", "slug", "dl")
        pairs = rows.agg(F.collect_list(F.struct("code", "tf")).alias("runs"))
        matched = pairs.select("chunk_id", "slug", "dl", *[F.col("runs")[x].cast("array<int>").alias(x + "s") for x in ("code", "tf")])
        avgdl = corpus_stats(index.lengths).first()["avgdl"] if index.totals is None else index.totals[1] / max(index.totals[0], 1)
        idf = {r["code"]: r["idf"] for r in term_stats(index).join(small, "term").select("code", "idf").collect()}
        return matched, idf, avgdl

    # the texts are tokenised once: what the queries need of them is written, one row per chunk, and read three times
    tokens = index.tokens.select("chunk_id", "slug", "dl", "runs")
    shared = spark.sparkContext.broadcast(words)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column(3)
            flat, parent = runs.flatten(), pc.list_parent_indices(runs)
            terms, tf = pc.struct_field(flat, 0), pc.struct_field(flat, 1)
            code = pc.index_in(terms, value_set=pa.array(shared.value, terms.type))
            known = pc.is_valid(code)
            sizes = np.bincount(parent.filter(known).to_numpy(), minlength=len(runs))
            ends = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, x.filter(known).cast(pa.int32())) for x in (code, tf)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *lists], ["chunk_id", "slug", "dl", "codes", "tfs"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tokens.schema.fields[:3])
    matched = cut_lineage(tokens.mapInArrow(pick, f"{kinds}, codes array<int>, tfs array<int>"), "matched")
    n, avgdl = corpus_stats(matched).first()
    counts = matched.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("df"))
    # one row per word of the queries
    return matched, {r["code"]: log((n - r["df"] + 0.5) / (r["df"] + 0.5) + 1.0) for r in counts.collect()}, avgdl


def bm25_best(
    queries: DataFrame,
    index: LexicalIndex,
    k: int,
    by_slug: bool = False,
    text_col: str = "query",
    k1: float = K1,
    b: float = B,
) -> DataFrame:
    """``(qid, slug, chunk_id, score, rank)``: the best ``k`` rows of ``bm25_scores`` per query or, with ``by_slug``, per query
    and slug of the chunks; otherwise ``slug`` is null. A chunk is one row of the index.

    Query terms are counted before they go to the tasks; a larger query side is joined and exchanged instead.
    """
    terms = query_terms(queries, text_col)
    per = ("qid", "slug") if by_slug else ("qid",)
    if not fits_broadcast(terms):
        return top_k(bm25_scores(queries, index, text_col, k1, b), k, per)
    spark = queries.sparkSession
    asked = terms.collect()
    words = sorted({r["term"] for r in asked})
    matched, idf, avgdl = _matched(index, words)

    code = {w: i for i, w in enumerate(words)}
    number = {q: i for i, q in enumerate(dict.fromkeys(r["qid"] for r in asked))}
    only = [r["slug"] if "slug" in terms.columns else None for r in asked]
    slugs = {s: i for i, s in enumerate(dict.fromkeys(s for s in only if s is not None))}
    free, bound = [], []
    for r, slug in zip(asked, only):
        if (c := code[r["term"]]) in idf:
            row = (c if slug is None else slugs[slug] * len(words) + c, number[r["qid"]], r["qtf"] * idf[c])
            (free if slug is None else bound).append(row)
    schema = T.StructType(
        [T.StructField("qid", queries.schema["qid"].dataType), T.StructField("slug", matched.schema["slug"].dataType)]
        + [T.StructField("chunk_id", matched.schema["chunk_id"].dataType), T.StructField("score", T.DoubleType())]
    )
    kinds = to_arrow_schema(schema)
    shared = spark.sparkContext.broadcast((pa.array(list(number), kinds.field(0).type), slugs, _Wanted.of(free).arrays, _Wanted.of(bound).arrays))
    n_words = len(words)

    def rows_of(lists: dict) -> Iterator[pa.RecordBatch]:
        qids = shared.value[0]
        for slug, best in lists.items():
            rows, ids, scores = best.result()
            columns = [qids.take(pa.array(rows)), pa.array([slug] * len(rows), kinds.field(1).type)]
            columns += [pa.array(ids, kinds.field(2).type), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, slugs, *sent = shared.value
        free, bound = (_Wanted(*arrays) for arrays in sent)
        lists: dict = {}
        for batch in batches:
            ids = batch.column(0)
            ids = np.array(ids.to_pylist(), dtype=object) if ids.null_count else ids.to_numpy(zero_copy_only=False)
            slug = np.array(batch.column(1).to_pylist(), dtype=object)
            codes, tf = (batch.column(i).flatten().to_numpy().astype(np.int64) for i in (3, 4))
            chunk = np.repeat(np.arange(len(ids)), pc.list_value_length(batch.column(3)).to_numpy())
            dl = batch.column(2).to_numpy(zero_copy_only=False)[chunk]
            weight = tf * (k1 + 1.0) / (tf + k1 * ((1.0 - b) + b * dl / (avgdl or 1.0)))
            home = np.array([slugs.get(s, -1) for s in slug], dtype=np.int64)[chunk]
            found = [(free, *free.found(codes)), (bound, *bound.found(np.where(home < 0, -1, home * n_words + codes)))]
            hits = np.bincount(chunk, sum(sizes for _, _, sizes in found), minlength=len(ids))
            cost = np.where(hits > 0, np.cumsum(np.where(hits > 0, hits + len(qids), 0)) // CELLS_HELD, -1)
            for stripe in range(int(cost.max(initial=-1)) + 1):
                chunks = np.flatnonzero(cost == stripe)
                if len(chunks) == 0:
                    continue
                at = slice(*np.searchsorted(chunk, [chunks[0], chunks[-1] + 1]))
                place = np.searchsorted(chunks, chunk[at])
                parts = [(spans(first[at], sizes[at]), sizes[at], wanted) for wanted, first, sizes in found]
                query = np.concatenate([wanted.query[x] for x, _, wanted in parts])
                cell = np.concatenate([np.repeat(place, sizes) for _, sizes, _ in parts])
                value = np.concatenate([wanted.weight[x] * np.repeat(weight[at], sizes) for x, sizes, wanted in parts])
                present = np.flatnonzero(np.bincount(query, minlength=len(qids)))
                row = np.searchsorted(present, np.arange(len(qids)))
                sums = np.bincount(row[query] * len(chunks) + cell, value, minlength=len(present) * len(chunks))
                sums = sums.reshape(len(present), len(chunks))
                sums[sums <= 0.0] = -np.inf
                groups = pd.Series(slug[chunks]).groupby(slug[chunks], sort=False, dropna=False).indices if by_slug else {None: slice(None)}
                for name, columns in groups.items():
                    name = None if name is None or name != name else name
                    block = sums[:, columns]
                    best = lists.setdefault(name, BestLists(len(qids), k))
                    best.offer(block, ids[chunks][columns], lambda r, c: block[r] if c is None else block[r, c], queries=present)
            if len(lists) * len(qids) * k > RESULTS_HELD:
                yield from rows_of(lists)
                lists = {}
        yield from rows_of(lists)

    return top_k(matched.mapInArrow(score, schema), k, per)


def top_k(scores: DataFrame, k: int, partition: tuple[str, ...] = ("qid",), tie: str = "chunk_id") -> DataFrame:
    """Best ``k`` rows per partition with a one-based ``rank``; Spark prunes each task to ``k`` rows first."""
    order = W.partitionBy(*partition).orderBy(F.desc("score"), F.asc(tie))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25_topk(
    queries: DataFrame,
    index: LexicalIndex,
    k: int = 7,
    text_col: str = "query",
    pad: bool = True,
    k1: float = K1,
    b: float = B,
) -> DataFrame:
    """``(qid, rank, chunk_id, score)``.

    With ``pad``, a query with fewer than ``k`` matching chunks is filled with the first chunks by identifier
    at score 0, as a full sort over all chunks would do.
    """
    found = bm25_best(queries, index, k, False, text_col, k1, b).select("qid", "rank", "chunk_id", "score")
    return with_padding(found, queries, index, k) if pad else found


def with_padding(found: DataFrame, queries: DataFrame, index: LexicalIndex, k: int) -> DataFrame:
    """Ranked lists filled up to ``k`` with the first chunks at score 0."""
    # a query with fewer than k matches has them all in its list, so merging the short lists is exact
    merged = found.drop("rank").unionByName(padding(queries, index, k))
    return top_k(merged.groupBy("qid", "chunk_id").agg(F.max("score").alias("score")), k).select(
        "qid", "rank", "chunk_id", "score"
    )


def padding(queries: DataFrame, index: LexicalIndex, k: int) -> DataFrame:
    """The first ``k`` chunks of every query at score 0: of its slug when it has one, else of the corpus."""
    rows = queries.select("qid", F.explode(_first_chunks(index, k)).alias("chunk_id"))
    if "slug" in queries.columns:
        order = W.partitionBy("slug").orderBy("chunk_id")
        first = index.lengths.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
        bound = queries.where(F.col("slug").isNotNull()).select("qid", "slug").join(first.select("slug", "chunk_id"), "slug")
        free = queries.where(F.col("slug").isNull()).select("qid", F.explode(_first_chunks(index, k)).alias("chunk_id"))
        rows = bound.select("qid", "chunk_id").unionByName(free)
    return rows.withColumn("score", F.lit(0.0))


def _first_chunks(index: LexicalIndex, k: int) -> Column:
    """The first ``k`` chunk identifiers as one array value."""
    first = index.lengths.select("chunk_id").orderBy("chunk_id").limit(k)
    return first.agg(F.array_sort(F.collect_list("chunk_id"))).scalar()


def keyword_scan(chunks: DataFrame, keyword: str, k: int, position: str, text_col: str = "text") -> DataFrame:
    """Baseline search: the first ``k`` chunks that contain the keyword, in document order."""
    return chunks.where(F.lower(F.col(text_col)).contains(keyword.lower())).orderBy(position).limit(k)
