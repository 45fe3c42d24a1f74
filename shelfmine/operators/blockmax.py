"""BM25 with block-max pruning: the best chunks of each query without scoring every chunk that shares a word with it.

Chunks are dealt to blocks of a bounded size, like ones together. A block keeps for each of its terms the largest frequency and
the smallest length, which bound what the term adds to the score of any chunk of the block, whatever the average length is.
A query first scores the few blocks of its highest bounds. The score of its k-th best chunk there is a threshold, and of
the other blocks it scores those only whose bound reaches it. A chunk that is not scored could not have been among the best,
so the result is that of the full search.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmine.operators.lexical import (
    SCORE_DIGITS,
    LexicalIndex,
    corpus_stats,
    idf_of,
    index_of_tokens,
    query_terms,
    term_weight,
    top_k,
    with_padding,
)
from shelfmine.operators.rows import unfolded
from shelfmine.operators.skew import fits_broadcast, join_small
from shelfmine.session import cut_lineage, drop_steps

BLOCK_ROWS = 32
# blocks that every query scores to get its threshold, for each result that it wants
FIRST_BLOCKS = 1
# bounds are sums of doubles and scores are rounded, so a bound counts as reached from this far below
SLACK = 2 * 10.0**-SCORE_DIGITS


@dataclass(frozen=True)
class BlockIndex:
    """``postings(block, chunk_id, slug, dl, term, tf)``, ``bounds(term, block, max_tf, min_dl, rows)`` and the statistics."""

    index: LexicalIndex
    postings: DataFrame
    bounds: DataFrame
    stats: DataFrame
    n: int
    avgdl: float


def _with_block(rows: DataFrame, block_rows: int) -> DataFrame:
    """``rows(chunk_id, top)`` with their block. Chunks with the same most frequent term share blocks, so texts of one language
    or subject come together and blocks of others have low bounds; a term of many chunks has as many blocks as these need."""
    sizes = rows.groupBy("top").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("chunk_id"), F.col("parts"))
    return join_small(rows, sizes, ["top"], "chunk_id").withColumn("block", F.xxhash64("top", part)).drop("top", "parts")


def _placed(index: LexicalIndex, block_rows: int) -> tuple[DataFrame, LexicalIndex, DataFrame]:
    """Postings with blocks, the index over what was written, and that table. A lazy index is dealt, and its chunks meet in the
    task of their block, before its terms become rows, so its postings are not exchanged."""
    columns = ["chunk_id", "slug", "dl"]
    if index.tokens is not None:
        by_count = F.transform("runs", lambda r: F.struct(r["tf"].alias("tf"), r["term"].alias("term")))
        # written with the terms, as it is read for the sizes, the postings and the bounds
        tokens = cut_lineage(index.tokens.withColumn("top", F.array_max(by_count)["term"]), "tokens")
        dealt = _with_block(tokens.where(F.col("top").isNotNull()), block_rows).repartition("block")
        return unfolded(dealt, F.col("runs"), "term", "block", *columns), index_of_tokens(tokens), tokens
    postings = cut_lineage(index.postings.select(*columns, "term", "tf"), "postings")
    top = cut_lineage(postings.groupBy("chunk_id").agg(F.max_by("term", F.struct("tf", "term")).alias("top")), "top-terms")
    dealt = postings.join(_with_block(top, block_rows), "chunk_id")
    return dealt, LexicalIndex(index.lengths, postings, index.term_stats), postings


def blocked(index: LexicalIndex, block_rows: int = BLOCK_ROWS) -> BlockIndex:
    """Block tables of an index, written once for any number of searches."""
    placed, whole, source = _placed(index, block_rows)
    dealt = placed.select("block", "chunk_id", "slug", "dl", "term", "tf")
    placed = cut_lineage(dealt.sortWithinPartitions("term"), "block-postings")
    # the tasks of a lazy index hold whole blocks; a stored one is not joined again for its bounds
    whole_blocks = dealt if index.tokens is not None else placed
    largest = (F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.count(F.lit(1)).alias("rows"))
    bounds = cut_lineage(whole_blocks.groupBy("term", "block").agg(*largest), "bounds")
    n, avgdl = corpus_stats(whole.lengths).first() if index.totals is None else (index.totals[0], index.totals[1] / max(index.totals[0], 1))
    stats = index.term_stats
    if stats is None:
        stats = bounds.groupBy("term").agg(F.sum("rows").alias("df")).withColumn("idf", idf_of(F.lit(n), F.col("df")))
    stats = cut_lineage(stats.select("term", "idf"), "term-stats")
    lengths = cut_lineage(whole.lengths.select("chunk_id", "slug", "dl"), "lengths")
    drop_steps(source)
    return BlockIndex(LexicalIndex(lengths, placed.drop("block"), stats), placed, bounds, stats, n, avgdl)


def scored_pairs(queries: DataFrame, blocks: BlockIndex, k: int, first_blocks: int = FIRST_BLOCKS) -> DataFrame:
    """``(qid, slug, chunk_id, score)`` of the chunks that were scored; the best ``k`` of every query are among them."""
    by_slug = "slug" in queries.columns
    terms = query_terms(queries)
    if by_slug:
        terms = terms.withColumnRenamed("slug", "only_slug")
    fits = fits_broadcast(terms)
    keep = ["qid", *(["only_slug"] if by_slug else []), "term"]
    weighted = join_small(terms, blocks.stats, ["term"], "qid", fits=False)
    weighted = cut_lineage(weighted.select(*keep, (F.col("qtf") * F.col("idf")).alias("w")), "weighted")
    most = F.col("w") * term_weight(F.col("max_tf"), F.col("min_dl"), F.lit(blocks.avgdl))
    bounds = join_small(blocks.bounds, weighted.select("qid", "term", "w"), ["term"], "block", fits=fits)
    bounds = cut_lineage(bounds.groupBy("qid", "block").agg(F.sum(most).alias("bound")), "bounds")

    # only postings of the queries' words are exchanged, and these are written once for both rounds
    vocabulary = weighted.select("term").distinct()
    matched = cut_lineage(join_small(blocks.postings, vocabulary, ["term"], "chunk_id", "left_semi", fits=fits), "matched")

    def scored(pairs: DataFrame) -> DataFrame:
        asked = pairs.select("qid", "block").join(weighted, "qid")
        hits = asked.join(matched, ["block", "term"])
        if by_slug:
            hits = hits.where(F.col("only_slug").isNull() | (F.col("slug") == F.col("only_slug")))
        part = F.col("w") * term_weight(F.col("tf"), F.col("dl"), F.lit(blocks.avgdl))
        return hits.groupBy("qid", "slug", "chunk_id").agg(F.round(F.sum(part), SCORE_DIGITS).alias("score"))

    order = W.partitionBy("qid").orderBy(F.desc("bound"), "block")
    high = bounds.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k * first_blocks).select("qid", "block")
    high = cut_lineage(high, "high-blocks")
    first = cut_lineage(scored(high), "scores")
    threshold = top_k(first, k).where(F.col("rank") == k).select("qid", F.col("score").alias("least"))
    rest = bounds.join(high, ["qid", "block"], "left_anti").join(threshold, "qid", "left")
    rest = rest.where(F.col("bound") + SLACK >= F.coalesce("least", F.lit(0.0)))
    second = cut_lineage(scored(rest), "scores")
    drop_steps(weighted, bounds, high, matched)
    return first.unionByName(second)


def blockmax_topk(queries: DataFrame, blocks: BlockIndex, k: int = 7, pad: bool = True) -> DataFrame:
    """``(qid, rank, chunk_id, score)``, the rows of ``lexical.bm25_topk``."""
    found = top_k(scored_pairs(queries, blocks, k), k).select("qid", "rank", "chunk_id", "score")
    return with_padding(found, queries, blocks.index, k) if pad else found
