"""The registered queries of this package with their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from shelfmine.llm import chat, jaccard, lm, minmax, packing, periods, quality, sentencepieces, sql, substrings, topk, toxicity, warc, whitening
from shelfmine.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(text: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if text is not None:
            ORACLES[query.__name__] = text
        return query

    return add


@register()
def op1_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm.scores(table(spark, folder, "documents"))


@register()
def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepieces.encoded(table(spark, folder, "documents"))


@register()
def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, folder, "pages"))).drop("record")


@register()
def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.repeats(table(spark, folder, "documents")).drop("rid")


@register(sql.TOP_K)
def op4_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return topk.search(rows, rows["vec_id"] % 100 == 0)


@register()
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@register(sql.JACCARD)
def op7_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join_report(table(spark, folder, "documents"))


@register(sql.CHAT)
def op8_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    more = [(-7, 0, "user", text), (-7, 1, "assistant", text)]
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(more, "conv_id bigint, turn bigint, role string, text string"))
    records = chat.turn_records(rows, "conv_id", "turn", "role", "text")
    return chat.digests(chat.format_records(records))


@register(sql.QUALITY)
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.verdicts(table(spark, folder, "documents")).drop("longest_repeat")


@register()
def op10_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@register(sql.PERIODS)
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periods.found(table(spark, folder, "documents"), plant=True)


@register(sql.NEAR)
def op12_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minmax.classes(table(spark, folder, "documents"))


@register()
def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(table(spark, folder, "embeddings"))


@register(corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
