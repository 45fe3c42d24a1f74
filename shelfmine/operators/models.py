"""Model-backed operators behind small interfaces.

The real services are not part of this package. Each interface has a deterministic offline stand-in, which is
meant for tests and wiring and makes no claim about quality.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmine.functions.arrays import let, run_lengths, strip
from shelfmine.functions.text import extractive_summary, index_terms, is_comparison, pieces, query_words
from shelfmine.operators.telemetry import normalised_score

SECTION_TOKENS = 100_000
DOCUMENT_TOKENS = 25_000

# Name of a section in each document type.
SECTION_UNITS = {
    "book": "Chapter", "conversation": "Conversation segment", "script": "Scene", "tech_doc": "Section",
    "report": "Section",
}

# Price per thousand tokens in US dollars by model, the price of an unlisted model, and the
# conversion into the reporting currency.
PRICES = {
    "gpt-4o": 0.005, "gpt-4o-mini": 0.00015, "gpt-4o-2024-08-06": 0.005, "gpt-4-turbo": 0.01, "gpt-4": 0.03,
    "gpt-3.5-turbo": 0.0015,
}
DEFAULT_PRICE = 0.001
CURRENCY_FACTOR = 1.5


class Embedder(Protocol):
    def embed(self, rows: DataFrame, text: str) -> DataFrame:
        """Rows with the unit vector ``array<double>`` of a text column as ``vector``."""


class Summarizer(Protocol):
    def summarise(self, text: Column) -> Column:
        """Short text for a long one."""


class Rephraser(Protocol):
    def rephrase(self, query: Column) -> Column:
        """Another phrasing, or an empty string."""


# terms whose bucket a task remembers
REMEMBERED = 200_000


@dataclass(frozen=True)
class HashingEmbedder:
    """Term counts hashed into ``dimensions`` buckets, normalised. Terms are counted in the JVM, each distinct term of a batch is
    hashed once."""

    dimensions: int = 64

    def embed(self, rows: DataFrame, text: str) -> DataFrame:
        counted = rows.withColumn("_runs", run_lengths(index_terms(F.col(text))))
        return self.of_runs(counted, "_runs")

    def of_runs(self, rows: DataFrame, runs: str) -> DataFrame:
        """Rows with ``vector`` in place of a column ``array<struct<term, tf>>``."""
        kept = [f for f in rows.schema.fields if f.name not in (runs, "vector")]
        schema = T.StructType([*kept, T.StructField("vector", T.ArrayType(T.DoubleType()))])
        rows = rows.select(*[f"`{f.name}`" for f in kept], runs)
        width = self.dimensions

        # plans show this name, so that they say where terms are hashed
        def hashed_by_md5(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bucket: dict[str, int] = {}
            for batch in batches:
                counts = batch.column(batch.num_columns - 1)
                flat, parent = counts.flatten(), pc.list_parent_indices(counts).to_numpy().astype(np.int64)
                terms = pc.struct_field(flat, 0).dictionary_encode()
                if len(bucket) > REMEMBERED:
                    bucket = {}
                names = terms.dictionary.to_pylist()
                for name in names:
                    if name not in bucket:
                        bucket[name] = int(md5(name.encode()).hexdigest()[:8], 16) % width
                at = np.array([bucket[name] for name in names], dtype=np.int64)[terms.indices.to_numpy()]
                tf = pc.struct_field(flat, 1).to_numpy()
                sums = np.bincount(parent * width + at, tf, minlength=len(counts) * width).reshape(-1, width)
                norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
                ends = pa.array(np.arange(len(counts) + 1) * width, pa.int32())
                vector = pa.ListArray.from_arrays(ends, pa.array((sums / np.where(norm > 0.0, norm, 1.0)).ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vector], [f.name for f in schema.fields])

        return rows.mapInArrow(hashed_by_md5, schema)


@dataclass(frozen=True)
class ExtractiveSummarizer:
    def summarise(self, text: Column) -> Column:
        return extractive_summary(text)


@dataclass(frozen=True)
class KeywordRephraser:
    """The query without stop words, sorted; empty when nothing is left."""

    def rephrase(self, query: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(query_words(query))), " ")


def batches(text: Column, max_tokens: int) -> Column:
    """The text itself when it fits, else nearly equal parts; the remainder may add one more part."""

    def cut(tokens: Column) -> Column:
        count = F.size(tokens)
        size = F.floor(count / (F.floor(count / max_tokens) + 1)).cast("int")
        starts = F.sequence(F.lit(0), F.floor((count - 1) / size).cast("int"))
        parts = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i * size + 1, size), ""))
        return F.when(count <= max_tokens, F.array(text)).otherwise(parts)

    return let(pieces(text), cut)


def summarised(text: Column, summarizer: Summarizer, max_tokens: int) -> Column:
    """Summary of a text; a long one is summarised in parts whose summaries are then combined."""

    def combine(parts: Column) -> Column:
        labelled = F.transform(
            parts, lambda p, i: F.concat(F.lit("Part "), (i + 1).cast("string"), F.lit(": "), summarizer.summarise(p))
        )
        return F.when(F.size(parts) == 1, summarizer.summarise(F.get(parts, F.lit(0)))).otherwise(
            summarizer.summarise(F.array_join(labelled, "\n\n"))
        )

    return let(batches(text, max_tokens), combine)


def section_summaries(
    sections: DataFrame, summarizer: Summarizer | None = None, max_tokens: int = SECTION_TOKENS
) -> DataFrame:
    """``(slug, section, text)`` to ``(slug, section, summary)``."""
    summarizer = summarizer or ExtractiveSummarizer()
    return sections.select("slug", "section", summarised(F.col("text"), summarizer, max_tokens).alias("summary"))


def document_summaries(
    summaries: DataFrame, summarizer: Summarizer | None = None, doc_type: str = "book", max_tokens: int = DOCUMENT_TOKENS
) -> DataFrame:
    """One summary per document from its section summaries in order."""
    summarizer = summarizer or ExtractiveSummarizer()
    unit = SECTION_UNITS.get(doc_type, SECTION_UNITS["book"])
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("section", "summary"))),
        lambda s: F.concat(F.lit(unit + " "), s["section"].cast("string"), F.lit(": "), s["summary"]),
    )
    joined = summaries.groupBy("slug").agg(F.array_join(ordered, "\n\n").alias("_joined"))
    return joined.select("slug", summarised(F.col("_joined"), summarizer, max_tokens).alias("summary"))


def parsed_assessment(answer: Column) -> Column:
    """``struct<score, reasoning>`` from a judge's answer: the JSON itself, or the first object inside the text."""
    schema = "struct<score:string,reasoning:string>"
    inner = F.regexp_extract(answer, r"(?s)\{[^}]+\}", 0)
    parsed = F.coalesce(
        F.when(F.try_parse_json(answer).isNotNull(), F.from_json(answer, schema)),
        F.when(F.try_parse_json(inner).isNotNull(), F.from_json(inner, schema)),
    )
    return let(
        parsed,
        lambda p: F.struct(
            normalised_score(p["score"]).alias("score"),
            F.when(p.isNull(), F.lit("Could not parse assessment JSON"))
            .otherwise(F.coalesce(p["reasoning"], F.lit("")))
            .alias("reasoning"),
        ),
    )


def rule_judgement(query: Column, response: Column) -> Column:
    """Offline stand-in judge: share of query words found in the response."""
    wanted = F.array_distinct(query_words(query))
    share = F.size(F.array_intersect(wanted, index_terms(response))) / F.greatest(F.size(wanted), F.lit(1))
    return F.when(share >= 0.75, F.lit("EXCELLENT")).when(share >= 0.4, F.lit("ADEQUATE")).otherwise(F.lit("POOR"))


def price_per_thousand(model: Column) -> Column:
    """Token price in the reporting currency."""
    price = F.lit(DEFAULT_PRICE)
    for name, value in PRICES.items():
        price = F.when(model == name, F.lit(value)).otherwise(price)
    return price * F.lit(CURRENCY_FACTOR)


@dataclass(frozen=True)
class ProviderChoice:
    """Which completion service to use."""

    default: str = "openai"
    private: bool = False
    allow_fallback: bool = True

    def choose(self, available: dict[str, bool], wanted: str | None = None) -> str:
        """Name of the first usable service: the wanted one, else the hosted one when falling back is allowed."""
        name = "local" if self.private else (wanted or self.default)
        if name not in ("openai", "local"):
            usable = False
        else:
            usable = available.get(name, False)
        if usable:
            return name
        if self.allow_fallback and not self.private and name != "openai" and available.get("openai", False):
            return "openai"
        raise RuntimeError(f"no available provider, tried {name}")
