"""Document and golden-set readers."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmine.operators.rows import unfolded_values


def balanced(rows: DataFrame) -> DataFrame:
    """Rows spread over the cores when the files make fewer splits than there are cores, else as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def _suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def decoded(content: Column) -> Column:
    """UTF-8 when the bytes are valid UTF-8, else Latin-1, which accepts any bytes."""
    as_text = content.cast("string")
    return F.when(F.is_valid_utf8(as_text), as_text).otherwise(F.decode(content, "ISO-8859-1"))


def read_texts(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """``(path, slug, suffix, text)``, one row per file. ``strict`` refuses files that are not UTF-8."""
    files = spark.read.format("binaryFile").load(path)
    as_text = F.col("content").cast("string")
    if strict:
        text = F.when(F.is_valid_utf8(as_text), as_text).otherwise(
            F.raise_error(F.concat(F.lit("not valid UTF-8: "), F.col("path")))
        )
    else:
        text = decoded(F.col("content"))
    return files.select("path", _stem(F.col("path")).alias("slug"), _suffix(F.col("path")).alias("suffix"), text.alias("text"))


def read_pdfs(spark: SparkSession, path: str, keep_empty_pages: bool = False) -> DataFrame:
    """``(path, slug, suffix, text)`` of PDF files: page texts joined by line feeds.

    Needs one of the PDF libraries on the executors; they are looked up when the first file is read.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def pages(content: bytes) -> list[str]:
        try:
            import fitz
        except ImportError:
            try:
                import pdfplumber
            except ImportError as error:
                raise ImportError("reading PDF files needs pymupdf or pdfplumber") from error
            with pdfplumber.open(io.BytesIO(content)) as pdf:
                return [page.extract_text() or "" for page in pdf.pages]
        with fitz.open(stream=content, filetype="pdf") as pdf:
            return [page.get_text("text") for page in pdf]

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = ["\n".join(p for p in pages(c) if p or keep_empty_pages) for c in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "text": texts})

    return files.mapInPandas(extract, "path string, text string").select(
        "path", _stem(F.col("path")).alias("slug"), _suffix(F.col("path")).alias("suffix"), "text"
    )


def golden_rows(maps: DataFrame, column: str = "value") -> DataFrame:
    """``(gold_id, query)`` from JSON texts that map a chunk to its queries."""
    parsed = F.from_json(F.col(column), "map<string,array<string>>")
    pairs = maps.select(F.explode_outer(parsed).alias("gold_id", "queries")).where(F.col("gold_id").isNotNull())
    return unfolded_values(pairs, F.col("queries"), "query", "gold_id")


def read_golden(spark: SparkSession, *paths: str) -> DataFrame:
    """Union of golden files; a missing file is left out."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    present = [p for p in paths if hadoop(p).getFileSystem(conf).globStatus(hadoop(p)) is not None]
    present = [p for p in present if len(hadoop(p).getFileSystem(conf).globStatus(hadoop(p))) > 0]
    if not present:
        return spark.createDataFrame([], "gold_id string, query string")
    return golden_rows(spark.read.text(present, wholetext=True))


def golden_lines(golden: DataFrame) -> DataFrame:
    """One JSON object ``{chunk: [queries]}`` per chunk, for writing as text."""
    return golden.groupBy("gold_id").agg(F.array_sort(F.collect_list("query")).alias("queries")).select(
        F.to_json(F.create_map("gold_id", "queries")).alias("value")
    )
