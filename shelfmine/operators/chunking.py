"""Cutting text into overlapping windows of tokens.

Windows are built inside the row of their section and only then exploded, so the token array is never copied
once per window and no shuffle takes place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmine.functions.arrays import let, strip
from shelfmine.functions.bpe import BytePairs
from shelfmine.functions.text import chunk_id, pieces, short_hash
from shelfmine.operators.rows import numbered, unfolded

MAX_TOKENS = 500
OVERLAP = 100

Tokenizer = Callable[[Column], Column]

# Default chapter headings of the plain reader and of the book parser.
READER_PATTERN = r"^(?:CHAPTER [IVXLCDM]+\.)\s*\n"
BOOK_PATTERN = r"^(?:CHAPTER [IVXLCDM]+\.?|Chapter \d+)\s*\n"

# The markers around the body of a public-domain text.
START_MARK = r"\*\*\* START OF.*\*\*\*"
END_MARK = r"\*\*\* END OF.*\*\*\*"


def windows(tokens: Column, max_tokens: int, overlap: int, glue: str = "") -> Column:
    """``array<struct<chunk, text, num_tokens>>``; empty input gives null.

    A window starts every ``max_tokens - overlap`` tokens, so the last one may lie inside its predecessor.
    """
    step = max_tokens - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than max_tokens")

    def cut(all_tokens: Column) -> Column:
        count = F.size(all_tokens)
        starts = F.sequence(F.lit(0), F.floor((count - 1) / F.lit(step)).cast("int"))
        return F.when(
            count > 0,
            F.transform(
                starts,
                lambda c: F.struct(
                    (c + 1).alias("chunk"),
                    F.array_join(F.slice(all_tokens, c * step + 1, max_tokens), glue).alias("text"),
                    F.least(F.lit(max_tokens), count - c * step).alias("num_tokens"),
                ),
            ),
        )

    return let(tokens, cut)


def strip_boilerplate(text: Column, trim: bool = False) -> Column:
    """Text between the start and end markers when both occur, else the text as it is."""
    start = F.regexp_extract(text, "(?d)" + START_MARK, 0)
    end = F.regexp_extract(text, "(?d)" + END_MARK, 0)
    body_at = F.instr(text, start) + F.length(start)
    body = F.substring(text, body_at, F.greatest(F.instr(text, end) - body_at, F.lit(0)))
    return F.when((start != "") & (end != ""), strip(body) if trim else body).otherwise(text)


def _split(text: Column, pattern: str) -> Column:
    return F.split(text, "(?imdU)" + pattern, -1)


def reader_sections(text: Column, pattern: str | None = None) -> Column:
    """``array<struct<section, text>>``: every part keeps its ordinal, the text before the first heading is 1."""
    parts = _split(text, pattern or READER_PATTERN)
    return F.transform(parts, lambda part, i: F.struct((i + 1).alias("section"), part.alias("text")))


def book_sections(text: Column, pattern: str | None = None) -> Column:
    """``array<struct<section, title, text>>``: blank parts vanish before numbering, the title is the first line."""
    parts = F.filter(F.transform(_split(text, pattern or BOOK_PATTERN), strip), lambda part: part != "")
    return F.transform(
        parts,
        lambda part, i: F.struct(
            (i + 1).alias("section"),
            F.substring(F.split(part, "\n", 2)[0], 1, 100).alias("title"),
            part.alias("text"),
        ),
    )


def ending_marker_sections(text: Column, pattern: str, min_chars: int = 100) -> Column:
    """Sections that end with a marker line; small fragments are dropped.

    The title is the first plausible one among the first ten lines: 6 to 99 characters, upper or title case.
    """
    parts = F.filter(
        F.transform(F.split(text, "(?mdU)" + pattern, -1), strip), lambda part: F.length(part) >= min_chars
    )

    def title(part: Column, ordinal: Column) -> Column:
        heads = F.filter(
            F.transform(F.slice(F.split(part, "\n", -1), 1, 10), strip),
            lambda line: (F.length(line) > 5)
            & (F.length(line) < 100)
            & (
                (F.upper(line) == line)
                | (
                    line.rlike(r"[\p{Lu}\p{Lt}\p{Ll}]")
                    & ~line.rlike(r"(^|[^\p{Lu}\p{Lt}\p{Ll}])\p{Ll}|[\p{Lu}\p{Lt}\p{Ll}][\p{Lu}\p{Lt}]")
                )
            ),
        )
        fallback = F.concat(F.lit("Chapter "), ordinal.cast("string"))
        return F.coalesce(F.substring(F.get(heads, F.lit(0)), 1, 80), fallback)

    return F.transform(
        parts,
        lambda part, i: F.struct(
            (i + 1).alias("section"), title(part, i + 1).alias("title"), part.alias("text")
        ),
    )


def section_chunks(
    sections: DataFrame,
    max_tokens: int = MAX_TOKENS,
    overlap: int = OVERLAP,
    tokenizer: Tokenizer | BytePairs = pieces,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Chunks of ``(slug, section, text)`` rows with identifiers, hashes and counts.

    With a vocabulary the text of a chunk is what its tokens decode to, and ``num_tokens`` counts the tokens of that text,
    which at the borders are not always those of the window.
    """
    if isinstance(tokenizer, BytePairs):
        parts = tokenizer.windows(F.col("text"), max_tokens, overlap)
        cut = unfolded(sections, parts, "chunk", "slug", "section", *keep).drop("ids", "start", "end")
        cut = cut.withColumn("num_tokens", tokenizer.count(F.col("text")))
    else:
        cut = unfolded(sections, windows(tokenizer(F.col("text")), max_tokens, overlap), "chunk", "slug", "section", *keep)
    return cut.select(
        chunk_id(F.col("slug"), F.col("section"), F.col("chunk"), F.col("text")).alias("chunk_id"),
        "slug",
        "section",
        "chunk",
        "text",
        short_hash(F.col("text")).alias("hash"),
        "num_tokens",
        F.length("text").alias("num_chars"),
        *keep,
    )


def book_chunks(
    documents: DataFrame,
    slug: str = "slug",
    text: str = "text",
    pattern: str | None = None,
    max_tokens: int = MAX_TOKENS,
    overlap: int = OVERLAP,
    tokenizer: Tokenizer | BytePairs = pieces,
) -> DataFrame:
    """The ingestion path for books: boilerplate off, reader sections, token windows."""
    body = strip_boilerplate(F.col(text))
    sections = unfolded(documents, reader_sections(body, pattern), "section", F.col(slug).alias("slug"))
    return section_chunks(sections, max_tokens, overlap, tokenizer)


def parsed_book_chunks(
    documents: DataFrame,
    slug: str = "slug",
    text: str = "text",
    pattern: str | None = None,
    max_tokens: int = MAX_TOKENS,
    overlap: int = OVERLAP,
    tokenizer: Tokenizer = pieces,
) -> DataFrame:
    """The parser path for books: chapters with titles, and one running chunk number per book.

    The running number is counted inside the row of the book, before anything is exploded.
    """
    body = strip_boilerplate(F.col(text), trim=True)
    chapters = F.transform(
        book_sections(body, pattern),
        lambda s: F.transform(
            F.coalesce(windows(tokenizer(s["text"]), max_tokens, overlap), F.array()),
            lambda w: F.struct(
                s["section"].alias("section"),
                s["title"].alias("chapter_title"),
                w["chunk"].alias("chunk"),
                w["text"].alias("text"),
                w["num_tokens"].alias("num_tokens"),
            ),
        ),
    )
    rows = numbered(documents, F.flatten(chapters), "_i", "_c", F.col(slug).alias("slug")).select(
        "slug", (F.col("_i") + 1).alias("chunk_index"), "_c.*"
    )
    return rows.select(
        chunk_id(F.col("slug"), F.col("section"), F.col("chunk"), F.col("text")).alias("chunk_id"),
        "slug",
        "section",
        "chunk",
        "text",
        short_hash(F.col("text")).alias("hash"),
        "num_tokens",
        F.length("text").alias("num_chars"),
        "chapter_title",
        "chunk_index",
    )


def word_chunks(text: Column, size: int = 800, overlap: int = 100) -> Column:
    """Windows over white-space words; the very first word is left out, as in the exploratory original."""
    all_words = F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))
    return windows(F.slice(all_words, 2, F.greatest(F.size(all_words) - 1, F.lit(0))), size, overlap, " ")


def chunk_totals(chunks: DataFrame, by: str = "slug") -> DataFrame:
    """Chunk, character and token totals of each document."""
    return chunks.groupBy(by).agg(
        F.count(F.lit(1)).alias("num_chunks"),
        F.sum("num_chars").alias("num_chars"),
        F.sum("num_tokens").alias("num_tokens"),
    )


def chunk_profile(chunks: DataFrame) -> DataFrame:
    """Length statistics of a chunk table."""
    return chunks.agg(
        F.count(F.lit(1)).alias("chunks"),
        F.min("num_chars").alias("min_chars"),
        F.max("num_chars").alias("max_chars"),
        F.round(F.avg("num_chars"), 6).alias("avg_chars"),
        F.round(F.avg("num_tokens"), 6).alias("avg_tokens"),
        F.max("num_tokens").alias("max_tokens"),
    )


def length_histogram(chunks: DataFrame, width: int = 500) -> DataFrame:
    """Chunks per character-length bucket of ``width``."""
    return (
        chunks.groupBy((F.floor(F.col("num_chars") / F.lit(width)) * width).alias("from_chars"))
        .agg(F.count(F.lit(1)).alias("chunks"))
    )


def validated(chunks: DataFrame) -> DataFrame:
    """Fail on the first chunk without text or metadata."""
    missing = [c for c in ("text", "metadata") if c not in chunks.columns]
    if missing:
        raise ValueError(f"chunks lack required fields: {', '.join(missing)}")
    ok = F.col("text").isNotNull() & F.col("metadata").isNotNull()
    return chunks.withColumn(
        "text", F.when(ok, F.col("text")).otherwise(F.raise_error(F.lit("chunk text and metadata must not be null")))
    )


def section_texts(chunks: DataFrame, document: str = "slug") -> DataFrame:
    """Text of each section of a document: its chunks in order, joined by line feeds, overlaps included."""
    return chunks.groupBy(document, "section").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("chunk", "text"))), lambda c: c["text"]), "\n"
        ).alias("text")
    )
