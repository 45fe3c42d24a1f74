"""Text expressions: tokens, query preprocessing, hashes, identifiers, snippets and labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmine.functions.arrays import let, lines_of, strip

WORD = r"(?U)\w+"
# A piece is a run of non-space with the space before it, so joining pieces restores the text.
PIECE = r"(?U)\s*\S+"

# Words ignored by the keyword index.
INDEX_STOPWORDS = ("the", "a", "an", "and", "of", "in", "to")

# Words dropped from a query before the keyword search.
QUERY_STOPWORDS = (
    "what", "when", "where", "who", "why", "how", "does", "do", "did", "is", "are", "was", "were", "the", "a", "an",
    "about", "in", "on", "at", "to", "for", "of", "with", "by", "from", "this", "that", "these", "those", "and", "or",
    "but",
)

# Substrings that mark a comparison question.
COMPARISON_WORDS = ("compare", "contrast", "versus", "vs.", "vs ", "differ")

# Phrases that hint at an answer not grounded in the retrieved passages.
UNGROUNDED_PHRASES = (
    "not well-known", "not widely available", "i couldn't find", "i made an error in my previous response",
    "unfortunately, i", "i don't have information", "the search returned no", "no results were found",
    "appears to be a", "seems to be a", "likely", "probably", "suggests that", "indicating that",
)

# Substrings that count as program code outside of fences.
CODE_WORDS = (
    "def ", "class ", "function ", "SELECT ", "CREATE ", "INSERT ", "import ", "const ", "let ", "var ",
)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def index_terms(text: Column) -> Column:
    """Lower-cased word tokens without the index stop words."""
    return F.filter(words(text), lambda w: ~w.isin(*INDEX_STOPWORDS))


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def query_words(query: Column) -> Column:
    """Kept words of a query: no punctuation but hyphens, no stop word, more than two characters."""
    cleaned = F.regexp_replace(F.lower(query), r"(?U)[^\w\s-]", " ")
    return F.filter(
        F.split(cleaned, r"(?U)\s+", -1),
        lambda w: (F.length(w) > 2) & ~w.isin(*QUERY_STOPWORDS),
    )


def preprocess_query(query: Column) -> Column:
    """Stop-word-free query; the original when nothing is left."""
    kept = query_words(query)
    return F.coalesce(F.nullif(F.array_join(kept, " "), F.lit("")), query)


def dynamic_alpha(query: Column, base: float = 0.7) -> Column:
    """Keyword weight by query shape: question, short, medium, long."""
    count = F.size(F.regexp_extract_all(query, F.lit(r"(?U)\S+"), F.lit(0)))
    return (
        F.when(query.contains("?"), F.lit(0.5))
        .when(count <= 3, F.lit(0.8))
        .when(count <= 8, F.lit(float(base)))
        .otherwise(F.lit(0.6))
    )


def is_comparison(query: Column) -> Column:
    """True when the query compares things and deserves the larger model."""
    low = F.lower(query)
    hit = low.contains("between") & low.contains(" and ")
    for word in COMPARISON_WORDS:
        hit = hit | low.contains(word)
    return hit


def ungrounded_phrases(text: Column) -> Column:
    """Which of the marker phrases occur in a response."""
    low = F.lower(text)
    found = [F.when(low.contains(p), F.lit(p)) for p in UNGROUNDED_PHRASES]
    return F.array_compact(F.array(*found))


def result_count(tool_text: Column) -> Column:
    """Number of hits stated by a formatted search result; -1 when unknown."""
    stated = F.regexp_extract(tool_text, r"Found (\d+) results?", 1)
    return (
        F.when(stated != "", stated.cast("int"))
        .when(tool_text.contains("No results found") | tool_text.contains("0 results"), F.lit(0))
        .otherwise(F.lit(-1))
    )


def short_hash(text: Column, length: int = 7) -> Column:
    return F.substring(F.md5(text.cast("binary")), 1, length)


def chunk_id(slug: Column, section: Column, chunk: Column, text: Column, length: int = 7) -> Column:
    """``{slug}_{section:02d}_{chunk:03d}_{hash}``; the parts stay available as columns of their own."""
    return F.format_string("%s_%02d_%03d_%s", slug, section.cast("int"), chunk.cast("int"), short_hash(text, length))


def point_id(identifier: Column) -> Column:
    """Numeric point key: first 64 bits of the md5, modulo one billion."""
    high = F.conv(F.substring(F.md5(identifier.cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.pmod(high, F.lit(1_000_000_000).cast("decimal(20,0)")).cast("long")


def snippet(text: Column, limit: int = 800) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def section_label(identifier: Column) -> Column:
    """Section part of an identifier without leading zeros; ``0`` when empty, ``?`` when absent."""
    part = F.get(F.split(identifier, "_", -1), F.lit(1))
    bare = F.regexp_replace(part, "^0+", "")
    return F.when(part.isNull(), F.lit("?")).when(bare == "", F.lit("0")).otherwise(bare)


def _filled(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def citation(
    identifier: Column, speakers: Column, speaker: Column, heading: Column, timestamp: Column, section: Column | None = None
) -> Column:
    """Bracketed source label: speakers, else speaker, else a short heading, else the section number."""
    when_said = F.coalesce(F.concat(F.lit(", Time: "), _filled(timestamp)), F.lit(""))
    section = section_label(identifier) if section is None else section.cast("string")
    who = (
        F.when(F.size(speakers) > 0, F.concat(F.lit("Speakers: "), F.array_join(speakers, ", ")))
        .when(_filled(speaker).isNotNull(), F.concat(F.lit("Speaker: "), speaker))
        .when(_filled(heading).isNotNull() & (F.length(heading) < 50), heading)
        .otherwise(F.concat(F.lit("Section "), section))
    )
    return F.concat(F.lit("["), who, when_said, F.lit(", Source: "), identifier, F.lit("]"))


def parse_timestamp(text: Column) -> Column:
    """Date with seconds, minutes or no time; anything else gives null."""
    return F.coalesce(
        F.when(
            text.rlike(r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"),
            F.try_to_timestamp(text, F.lit("yyyy-M-d H:m:s")).cast("timestamp_ntz"),
        ),
        F.when(
            text.rlike(r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}$"),
            F.try_to_timestamp(text, F.lit("yyyy-M-d H:m")).cast("timestamp_ntz"),
        ),
        F.when(
            text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"),
            F.try_to_timestamp(text, F.lit("yyyy-M-d")).cast("timestamp_ntz"),
        ),
    )


def clock_seconds(text: Column) -> Column:
    """Seconds of ``H:M:S`` or ``M:S``; null where a part is no number, 0 for any other number of parts."""
    parts = F.split(text, ":", -1)
    number = lambda i: strip(F.get(parts, F.lit(i))).try_cast("int")
    return (
        F.when(F.size(parts) == 3, number(0) * 3600 + number(1) * 60 + number(2))
        .when(F.size(parts) == 2, number(0) * 60 + number(1))
        .when(text.isNotNull(), F.lit(0))
    )


def has_code(text: Column) -> Column:
    """A fenced block, or one of the code words."""
    hit = text.rlike(r"(?sU)```(\w+)?\n(.*?)```")
    for word in CODE_WORDS:
        hit = hit | text.contains(word)
    return hit


def _aligned_lines(text: Column) -> Column:
    """Lines with three or more double spaces, or with a tab."""
    double_spaces = lambda line: (F.length(line) - F.length(F.replace(line, F.lit("  "), F.lit("")))) / 2
    return F.size(F.filter(lines_of(text), lambda line: (double_spaces(line) >= 3) | line.contains("\t")))


def has_table_techdoc(text: Column) -> Column:
    """A row between pipes, or at least three aligned lines."""
    return text.rlike(r"(?d)\|.*\|") | (_aligned_lines(text) >= 3)


def has_table_report(text: Column) -> Column:
    """At least three aligned lines, or three numbers in a row."""
    return (_aligned_lines(text) >= 3) | text.rlike(r"(?U)(\d+\s+){3,}")


def tabular_lines(text: Column) -> Column:
    """Exploratory table test: lines with a digit and either a tab or a double space."""
    return F.filter(lines_of(text), lambda l: (l.contains("\t") | l.contains("  ")) & l.rlike(r"\d"))


def occurrences(text: Column, phrase: str) -> Column:
    """``struct<count, first>``: how often a phrase occurs and the one-based position of the first one, 0 if none."""
    pieces_between = F.size(F.split(text, re.escape(phrase), -1)) - 1
    return F.struct(pieces_between.alias("count"), F.instr(text, phrase).alias("first"))


def code_blocks(text: Column, default_language: str = "unknown") -> Column:
    """``array<struct<language, content, lines>>`` of the fenced blocks."""
    fence = F.lit(r"(?sU)```(\w+)?\n(.*?)```")
    pairs = F.arrays_zip(
        F.regexp_extract_all(text, fence, F.lit(1)).alias("language"),
        F.regexp_extract_all(text, fence, F.lit(2)).alias("content"),
    )
    return F.transform(
        pairs,
        lambda p: F.struct(
            F.coalesce(_filled(p["language"]), F.lit(default_language)).alias("language"),
            strip(p["content"]).alias("content"),
            F.size(lines_of(strip(p["content"]))).alias("lines"),
        ),
    )


def extractive_summary(text: Column) -> Column:
    """Offline stand-in summary: the second sentence when there are more than two, else the first."""
    pick = lambda sentences: F.get(sentences, F.when(F.size(sentences) > 2, 1).otherwise(0))
    return let(F.split(text, r"\.", -1), pick)
