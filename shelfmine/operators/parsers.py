"""Structure parsers for scripts, conversations, technical documents and reports.

Every parser is a column expression over the text of one document that returns an array of sections, followed
by one explode. Parsing therefore runs in the map side, whatever the number of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmine.functions.arrays import head_positions, islands, joined, let, lines_of, strip
from shelfmine.functions.text import (
    chunk_id,
    clock_seconds,
    code_blocks,
    has_code,
    has_table_report,
    has_table_techdoc,
    pieces,
    short_hash,
)
from shelfmine.operators.chunking import Tokenizer, book_chunks, strip_boilerplate, windows
from shelfmine.operators.packing import packed_bounds
from shelfmine.operators.rows import numbered, unfolded

# Start of a scene heading.
SCENE_HEAD = r"(?iu)^(INT\.|EXT\.|INT/EXT\.|I/E\.|INT |EXT )"
# Markdown headings of level two and three.
MARKDOWN_HEAD = r"^(#{2,3})\s+(.+)$"
# A numbered heading of a plain text.
NUMBERED_HEAD = r"^(\d+\.?\d*)\s+(.+)$"
# Report section keywords in order of precedence.
REPORT_KEYWORDS = (
    "executive summary", "introduction", "background", "methodology", "methods", "approach", "results", "findings",
    "analysis", "discussion", "conclusion", "recommendations", "appendix", "references",
)
# Spoken-turn line formats, first match wins.
TURN_PATTERNS = (
    r"^\s*\[(\d{1,2}/\d{1,2}/\d{2,4},\s*\d{1,2}:\s*\d{2}(?::\s*\d{2})?\s*(?:[ap]m)?)\]\s*([^:\[\]]+?):\s*(.+)$",
    r"^\s*\[(\d{2}:\d{2}:\d{2})\]\s*([^:\[\]]+?):\s*(.+)$",
    r"^([^(]+?)\s*\((\d{2}:\d{2})\):\s*(.+)$",
    r"^([^:]+?):\s+(.+)$",
    r"^([^>]+?)>\s*(.+)$",
)
TIMED_PATTERNS = 3
DOC_TYPES = ("book", "script", "conversation", "tech_doc", "report")
# Unicode classes and "\n" as the only line end
FLAGS = "(?dU)"


def _text_of(body: Column) -> Column:
    return strip(joined(body))


# ---------------------------------------------------------------- scripts


def script_scenes(text: Column) -> Column:
    """``array<struct<scene_number, heading, text>>``; a heading with no line after it is not a scene."""
    cut = islands(lines_of(text), lambda line: strip(line).rlike(SCENE_HEAD))
    kept = F.filter(cut, lambda s: F.size(s["body"]) > 0)
    return F.transform(
        kept,
        lambda s, i: F.struct(
            (i + 1).alias("scene_number"), strip(s["head"]).alias("heading"), _text_of(s["body"]).alias("text")
        ),
    )


def script_chunks(documents: DataFrame, slug: str = "slug", text: str = "text", tokenizer: Tokenizer = pieces) -> DataFrame:
    """One chunk per scene: numbered heading, blank line, body."""
    scenes = unfolded(documents, script_scenes(F.col(text)), "scene_number", F.col(slug).alias("slug"))
    full = F.concat_ws(
        "\n", F.concat(F.lit("SCENE "), F.col("scene_number"), F.lit(": "), F.col("heading")), F.lit(""), F.col("text")
    )
    return scenes.select("slug", "scene_number", "heading", full.alias("text")).select(
        chunk_id(F.col("slug"), F.col("scene_number"), F.lit(1), F.col("text")).alias("chunk_id"),
        "slug",
        F.col("scene_number").alias("section"),
        F.lit(1).alias("chunk"),
        "text",
        short_hash(F.col("text")).alias("hash"),
        F.size(tokenizer(F.col("text"))).alias("num_tokens"),
        F.length("text").alias("num_chars"),
        "heading",
    )


def scenes_with(scenes: DataFrame, keyword: str) -> DataFrame:
    """Scenes whose heading or text contains the keyword, ignoring case."""
    needle = keyword.lower()
    return scenes.where(F.lower("heading").contains(needle) | F.lower("text").contains(needle))


# ---------------------------------------------------------------- conversations


def _turn_start(line: Column) -> Column:
    """``struct<speaker, timestamp, text>`` of a line that opens a turn, else null. The first format wins."""

    def timed(groups: Column) -> Column:
        time_first = groups[0].contains(":") & (F.length(groups[0]) > 5)
        return F.struct(
            strip(F.when(time_first, groups[1]).otherwise(groups[0])).alias("speaker"),
            F.when(time_first, groups[0]).otherwise(groups[1]).alias("timestamp"),
            groups[2].alias("text"),
        )

    def untimed(groups: Column) -> Column:
        return F.struct(
            strip(groups[0]).alias("speaker"), F.lit(None).cast("string").alias("timestamp"), groups[1].alias("text")
        )

    result = F.lit(None)
    for i in reversed(range(len(TURN_PATTERNS))):
        pattern = FLAGS + TURN_PATTERNS[i]
        count, build = (3, timed) if i < TIMED_PATTERNS else (2, untimed)
        groups = F.array(*[F.regexp_extract(line, pattern, n + 1) for n in range(count)])
        result = F.when(line.rlike(pattern), let(groups, build)).otherwise(result)
    return result


def conversation_turns(text: Column) -> Column:
    """``array<struct<turn, speaker, timestamp, text>>``; unmatched lines continue the open turn.

    Every line is matched once; a turn reaches from its opening line to the next one.
    """
    lines = F.filter(F.transform(lines_of(text), strip), lambda line: line != "")

    def build(all_lines: Column, starts: Column) -> Column:
        opening = F.filter(
            F.transform(starts, lambda start, i: F.when(start.isNotNull(), i + 1).otherwise(F.lit(0))),
            lambda position: position > 0,
        )

        def turn(heads: Column, at: Column, j: Column) -> Column:
            past = F.coalesce(F.get(heads, j + 1), F.size(all_lines) + 1)
            said = F.concat(F.array(F.get(starts, at - 1)["text"]), F.slice(all_lines, at + 1, past - at - 1))
            return F.struct(
                (j + 1).alias("turn"),
                F.get(starts, at - 1)["speaker"].alias("speaker"),
                F.get(starts, at - 1)["timestamp"].alias("timestamp"),
                strip(joined(said)).alias("text"),
            )

        return let(opening, lambda heads: F.transform(heads, lambda at, j: turn(heads, at, j)))

    return let(lines, lambda all_lines: let(F.transform(all_lines, _turn_start), lambda starts: build(all_lines, starts)))


def rendered_turn(speaker: Column, timestamp: Column, text: Column) -> Column:
    """``Speaker (time): text``, without the time when there is none."""
    said_at = F.coalesce(F.concat(F.lit(" ("), F.nullif(timestamp, F.lit("")), F.lit(")")), F.lit(""))
    return F.concat(speaker, said_at, F.lit(": "), text)


def conversation_chunks(
    documents: DataFrame,
    slug: str = "slug",
    text: str = "text",
    max_tokens: int = 500,
    overlap_turns: int = 2,
    tokenizer: Tokenizer = pieces,
) -> DataFrame:
    """Turns packed into chunks of at most ``max_tokens``, the last turns of a chunk repeated in the next one."""
    turns = documents.select(F.col(slug).alias("slug"), conversation_turns(F.col(text)).alias("turns"))
    counts = F.transform("turns", lambda t: F.size(tokenizer(t["text"])))
    packed = turns.select("slug", "turns", packed_bounds(counts, max_tokens, overlap_turns).alias("bounds"))
    groups = F.transform(
        "bounds",
        lambda b, i: F.struct(
            (i + 1).alias("section"),
            F.slice("turns", b["first"] + 1, b["past"] - b["first"]).alias("own"),
            b["tokens"].alias("num_tokens"),
        ),
    )
    cut = unfolded(packed, groups, "section", "slug")
    body = F.array_join(F.transform("own", lambda t: rendered_turn(t["speaker"], t["timestamp"], t["text"])), "\n")
    return cut.select("slug", "section", "own", "num_tokens", body.alias("text")).select(
        chunk_id(F.col("slug"), F.col("section"), F.lit(1), F.col("text")).alias("chunk_id"),
        "slug",
        "section",
        F.lit(1).alias("chunk"),
        "text",
        short_hash(F.col("text")).alias("hash"),
        F.col("num_tokens").cast("int").alias("num_tokens"),
        F.length("text").alias("num_chars"),
        F.get("own", F.lit(0))["turn"].alias("turn_start"),
        F.element_at("own", -1)["turn"].alias("turn_end"),
        F.array_sort(F.array_distinct(F.transform("own", lambda t: t["speaker"]))).alias("speakers"),
        F.get("own", F.lit(0))["timestamp"].alias("timestamp_start"),
        F.element_at("own", -1)["timestamp"].alias("timestamp_end"),
        F.size("own").alias("num_turns"),
    )


def conversation_metadata(documents: DataFrame, slug: str = "slug", text: str = "text") -> DataFrame:
    """Participants, turn count and duration of each conversation; texts without a turn give no row."""

    def summary(turns: Column) -> Column:
        people = F.array_sort(F.array_distinct(F.transform(turns, lambda t: t["speaker"])))
        stamps = F.filter(F.transform(turns, lambda t: t["timestamp"]), lambda s: s.isNotNull() & (s != ""))
        seconds = clock_seconds(F.element_at(stamps, -1)) - clock_seconds(F.get(stamps, F.lit(0)))
        return F.struct(
            people.alias("participants"),
            F.size(people).alias("num_participants"),
            F.size(turns).alias("num_turns"),
            (F.size(stamps) > 0).alias("has_timestamps"),
            F.when(F.size(stamps) >= 2, seconds).alias("duration_seconds"),
        )

    one = let(conversation_turns(F.col(text)), lambda turns: F.when(F.size(turns) > 0, F.array(summary(turns))))
    return unfolded(documents, one, "num_turns", F.col(slug).alias("slug"))


def strict_turns(text: Column, timed: bool = False) -> Column:
    """Exploratory turn parse: one strict pattern, all other lines ignored."""
    pattern = r"^\[(\d{2}:\d{2}:\d{2})\]\s*([^:]+):\s*(.+)$" if timed else r"^([A-Z][a-zA-Z\s]+):\s*(.+)$"
    offset = 1 if timed else 0
    hits = F.filter(F.transform(lines_of(text), strip), lambda line: line.rlike(FLAGS + pattern))
    return F.transform(
        hits,
        lambda line, i: F.struct(
            (i + 1).alias("turn"),
            F.regexp_extract(line, FLAGS + pattern, 1 + offset).alias("speaker"),
            (F.regexp_extract(line, FLAGS + pattern, 1) if timed else F.lit(None).cast("string")).alias("timestamp"),
            F.regexp_extract(line, FLAGS + pattern, 2 + offset).alias("text"),
        ),
    )


# ---------------------------------------------------------------- technical documents and reports


def markdown_sections(text: Column) -> Column:
    """``array<struct<section, heading, text>>`` of the second and third level headings."""
    pattern = FLAGS + MARKDOWN_HEAD
    return F.transform(
        islands(lines_of(text), lambda line: line.rlike(pattern)),
        lambda s, i: F.struct(
            (i + 1).cast("string").alias("section"),
            strip(F.regexp_extract(s["head"], pattern, 2)).alias("heading"),
            _text_of(s["body"]).alias("text"),
        ),
    )


def numbered_sections(text: Column) -> Column:
    """Sections under numbered headings shorter than 100 characters; the whole text when there is none."""
    pattern = FLAGS + NUMBERED_HEAD
    cut = islands(lines_of(text), lambda line: strip(line).rlike(pattern) & (F.length(strip(line)) < 100))
    found = F.transform(
        cut,
        lambda s: F.struct(
            F.regexp_extract(strip(s["head"]), pattern, 1).alias("section"),
            strip(F.regexp_extract(strip(s["head"]), pattern, 2)).alias("heading"),
            _text_of(s["body"]).alias("text"),
        ),
    )
    whole = F.array(F.struct(F.lit("1").alias("section"), F.lit("Document").alias("heading"), text.alias("text")))
    return let(found, lambda sections: F.when(F.size(sections) > 0, sections).otherwise(whole))


def is_markdown(text: Column, suffix: Column) -> Column:
    return (F.lower(suffix) == ".md") | text.contains("```")


def techdoc_sections(text: Column, suffix: Column) -> Column:
    return F.when(is_markdown(text, suffix), markdown_sections(text)).otherwise(numbered_sections(text))


def all_level_sections(text: Column) -> Column:
    """Exploratory variant: every line that starts with ``#`` opens a section, its level is the number of ``#``.

    Text before the first heading belongs to the first section.
    """

    def build(lines: Column) -> Column:
        first = F.get(head_positions(lines, lambda line: line.startswith("#")), F.lit(0))
        return F.transform(
            islands(lines, lambda line: line.startswith("#")),
            lambda s, i: F.struct(
                (i + 1).alias("section"),
                F.length(F.regexp_extract(s["head"], "^#+", 0)).alias("level"),
                strip(F.regexp_replace(s["head"], "^#+", "")).alias("heading"),
                joined(
                    F.when(i == 0, F.concat(F.slice(lines, F.lit(1), first - 1), s["body"])).otherwise(s["body"])
                ).alias("text"),
            ),
        )

    return let(lines_of(text), build)


def _report_keyword(line: Column) -> Column:
    """First keyword, in list order, found in a line of fewer than 100 characters."""
    low = F.lower(strip(line))
    hit = F.lit(None).cast("string")
    for word in reversed(REPORT_KEYWORDS):
        hit = F.when(low.contains(word), F.lit(word.replace(" ", "_"))).otherwise(hit)
    return F.when(F.length(strip(line)) < 100, hit)


def report_sections(text: Column) -> Column:
    """``array<struct<section_type, heading, text>>``; a heading with no line after it is dropped."""
    cut = F.filter(
        islands(lines_of(text), lambda line: _report_keyword(line).isNotNull()), lambda s: F.size(s["body"]) > 0
    )
    found = F.transform(
        cut,
        lambda s: F.struct(
            _report_keyword(s["head"]).alias("section_type"),
            strip(s["head"]).alias("heading"),
            _text_of(s["body"]).alias("text"),
        ),
    )
    whole = F.array(
        F.struct(
            F.lit("full_document").alias("section_type"), F.lit("Full Report").alias("heading"), text.alias("text")
        )
    )
    return let(found, lambda sections: F.when(F.size(sections) > 0, sections).otherwise(whole))


def _whole_or_windows(
    sections: DataFrame, whole_text: Column, whole_hash_of: Column, max_tokens: int, overlap: int, tokenizer: Tokenizer
) -> DataFrame:
    """One chunk for a section that fits, else token windows marked as partial."""
    counted = sections.withColumn("_tokens", tokenizer(F.col("text")))
    one = F.array(
        F.struct(
            F.lit(1).alias("chunk"),
            whole_text.alias("body"),
            short_hash(whole_hash_of).alias("hash"),
            F.size("_tokens").alias("num_tokens"),
            F.length(whole_hash_of).alias("num_chars"),
            F.lit(False).alias("is_partial"),
        )
    )
    many = F.transform(
        windows(F.col("_tokens"), max_tokens, overlap),
        lambda w: F.struct(
            w["chunk"].alias("chunk"),
            w["text"].alias("body"),
            short_hash(w["text"]).alias("hash"),
            w["num_tokens"].alias("num_tokens"),
            F.length(w["text"]).alias("num_chars"),
            F.lit(True).alias("is_partial"),
        ),
    )
    keep = [c for c in sections.columns if c != "text"]
    cut = unfolded(counted, F.when(F.size("_tokens") <= max_tokens, one).otherwise(many), "chunk", *keep)
    identifier = F.format_string("%s_%02d_%03d_%s", F.col("slug"), F.col("ordinal"), F.col("chunk"), F.col("hash"))
    return cut.select(identifier.alias("chunk_id"), *keep, "chunk", F.col("body").alias("text"), "hash", "num_tokens",
                      "num_chars", "is_partial")


def techdoc_chunks(
    documents: DataFrame,
    slug: str = "slug",
    text: str = "text",
    suffix: str | None = None,
    max_tokens: int = 800,
    overlap: int = 50,
    tokenizer: Tokenizer = pieces,
) -> DataFrame:
    """Section chunks of technical documents; hash and length of a whole section leave out its heading."""
    ending = F.col(suffix) if suffix else F.lit(".md")
    sections = numbered(
        documents, techdoc_sections(F.col(text), ending), "_i", "_s", F.col(slug).alias("slug")
    ).select(
        "slug",
        (F.col("_i") + 1).alias("ordinal"),
        "_s.*",
        has_code(F.col("_s.text")).alias("has_code"),
        has_table_techdoc(F.col("_s.text")).alias("has_table"),
    )
    full = F.concat(F.lit("## "), F.col("heading"), F.lit("\n\n"), F.col("text"))
    return _whole_or_windows(sections, full, F.col("text"), max_tokens, overlap, tokenizer)


def report_chunks(
    documents: DataFrame,
    slug: str = "slug",
    text: str = "text",
    max_tokens: int = 700,
    overlap: int = 50,
    tokenizer: Tokenizer = pieces,
) -> DataFrame:
    """Section chunks of reports; hash and length of a whole section include its heading."""
    sections = numbered(
        documents, report_sections(F.col(text)), "_i", "_s", F.col(slug).alias("slug")
    ).select("slug", (F.col("_i") + 1).alias("ordinal"), "_s.*", has_table_report(F.col("_s.text")).alias("has_table"))
    full = F.concat(F.col("heading"), F.lit("\n\n"), F.col("text"))
    return _whole_or_windows(sections, full, full, max_tokens, overlap, tokenizer)


def code_assets(documents: DataFrame, slug: str = "slug", text: str = "text") -> DataFrame:
    """Fenced code blocks of each document."""
    return numbered(documents, code_blocks(F.col(text)), "_i", "_b", F.col(slug).alias("slug")).select(
        "slug", (F.col("_i") + 1).alias("ordinal"), F.lit("code").alias("asset_type"), "_b.*"
    )


# ---------------------------------------------------------------- document-level metadata


def document_metadata(documents: DataFrame, doc_type: str, slug: str = "slug", text: str = "text") -> DataFrame:
    """Document-level roll-up of each type, computed inside the row of the document."""
    body = F.col(text)
    head = F.col(slug).alias("slug")
    if doc_type == "conversation":
        return conversation_metadata(documents, slug, text)
    if doc_type == "book":
        return documents.select(head, strip_boilerplate(body, trim=True).alias("_t")).select(
            "slug",
            F.length("_t").alias("total_chars"),
            F.size(F.regexp_extract_all("_t", F.lit(r"(?U)\S+"), F.lit(0))).alias("total_words"),
        )
    sections = {
        "script": script_scenes,
        "tech_doc": lambda t: techdoc_sections(t, F.lit(".md")),
        "report": report_sections,
    }
    if doc_type not in sections:
        raise ValueError(f"unsupported document type: {doc_type}")
    parsed = documents.select(head, sections[doc_type](body).alias("_s"))
    headings = F.slice(F.transform("_s", lambda s: s["heading"]), 1, 10)
    if doc_type == "script":
        return parsed.select("slug", F.size("_s").alias("num_scenes"), headings.alias("scene_headings"))
    if doc_type == "tech_doc":
        return parsed.select(
            "slug",
            F.size("_s").alias("num_sections"),
            F.exists("_s", lambda s: has_code(s["text"])).alias("has_code"),
            F.exists("_s", lambda s: has_table_techdoc(s["text"])).alias("has_tables"),
            headings.alias("section_headings"),
        )
    kinds = F.array_sort(F.array_distinct(F.transform("_s", lambda s: s["section_type"])))
    return parsed.select(
        "slug",
        F.size("_s").alias("num_sections"),
        kinds.alias("section_types"),
        F.array_contains(kinds, "executive_summary").alias("has_executive_summary"),
        F.exists("_s", lambda s: has_table_report(s["text"])).alias("has_tables"),
    )


CHUNKERS = {
    "book": lambda docs, n, overlap: book_chunks(docs, max_tokens=n, overlap=overlap),
    "script": lambda docs, n, overlap: script_chunks(docs),
    "conversation": lambda docs, n, overlap: conversation_chunks(docs, max_tokens=n),
    "tech_doc": lambda docs, n, overlap: techdoc_chunks(docs, max_tokens=n, overlap=overlap),
    "report": lambda docs, n, overlap: report_chunks(docs, max_tokens=n, overlap=overlap),
}


def chunker_for(doc_type: str):
    if doc_type not in CHUNKERS:
        raise ValueError(f"unsupported document type: {doc_type}")
    return CHUNKERS[doc_type]


def chunks_of_all_types(documents: DataFrame, max_tokens: int = 500, overlap: int = 100) -> DataFrame:
    """``(slug, doc_type, text)`` documents of any mix of types to one chunk table."""
    out = None
    for doc_type in DOC_TYPES:
        part = chunker_for(doc_type)(documents.where(F.col("doc_type") == doc_type), max_tokens, overlap)
        if "ordinal" in part.columns:
            part = part.withColumn("label", F.col("section")) if "section" in part.columns else part
            part = part.withColumn("section", F.col("ordinal")).drop("ordinal")
        part = part.withColumn("doc_type", F.lit(doc_type))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
