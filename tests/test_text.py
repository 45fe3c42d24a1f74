import pytest
from pyspark.sql import functions as F

from shelfmine.functions import patterns as pt
from shelfmine.functions import text as tx
from shelfmine.functions.arrays import islands, run_lengths, strip
from shelfmine.operators import models
from shelfmine.plans import service


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(expression.alias("x")).first()["x"]


def test_index_terms_drop_stop_words_and_keep_unicode(spark):
    assert one(spark, tx.index_terms(F.col("t")), t="The Été of a_b, and 42!") == ["été", "a_b", "42"]


def test_run_lengths(spark):
    rows = one(spark, run_lengths(F.split("t", " ")), t="b a b c b")
    assert [(r["term"], r["tf"]) for r in rows] == [("a", 1), ("b", 3), ("c", 1)]


@pytest.mark.parametrize(
    "query, want",
    [
        ("What did the captain say about the storm?", "captain say storm"),
        ("well-known tale", "well-known tale"),
        ("who is it?", "who is it?"),
    ],
)
def test_preprocess(spark, query, want):
    assert one(spark, tx.preprocess_query(F.col("q")), q=query) == want


@pytest.mark.parametrize(
    "query, alpha", [("why so?", 0.5), ("silver lanterns", 0.8), ("a b c d e", 0.7), ("a b c d e f g h i", 0.6)]
)
def test_dynamic_alpha(spark, query, alpha):
    assert one(spark, tx.dynamic_alpha(F.col("q")), q=query) == alpha


@pytest.mark.parametrize(
    "stamp, ok",
    [("2024-01-15 10:30:45", True), ("2024-01-15 10:30", True), ("2024-01-15", True), ("", False), ("nope", False), ("2024-13-45", False)],
)
def test_timestamps(spark, stamp, ok):
    assert (one(spark, tx.parse_timestamp(F.col("s")), s=stamp) is not None) is ok


def test_chunk_identifier(spark):
    made = one(spark, tx.chunk_id(F.lit("aiw"), F.lit(3), F.lit(7), F.lit("text")))
    assert made == "aiw_03_007_1cb251e"
    assert one(spark, tx.section_label(F.col("i")), i=made) == "3"
    assert one(spark, tx.section_label(F.col("i")), i="aiw_00_1") == "0"
    assert one(spark, tx.section_label(F.col("i")), i="plain") == "?"


def test_citations(spark):
    none = F.lit(None).cast("string")
    cite = lambda speakers, speaker, heading, at: one(spark, tx.citation(F.lit("s_02_001_x"), speakers, speaker, heading, at))
    assert cite(F.array(F.lit("A"), F.lit("B")), none, none, F.lit("10:00")) == "[Speakers: A, B, Time: 10:00, Source: s_02_001_x]"
    empty = F.array().cast("array<string>")
    assert cite(empty, F.lit("A"), F.lit("H"), none) == "[Speaker: A, Source: s_02_001_x]"
    assert cite(empty, none, F.lit("Intro"), none) == "[Intro, Source: s_02_001_x]"
    assert cite(empty, none, F.lit("x" * 50), none) == "[Section 2, Source: s_02_001_x]"


def test_snippet_and_result_count(spark):
    assert one(spark, tx.snippet(F.col("t"), 3), t="abcd") == "abc..."
    assert one(spark, tx.snippet(F.col("t"), 4), t="abcd") == "abcd"
    assert one(spark, tx.result_count(F.col("t")), t="Found 12 results for x") == 12
    assert one(spark, tx.result_count(F.col("t")), t="No results found for x") == 0
    assert one(spark, tx.result_count(F.col("t")), t="?") == -1


def test_detectors(spark):
    assert one(spark, tx.has_code(F.col("t")), t="x\n```py\na\n```") is True
    assert one(spark, tx.has_code(F.col("t")), t="a class act") is True
    assert one(spark, tx.has_code(F.col("t")), t="plain") is False
    assert one(spark, tx.has_table_techdoc(F.col("t")), t="| a | b |") is True
    assert one(spark, tx.has_table_techdoc(F.col("t")), t="a | b\nc | d") is False
    assert one(spark, tx.has_table_report(F.col("t")), t="1 2 3 x") is True
    assert one(spark, tx.has_table_report(F.col("t")), t="a\tb\nc\td\ne\tf") is True


def test_strip_is_unicode_aware(spark):
    assert one(spark, strip(F.col("t")), t="   x　\n") == "x"


def test_islands_drop_text_before_first_head(spark):
    rows = one(spark, islands(F.split("t", "\n"), lambda line: line.startswith("#")), t="pre\n#a\nx\ny\n#b\n#c\nz")
    assert [(r["head"], r["body"]) for r in rows] == [("#a", ["x", "y"]), ("#b", []), ("#c", ["z"])]


PATTERNS = [
    ("CHAPTER I.", r"^CHAPTER\ [IVXLCDM]+\.(?:\s+.+)?$", "Roman numerals"),
    ("BOOK II", r"^BOOK\ [IVXLCDM]+$", "Roman numerals"),
    ("CHAPTER 2", r"^CHAPTER\ \d+$", "Arabic numerals"),
    ("Chapter 1", r"^Chapter\ \d+$", "Arabic numerals"),
    ("II.", r"^[IVXLCDM]+\.$", "bare numerals only"),
    ("I. A", r"^[IVXLCDM]+\.\ A\s+.+$", "matches lines starting with this pattern"),
    ("II. THE", r"^[IVXLCDM]+\.\ THE\s+.+$", "matches lines starting with this pattern"),
    ("THE * BOOK", r"^THE\ .+\ BOOK$", "Wildcard pattern"),
    ("CHAPTER *", r"^CHAPTER\ .+$", "Wildcard pattern"),
    ("II. *", r"^[IVXLCDM]+\.(?:\s+.+)?$", "with or without title"),
    ("III.*", r"^[IVXLCDM]+\.(?:\s+.+)?$", "with or without title"),
    ("PART I. *", r"^PART\ I\.\ .+$", "Wildcard pattern"),
    ("CHAPTER I.*", r"^CHAPTER\ [IVXLCDM]+\.(?:\s+.+)?$", "Roman numerals"),
    ("1. Title", r"^\d+\.\ Title", "start like this"),
    ("", "", "no example given"),
    ("CHAPTER", "", "has no numeral"),
    ("THE FIRST BOOK", "", "spelled-out numbers"),
    ("CHAPTER TWO", "", "put * in place"),
]


@pytest.mark.parametrize("example, pattern, note", PATTERNS)
def test_pattern_from_example(example, pattern, note):
    made, description = pt.pattern_from_example(example)
    assert made == pattern
    assert note in description or note in description.lower()


def test_pattern_check(spark):
    lines = [f"filler {i}" for i in range(100)]
    for n, at in enumerate((20, 60, 90), 1):
        lines[at] = f"BOOK {'I' * n}"
    good = one(spark, pt.pattern_check(F.col("t"), r"^BOOK\ [IVXLCDM]+$"), t="\n".join(lines) + "\n")
    assert good["ok"] and [m["line"] for m in good["matches"]] == [21, 61, 91]
    assert good["message"].startswith("3 chapters, from line 21 (BOOK I)")
    none = one(spark, pt.pattern_check(F.col("t"), "^ZZZ$"), t="\n".join(lines))
    assert not none["ok"] and "no line matches" in none["message"]
    near = one(spark, pt.pattern_check(F.col("t"), "^filler 3[12]$"), t="\n".join(lines))
    assert not near["ok"] and "too close" in near["message"]
    single = one(spark, pt.pattern_check(F.col("t"), "^BOOK I$"), t="\n".join(lines))
    assert not single["ok"] and "1 matching lines" in single["message"]


def test_assessment_parsing(spark):
    parse = lambda t: tuple(one(spark, models.parsed_assessment(F.col("t")), t=t))
    assert parse('{"score": "excellent", "reasoning": "r"}') == ("EXCELLENT", "r")
    assert parse('Well: {"score": "POOR", "reasoning": "r"} ok') == ("POOR", "r")
    assert parse("nothing") == ("NOT_JUDGED", "Could not parse assessment JSON")
    assert parse('{"score": "superb"}') == ("NOT_JUDGED", "")


@pytest.mark.parametrize(
    "given, want",
    [
        (["mam", "ili"], ["mam", "ili"]),
        ('["mam", "ili"]', ["mam", "ili"]),
        ("['mam', 'ili']", ["mam", "ili"]),
        ("mam, ili, ody", ["mam", "ili", "ody"]),
        ("[mam], [ili]", ["mam", "ili"]),
        ("mam", None),
    ],
)
def test_identifier_lists(given, want):
    assert service.identifier_list(given) == want


def test_argument_normalisation():
    got = service.normalised_arguments({"book_identifier": ["[The Iliad]"], "limit": "4"}, {"the iliad": "ili"})
    assert got == {"book_identifier": "ili", "limit": 4}


def test_provider_choice():
    choice = models.ProviderChoice(default="local")
    assert choice.choose({"local": True}) == "local"
    assert choice.choose({"local": False, "openai": True}) == "openai"
    with pytest.raises(RuntimeError):
        models.ProviderChoice(private=True).choose({"openai": True})


def test_prompt_sections_are_not_repeated():
    text = service.system_prompt(["base"], {"book": {"a": "same"}, "report": {"b": "same"}}, ["book", "report"], "- x")
    assert text == "base\n\nsame\n\nAvailable documents:\n- x"
