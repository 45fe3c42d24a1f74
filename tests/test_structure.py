import random

import pytest
from pyspark.sql import functions as F

from shelfmine.operators import chunking, diversify, packing, parsers
from shelfmine.operators.rows import unfolded


def docs(spark, text):
    return spark.createDataFrame([("s", text)], "slug string, text string")


def test_window_tail_lies_inside_its_predecessor(spark):
    text = " ".join(str(i) for i in range(900))
    rows = chunking.section_chunks(docs(spark, text).withColumn("section", F.lit(1))).orderBy("chunk").collect()
    assert [r["num_tokens"] for r in rows] == [500, 500, 100]
    assert rows[1]["text"].startswith(" 400") and rows[2]["text"].split()[0] == "800"
    assert chunking.section_chunks(docs(spark, "").withColumn("section", F.lit(1))).count() == 0


def test_boilerplate_needs_both_markers(spark):
    keep = lambda t: docs(spark, t).select(chunking.strip_boilerplate(F.col("text"), True).alias("x")).first()["x"]
    assert keep("x\n*** START OF A ***\nbody\n*** END OF A ***\ny") == "body"
    assert keep("x\n*** START OF A ***\nbody") == "x\n*** START OF A ***\nbody"


def test_reader_keeps_front_matter_as_section_one(spark):
    text = "front\nCHAPTER I.\n\none\nChapter II.\ntwo"
    rows = chunking.book_chunks(docs(spark, text)).orderBy("section").collect()
    assert [(r["section"], r["text"]) for r in rows] == [(1, "front"), (2, "one"), (3, "two")]


def test_book_parser_numbers_after_dropping_blanks(spark):
    rows = unfolded(docs(spark, "CHAPTER I.\n\none\nmore\nChapter 2\ntwo"), chunking.book_sections(F.col("text")), "section").collect()
    assert [(r["section"], r["title"]) for r in rows] == [(1, "one"), (2, "two")]


def test_scene_without_lines_is_dropped(spark):
    text = "lost\nINT. A\nEXT. B\nline\n\nint/ext. c\n\n"
    rows = unfolded(docs(spark, text), parsers.script_scenes(F.col("text")), "scene_number").collect()
    assert [(r["scene_number"], r["heading"], r["text"]) for r in rows] == [(1, "EXT. B", "line"), (2, "int/ext. c", "")]


TURN_LINES = [
    ("[29/5/2024, 10:52:23 am] John: hi", ("John", "29/5/2024, 10:52:23 am", "hi")),
    ("  [1/12/23, 9: 05] Mary Ann: yes: no", ("Mary Ann", "1/12/23, 9: 05", "yes: no")),
    ("[00:12:34] Alice: hello", ("Alice", "00:12:34", "hello")),
    ("Alice (14:30): hello", ("Alice", "14:30", "hello")),
    ("Bob: plain", ("Bob", None, "plain")),
    ("Carl> chat", ("Carl", None, "chat")),
]


@pytest.mark.parametrize("line, want", TURN_LINES)
def test_turn_formats(spark, line, want):
    row = unfolded(docs(spark, line), parsers.conversation_turns(F.col("text")), "turn").first()
    assert (row["speaker"], row["timestamp"], row["text"]) == want


def test_unmatched_lines_continue_the_turn(spark):
    rows = unfolded(docs(spark, "title\nBob: one\n\ntwo\nAnn: x"), parsers.conversation_turns(F.col("text")), "turn").collect()
    assert [(r["speaker"], r["text"]) for r in rows] == [("Bob", "one\ntwo"), ("Ann", "x")]


def test_duration_of_a_conversation(spark):
    row = parsers.conversation_metadata(docs(spark, "[00:00:10] A: x\n[00:01:40] B: y")).first()
    assert (row["duration_seconds"], row["num_participants"], row["has_timestamps"]) == (90, 2, True)


def test_markdown_and_numbered_sections(spark):
    md = unfolded(docs(spark, "pre\n# top\n## One\na\n### Two\n#### deep\nb"), parsers.markdown_sections(F.col("text")), "section").collect()
    assert [(r["section"], r["heading"], r["text"]) for r in md] == [("1", "One", "a"), ("2", "Two", "#### deep\nb")]
    num = unfolded(docs(spark, "1.2 First\nx\n3 Second\ny"), parsers.numbered_sections(F.col("text")), "section").collect()
    assert [(r["section"], r["heading"]) for r in num] == [("1.2", "First"), ("3", "Second")]
    whole = unfolded(docs(spark, "just text"), parsers.numbered_sections(F.col("text")), "section").first()
    assert (whole["section"], whole["heading"], whole["text"]) == ("1", "Document", "just text")


def test_report_keyword_precedence_and_default(spark):
    rows = unfolded(docs(spark, "Results and Background\nx\nAPPENDIX\nReferences\ny"), parsers.report_sections(F.col("text")), "heading").collect()
    assert [(r["section_type"], r["heading"]) for r in rows] == [("background", "Results and Background"), ("references", "References")]
    whole = unfolded(docs(spark, "zzz"), parsers.report_sections(F.col("text")), "heading").first()
    assert whole["section_type"] == "full_document"


def test_unknown_document_type():
    with pytest.raises(ValueError):
        parsers.chunker_for("poem")


# ---------------------------------------------------------------- packing


def expected_bounds(tokens, limit, overlap):
    out, start = [], 0
    while start < len(tokens):
        end, total = start, 0
        while end < len(tokens) and (end == start or total + tokens[end] <= limit):
            total += tokens[end]
            end += 1
        out.append((start, end, total))
        start = max(start + 1, end - overlap)
    return out


def test_small_turns_repeat_their_tail(spark):
    assert [(b["first"], b["past"]) for b in packing._bounds(__import__("numpy").array([1] * 10), 500, 2)] == [(0, 10), (8, 10), (9, 10)]


@pytest.mark.parametrize("route", [0, 1000])
@pytest.mark.parametrize("seed", [1, 2])
def test_packing_routes_match_brute_force(spark, route, seed):
    rng = random.Random(seed)
    conversations = {c: [rng.choice([0, 0, 3, 7, 20, 90]) for _ in range(rng.randint(1, 40))] for c in range(4)}
    rows = [(c, 10 + 3 * i, t, f"{c}-{i}") for c, tokens in conversations.items() for i, t in enumerate(tokens)]
    turns = spark.createDataFrame(rows, "c long, turn long, tok int, line string")
    got = packing.pack_turns(turns, "c", "turn", "tok", "line", 30, 2, row_turns=route).collect()
    for c, tokens in conversations.items():
        want = [
            (n, 10 + 3 * s, 10 + 3 * (e - 1), e - s, total, "\n".join(f"{c}-{i}" for i in range(s, e)))
            for n, (s, e, total) in enumerate(expected_bounds(tokens, 30, 2), 1)
        ]
        mine = sorted(tuple(r[1:]) for r in got if r["c"] == c)
        assert mine == want


def test_history_keeps_head_and_newest(spark):
    rows = [(1, 0, "system", 10)] + [(1, i, "user", 10) for i in range(1, 6)] + [(2, 0, "user", 999)]
    frame = spark.createDataFrame(rows, "c int, turn int, role string, tok int")
    kept = packing.kept_history(frame, "c", "turn", F.col("tok"), F.col("role") == "system", budget=35).collect()
    assert sorted((r["c"], r["turn"]) for r in kept) == [(1, 0), (1, 4), (1, 5), (2, 0)]


# ---------------------------------------------------------------- diversification


def spread(spark, rows, **options):
    frame = spark.createDataFrame([(0, *r) for r in rows], "qid int, rank int, speaker string, at string")
    timed = frame.withColumn("ts", F.col("at").cast("timestamp_ntz"))
    return [r["rank"] for r in diversify.diversify(timed, **options).orderBy("position").collect()]


def minute(i):
    return f"2024-01-01 {10 + i // 60:02d}:{i % 60:02d}:00"


def test_gap_between_selected(spark):
    assert spread(spark, [(i, None, minute(i)) for i in range(1, 11)]) == [1, 6]


def test_speaker_limit_and_small_lists(spark):
    rows = [(i, "A" if i <= 8 else "B", minute(10 * i)) for i in range(1, 11)]
    assert spread(spark, rows) == [1, 2, 9, 10]
    assert spread(spark, [(1, "A", None), (2, "A", None), (3, "A", None)]) == [1, 2, 3]


def test_target_and_missing_times(spark):
    assert spread(spark, [(i, None, minute(10 * i)) for i in range(1, 21)]) == list(range(1, 11))
    assert spread(spark, [(i, None, None) for i in range(1, 9)]) == [1, 2, 3, 4, 5]


def test_rejected_row_uses_quota_and_untimed_row_resets_time(spark):
    rows = [(1, "A", minute(0)), (2, "A", minute(1)), (3, "A", minute(20)), (4, "B", minute(30))]
    assert spread(spark, rows) == [1, 4]


def test_speaker_cap_keeps_unnamed(spark):
    frame = spark.createDataFrame([(0, i, s) for i, s in enumerate(["A", "A", "A", None, None, None, ""], 1)], "qid int, rank int, speaker string")
    assert sorted(r["rank"] for r in diversify.speaker_cap(frame).collect()) == [1, 2, 4, 5, 6, 7]
