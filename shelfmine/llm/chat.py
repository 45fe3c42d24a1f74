"""Chat formatting: records of several layouts become canonical turns, turns become one marked-up text.

Everything is column expressions. The layout of a record is recognised by the hash of its nested field paths, which
selects a declarative mapping; a mapping names the places of the turns, it holds no code.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mapping:
    """Layout of a record.

    ``paths`` are its nested field paths, ``[]`` stands for the items of an array. Either ``turns`` names an array
    whose items hold ``role`` and ``text``, or ``fields`` lists (role, path) of single texts. ``roles`` renames roles.
    Texts of the same role in a row are joined by a blank line, empty ones are left out, if ``join`` is set.
    """

    name: str
    paths: tuple[str, ...]
    turns: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)
    join: bool = False


# Layouts in public use.
MAPPINGS = (
    Mapping("messages", ("messages[].content", "messages[].role"), turns="messages", role="role", text="content"),
    Mapping("messages_named", ("id", "messages[].content", "messages[].role"), turns="messages", role="role", text="content"),
    Mapping(
        "from_value",
        ("conversations[].from", "conversations[].value"),
        turns="conversations",
        role="from",
        text="value",
        roles={"human": "user", "gpt": "assistant"},
    ),
    Mapping("prompt_completion", ("completion", "prompt"), fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt_response", ("prompt", "response"), fields=(("user", "prompt"), ("assistant", "response"))),
    Mapping(
        "instruction",
        ("input", "instruction", "output"),
        fields=(("user", "instruction"), ("user", "input"), ("assistant", "output")),
        join=True,
    ),
    Mapping("instruction_only", ("instruction", "output"), fields=(("user", "instruction"), ("assistant", "output"))),
    Mapping("question_answer", ("answer", "question"), fields=(("user", "question"), ("assistant", "answer"))),
    Mapping(
        "system_question_answer",
        ("question", "response", "system_prompt"),
        fields=(("system", "system_prompt"), ("user", "question"), ("assistant", "response")),
    ),
)


@dataclass(frozen=True)
class Template:
    """Marks around turns. Inside roles and texts, ``escape`` goes after the first character of every control string
    and before every ``escape``, so no control string is left in them and the change can be undone."""

    start: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    escape: str = "\\"
    trained_roles: tuple[str, ...] = ("assistant",)
    # Control strings of public chat templates, which a tokenizer may give a meaning of its own.
    others: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|user|>", "<|assistant|>", "<|system|>")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.start, self.middle, self.end, *self.others)

    def escaped(self, text: Column) -> Column:
        mark = re.escape(self.escape)
        twice = F.regexp_replace(text, mark, mark * 2)
        wanted = "|".join(f"{_java(c[0])}(?={_java(c[1:])})" for c in self.controls)
        return F.regexp_replace(twice, f"({wanted})", f"$1{mark}")

    def restored(self, text: Column) -> Column:
        return F.regexp_replace(text, f"(?s){re.escape(self.escape)}(.)", "$1")


def _java(text: str) -> str:
    """Regular expression that matches the text itself."""
    return re.sub(r"([^\w\s])", r"\\\1", text)


def field_paths(record: Column) -> Column:
    """Sorted, distinct nested field paths of a JSON record, from the schema of its variant form.

    Types do not count, so a null or a number in place of a text leaves the paths as they are.
    """
    schema = F.schema_of_variant(F.try_parse_json(record))
    # the schema text, cut into names and brackets; a stack of open names is folded along it
    parts = F.regexp_extract_all(schema, F.lit(r"(OBJECT<|ARRAY<|>|,|`[^`]*`:|\w+:|\w+(?:\([^)]*\))?)"), F.lit(1))
    empty = F.struct(
        F.array().cast("array<string>").alias("open"),
        F.lit("").alias("name"),
        F.array().cast("array<string>").alias("out"),
    )

    def step(state: Column, part: Column) -> Column:
        open_, name, out = state["open"], state["name"], state["out"]
        above = F.coalesce(F.try_element_at(open_, F.lit(-1)), F.lit(""))
        full = F.concat(above, name)
        prefix = F.when(full == "", "").otherwise(F.concat(full, F.lit(".")))
        make = lambda o, n, x: F.struct(o.alias("open"), n.alias("name"), x.alias("out"))
        no_name = F.lit("")
        return (
            F.when(part == "OBJECT<", make(F.array_append(open_, prefix), no_name, out))
            .when(part == "ARRAY<", make(F.array_append(open_, F.concat(full, F.lit("[]"))), no_name, out))
            .when(part == ">", make(F.slice(open_, F.lit(1), F.size(open_) - 1), no_name, out))
            .when(part == ",", make(open_, no_name, out))
            .when(part.endswith(":"), make(open_, F.regexp_replace(part, "[`:]", ""), out))
            .otherwise(make(open_, no_name, F.array_append(out, full)))
        )

    return F.array_sort(F.array_distinct(F.aggregate(parts, empty, step, lambda s: s["out"])))


def fingerprint(paths: Column) -> Column:
    """64-bit hash of the field paths."""
    return F.xxhash64(F.array_join(paths, "\n"))


TURNS = "array<struct<role:string,text:string>>"


def _of_mapping(record: Column, m: Mapping) -> Column:
    """Canonical turns of a record of this layout."""
    value = F.try_parse_json(record)
    get = lambda path, kind="string": F.try_variant_get(value, f"$.{path}", kind)
    if m.turns:
        items = F.from_json(F.get_json_object(record, f"$.{m.turns}"), f"array<struct<`{m.role}`:string,`{m.text}`:string>>")
        turns = F.transform(items, lambda x: _turn(x[m.role], x[m.text]))
    else:
        turns = F.array(*(_turn(F.lit(role), get(path)) for role, path in m.fields))
    if m.roles:
        known = F.create_map(*(F.lit(x) for pair in m.roles.items() for x in pair))
        turns = F.transform(turns, lambda x: _turn(F.coalesce(F.try_element_at(known, x["role"]), x["role"]), x["text"]))
    if m.join:
        turns = F.filter(turns, lambda x: (x["text"] != "") | (x["role"] != "user"))
        turns = F.aggregate(
            turns,
            F.array().cast(TURNS),
            lambda done, x: F.when(
                (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["role"] == x["role"]),
                F.array_append(
                    F.slice(done, F.lit(1), F.size(done) - 1),
                    _turn(x["role"], F.concat(F.try_element_at(done, F.lit(-1))["text"], F.lit("\n\n"), x["text"])),
                ),
            ).otherwise(F.array_append(done, x)),
        )
    return turns.cast(TURNS)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def canonical(records: DataFrame, record_col: str = "record", mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """Adds ``layout`` (name of the mapping, null if none fits) and ``turns`` (null then).

    Two mappings of one fingerprint are an error. Null records and text that is not JSON have no layout.
    """
    prints = [F.xxhash64(F.lit("\n".join(sorted(m.paths)))) for m in mappings]
    if len({tuple(sorted(m.paths)) for m in mappings}) < len(mappings):
        raise ValueError("two mappings have the same field paths")
    record = records[record_col]
    read = records.withColumn("fingerprint", fingerprint(field_paths(record)))
    layout = turns = F.lit(None)
    for m, own in zip(mappings, prints):
        fits = F.col("fingerprint") == own
        layout = F.when(fits, F.lit(m.name)).otherwise(layout)
        turns = F.when(fits, _of_mapping(record, m)).otherwise(turns)
    return read.withColumns({"layout": layout.cast("string"), "turns": turns.cast(TURNS)})


def formatted(turns: Column, template: Template = Template()) -> Column:
    """One marked-up text of the turns."""
    one = lambda x: F.concat(
        F.lit(template.start), template.escaped(x["role"]), F.lit(template.middle), template.escaped(x["text"]), F.lit(template.end)
    )
    return F.array_join(F.transform(turns, one), "")


def read_back(text: Column, template: Template = Template()) -> Column:
    """Turns of a marked-up text, each with its place: ``(role, text, start, length)`` in code points, from 0, of the
    escaped text between the marks; undone escapes in ``role`` and ``text``."""
    size = lambda s: F.lit(len(s))
    # every turn ends with the end mark, so what follows the last one is empty
    parts = F.split(text, _java(template.end))
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<role:string,text:string,start:int,length:int>>").alias("out"))

    def step(state: Column, part: Column) -> Column:
        sides = F.split(F.substr(part, size(template.start) + 1), _java(template.middle))
        role, body = sides[0], sides[1]
        start = state["at"] + size(template.start) + F.length(role) + size(template.middle)
        turn = F.struct(
            template.restored(role).alias("role"),
            template.restored(body).alias("text"),
            start.alias("start"),
            F.length(body).alias("length"),
        )
        return F.struct(
            (state["at"] + F.length(part) + size(template.end)).alias("at"), F.array_append(state["out"], turn).alias("out")
        )

    return F.aggregate(parts, empty, step, lambda s: s["out"])


def loss_spans(turns: Column, template: Template = Template()) -> Column:
    """Spans of the marked-up text that are learned from: the texts of the trained roles."""
    trained = F.filter(turns, lambda x: x["role"].isin(*template.trained_roles))
    return F.transform(trained, lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))


def format_records(
    records: DataFrame, record_col: str = "record", mappings: Sequence[Mapping] = MAPPINGS, template: Template = Template()
) -> DataFrame:
    """The rows of ``records`` with ``layout``, ``formatted`` and ``loss`` (spans under the loss mask).

    Rows are formatted each by itself: repeated rows give repeated results, an empty table an empty one. A record
    without layout gets nulls; a null role or text is empty.
    """
    known = canonical(records, record_col, mappings)
    marked = known.withColumn("formatted", formatted(F.col("turns"), template))
    return marked.withColumn("loss", loss_spans(read_back(F.col("formatted"), template), template)).drop("turns")


def turn_records(rows: DataFrame, id_col: str, order_col: str, role_col: str, text_col: str) -> DataFrame:
    """``(id, record)``: the turns of each conversation, in order, as a record of the messages layout.

    A null order comes first; turns of equal order go by role and text, repeated rows are turns of their own. Rows of
    a null id are one conversation. A conversation is one row of the result, as it is one text afterwards.
    """
    turn = F.struct(
        rows[order_col].alias("at"),
        F.coalesce(rows[role_col], F.lit("")).alias("role"),
        F.coalesce(rows[text_col], F.lit("")).alias("content"),
    )
    whole = rows.groupBy(rows[id_col].alias("id")).agg(F.array_sort(F.collect_list(turn), _in_order).alias("turns"))
    messages = F.transform("turns", lambda x: x.dropFields("at"))
    return whole.select("id", F.to_json(F.struct(messages.alias("messages"))).alias("record"))


def _in_order(a: Column, b: Column) -> Column:
    """Order of turns with nulls first."""
    less = F.lit(-1)
    more = F.lit(1)
    out = F.lit(0)
    for name in ("content", "role", "at"):
        x, y = a[name], b[name]
        out = (
            F.when(x.eqNullSafe(y), out)
            .when(x.isNull(), less)
            .when(y.isNull(), more)
            .when(x < y, less)
            .otherwise(more)
        )
    return out


def digests(marked: DataFrame, template: Template = Template()) -> DataFrame:
    """Counts and digests of the turns and of the text under the loss mask, both read back from the marked-up text."""
    back = marked.withColumn("back", read_back(F.col("formatted"), template))
    learned = F.transform(
        "loss", lambda s: template.restored(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))
    )
    told = F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    full = back.withColumns({"learned": F.array_join(learned, ""), "told": F.array_join(told, "")})
    return full.select(
        F.col("id").alias("conv_id"),
        F.size("back").cast("long").alias("n_turns"),
        F.sha2("told", 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
