"""Chat formatting: records of many layouts become canonical turns, one marked-up text and a loss mask.

A layout is recognised by its fingerprint, the SHA-256 of its sorted nested field paths (``messages[].role``).
Fingerprints select declarative mappings, so adding a layout means adding an entry to ``LAYOUTS``. Everything is a
DataFrame expression; no row leaves the JVM.

Defined edge cases: null roles and texts count as empty; turns that tie in their order column are ordered by role, then
text, and repeated rows stay repeated; an empty record formats to the empty text; records whose fingerprint no mapping
knows have null turns and layout, and are returned so that a caller sees them; an empty table gives an empty table.
Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>\n"
TURNS = "array<struct<role:string,text:string>>"

#: The control strings of common chat templates, which no formatted text may hold by itself, as the first
#: character and a pattern for the rest. Backslashes between the two are the escape.
CONTROL_FIRST = r"[<\[]"
CONTROL_REST = r"(?=\||/?s>|/?INST\]|<SYS>>|</SYS>>)"


@dataclass(frozen=True)
class Layout:
    """Where a layout's turns are: a list of messages, or one field per turn.

    ``messages``: path of the list, with the names of its role and text fields. ``fields``: (role, path) for each turn.
    ``roles`` renames roles. ``paths``: all nested field paths of the layout, in any order.
    """

    name: str
    paths: tuple[str, ...]
    messages: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.paths)


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


RENAMED = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
LAYOUTS = (
    Layout("messages_text", ("messages", "messages[].role", "messages[].text"), ("messages", "role", "text")),
    Layout("messages_content", ("messages", "messages[].role", "messages[].content"), ("messages", "role", "content"), (), RENAMED),
    Layout("conversations", ("conversations", "conversations[].from", "conversations[].value"), ("conversations", "from", "value"), (), RENAMED),
    Layout("instruction", ("instruction", "output"), None, (("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", ("instruction", "input", "output"), None, (("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("system_instruction", ("system", "instruction", "output"), None, (("system", "system"), ("user", "instruction"), ("assistant", "output"))),
    Layout("prompt_completion", ("prompt", "completion"), None, (("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", ("prompt", "response"), None, (("user", "prompt"), ("assistant", "response"))),
    Layout("question_answer", ("question", "answer"), None, (("user", "question"), ("assistant", "answer"))),
    Layout("nested_data", ("data", "data.prompt", "data.response"), None, (("user", "data.prompt"), ("assistant", "data.response"))),
)


def schema_paths(kind: T.DataType, above: str = "") -> list[str]:
    """Nested field paths of a type; lists add ``[]``."""
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, above + "[]")
    if isinstance(kind, T.StructType):
        out = []
        for f in kind.fields:
            path = f"{above}.{f.name}" if above else f.name
            out += [path, *schema_paths(f.dataType, path)]
        return out
    return []


def json_paths(json: Column) -> Column:
    """Nested field paths of a JSON text, from its inferred type, folded with a stack of the open fields."""
    shape = F.schema_of_variant(F.try_parse_json(json))
    tokens = F.regexp_extract_all(shape, F.lit(r"`(?:[^`]|``)*`: |[^\s<>,`]+: |ARRAY<|OBJECT<|>"), F.lit(0))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("stack"), F.lit("").alias("at"), none.alias("paths"))

    def step(acc: Column, token: Column) -> Column:
        top = F.when(F.size(acc.stack) > 0, F.element_at(acc.stack, -1)).otherwise(F.lit(""))
        name = F.regexp_replace(token, "^`|`?: $", "")
        path = F.when(top == "", name).otherwise(F.concat(top, F.lit("."), name))
        opened = lambda below: F.struct(F.array_append(acc.stack, below).alias("stack"), below.alias("at"), acc.paths.alias("paths"))
        return (
            F.when(token == "OBJECT<", opened(acc["at"]))
            .when(token == "ARRAY<", opened(F.concat(acc["at"], F.lit("[]"))))
            .when(token == ">", F.struct(F.slice(acc.stack, 1, F.greatest(F.size(acc.stack) - 1, F.lit(0))).alias("stack"), top.alias("at"), acc.paths.alias("paths")))
            .otherwise(F.struct(acc.stack.alias("stack"), path.alias("at"), F.array_append(acc.paths, path).alias("paths")))
        )

    return F.aggregate(tokens, start, step, lambda acc: F.array_sort(F.array_distinct(acc.paths)))


def _renamed(role: Column, layout: Layout) -> Column:
    for old, new in layout.roles:
        role = F.when(role == old, F.lit(new)).otherwise(role)
    return role


def turns_of(layout: Layout, get) -> Column:
    """The layout's turns; get(path, type) gives a column of the record."""
    turn = lambda role, text: F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    if layout.messages:
        path, role, text = layout.messages
        of = get(path, f"array<struct<`{role}`:string,`{text}`:string>>")
        return F.coalesce(F.transform(F.filter(of, lambda m: m.isNotNull()), lambda m: turn(_renamed(m[role], layout), m[text])), F.array().cast(TURNS))
    each = [turn(F.lit(role), get(path, "string")) for role, path in layout.fields]
    optional = {path for role, path in layout.fields if path in ("input", "system")}
    given = [F.when((get(path, "string").isNull() | (get(path, "string") == "")) if path in optional else F.lit(False), F.array().cast(TURNS)).otherwise(F.array(t)) for t, (role, path) in zip(each, layout.fields, strict=True)]
    return F.concat(*given)


def canonical_json(df: DataFrame, key: str, json: str, layouts=LAYOUTS) -> DataFrame:
    """key, layout, fingerprint, turns for JSON records of mixed layouts, chosen row by row."""
    rows = df.select(F.col(key).alias("key"), F.try_parse_json(F.col(json)).alias("v"), json_paths(F.col(json)).alias("paths"))
    rows = rows.select("key", "v", F.sha2(F.array_join("paths", "\n"), 256).alias("fingerprint"))
    get = lambda path, kind: F.try_variant_get(F.col("v"), "$." + path, kind)
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for x in layouts:
        hit = F.col("fingerprint") == x.fingerprint
        name, turns = F.when(hit, F.lit(x.name)).otherwise(name), F.when(hit, turns_of(x, get)).otherwise(turns)
    return rows.select(F.col("key").alias(key), name.alias("layout"), "fingerprint", turns.alias("turns"))


def canonical_typed(df: DataFrame, key: str, layouts=LAYOUTS) -> DataFrame:
    """key, layout, fingerprint, turns for typed records: the columns beside the key are the record."""
    rest = df.drop(key)
    found = fingerprint(schema_paths(rest.schema))
    layout = next((x for x in layouts if x.fingerprint == found), None)
    turns = turns_of(layout, lambda path, _: F.col(path)) if layout else F.lit(None).cast(TURNS)
    return df.select(key, F.lit(layout and layout.name).cast("string").alias("layout"), F.lit(found).alias("fingerprint"), turns.alias("turns"))


def records_of_rows(rows: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn as one typed record a conversation, (key, messages). Rows are gathered map-side before the shuffle."""
    none = lambda c: F.coalesce(F.col(c), F.lit(""))
    each = F.struct(F.col(order).alias("at"), none(role).alias("role"), none(text).alias("text"))
    grouped = rows.select(F.col(key).alias(key), each.alias("m")).groupBy(key).agg(F.sort_array(F.collect_list("m")).alias("ms"))
    return grouped.select(key, F.transform("ms", lambda m: F.struct(m.role.alias("role"), m.text.alias("text"))).alias("messages"))


def escape(text: Column) -> Column:
    """One backslash more after the first character of whatever reads as a control string, escaped or not."""
    return F.regexp_replace(text, rf"({CONTROL_FIRST})(\\*){CONTROL_REST}", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"({CONTROL_FIRST})\\(\\*){CONTROL_REST}", "$1$2")


def escape_role(role: Column) -> Column:
    """A role stands on a line of its own."""
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.array_join(F.transform(F.split(role, r"\\\\"), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\"))


def format_chat(canonical: DataFrame, key: str, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Adds ``formatted`` and ``loss_mask``.

    Each turn is START, the role, a newline, the text, END. ``loss_mask`` has a (offset, length) in code points for every
    turn, counted from behind the turn's START; length 0 where the role isn't trained on, and END is never under the mask.
    """
    parts = F.transform("turns", lambda t: F.struct(t.role.isin(*trained).alias("on"), escape_role(t.role).alias("role"), escape(t.text).alias("text")))
    rows = canonical.withColumn("parts_", parts)
    formatted = F.array_join(F.transform("parts_", lambda p: F.concat(F.lit(START), p.role, F.lit("\n"), p.text, F.lit(END))), "")
    mask = F.transform("parts_", lambda p: F.struct((F.length(p.role) + 1).alias("offset"), F.when(p.on, F.length(p.text)).otherwise(0).alias("length")))
    return rows.select(key, "layout", "fingerprint", "turns", formatted.alias("formatted"), mask.alias("loss_mask"))


def segments(formatted: Column) -> Column:
    """What stands behind each START."""
    return F.when(formatted == "", F.array().cast("array<string>")).otherwise(F.slice(F.split(formatted, r"<\|im_start\|>"), 2, F.length(formatted) + 1))


def parse_chat(formatted: Column) -> Column:
    """The turns of a formatted text."""

    def turn(s: Column) -> Column:
        head = F.length(F.substring_index(s, "\n", 1))
        return F.struct(unescape_role(F.substring_index(s, "\n", 1)).alias("role"), unescape(F.substr(s, head + 2, F.length(s) - head - 1 - len(END))).alias("text"))

    return F.transform(segments(formatted), turn)


def masked_text(formatted: Column, loss_mask: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    each = F.zip_with(segments(formatted), loss_mask, lambda s, m: unescape(F.substr(s, m.offset + 1, m.length)))
    return F.array_join(each, "")
