"""Chat formatting: a fingerprint of nested field paths selects a declarative mapping.

A record's fingerprint is the hash of the sorted paths of its filled fields ("prompt",
"messages[].role", ...), of those that some mapping names. Mappings, keyed by such fingerprints, say how prompt,
instruction and message layouts become canonical turns (role, text); they are compiled
into one CASE over the fingerprint. The canonical turns are written in a template:

    <|im_start|>ROLE \n TEXT <|im_end|> \n        (without the spaces)

Inside texts, "<", any number of backslashes, "|" gets one more backslash, so no
control string can occur; roles also write "%" as %25 and a line break as %0A. Both
are undone exactly by `read_back`. The loss mask is kept with the output: `segments`
are its pieces in order, with `loss` true for assistant texts alone.

Some fields may be left empty where others stay the same (OPTIONAL): an empty or blank
`input` or `system` counts as unfilled, so a record with input "" is a plain instruction.
An assistant's tool calls are its text, as JSON, where it says nothing else.

Defined cases: a null text is empty, a null role is empty, a record whose fingerprint
has no mapping gets null outputs and `layout` null (never dropped); equal turn numbers
are ordered by role, then text; repeated rows stay; a null conversation id is a
conversation of its own; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptoria.llm.common import let

START, END = "<|im_start|>", "<|im_end|>\n"


@dataclass(frozen=True)
class Mapping:
    """paths: a record's filled fields. turns: (role, field paths joined by a blank line);
    or messages: (array field, role field, text field, {source role: role}), after a turn of
    the field `system`, if it names one, and with the field `calls` of a message, as JSON,
    where its text is null."""

    layout: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    messages: tuple[str, str, str, tuple[tuple[str, str], ...]] | None = None
    system: str | None = None
    calls: str | None = None


#: Fields that count as unfilled if they are empty or blank.
OPTIONAL = ("input", "system")
_SHARE = ("conversations", "from", "value", (("human", "user"), ("gpt", "assistant")))

#: Mappings of common public layouts.
MAPPINGS = (
    Mapping("prompt_completion", ("prompt", "completion"), (("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt_response", ("prompt", "response"), (("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("system_prompt_response", ("system", "prompt", "response"), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("instruction", ("instruction", "output"), (("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction_input", ("instruction", "input", "output"), (("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("messages", ("messages[].role", "messages[].content"), messages=("messages", "role", "content", ())),
    Mapping("messages_no_text", ("messages[].role",), messages=("messages", "role", "content", ())),
    Mapping("messages_no_role", ("messages[].content",), messages=("messages", "role", "content", ())),
    Mapping("messages_empty", ("messages",), messages=("messages", "role", "content", ())),
    Mapping("share", ("conversations[].from", "conversations[].value"), messages=_SHARE),
    Mapping("system_messages", ("system", "messages[].role", "messages[].content"), messages=("messages", "role", "content", ()), system="system"),
    Mapping("tool_messages", ("messages[].role", "messages[].content", "messages[].tool_calls"), messages=("messages", "role", "content", ()), calls="tool_calls"),
    Mapping("tool_calls", ("messages[].role", "messages[].tool_calls"), messages=("messages", "role", "content", ()), calls="tool_calls"),
    Mapping("system_tool_messages", ("system", "messages[].role", "messages[].content", "messages[].tool_calls"), messages=("messages", "role", "content", ()), system="system", calls="tool_calls"),
    Mapping("system_share", ("system", "conversations[].from", "conversations[].value"), messages=_SHARE, system="system"),
    Mapping("system_instruction", ("system", "instruction", "output"), (("system", ("system",)), ("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("system_instruction_input", ("system", "instruction", "input", "output"), (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("query_answer", ("query", "answer"), (("user", ("query",)), ("assistant", ("answer",)))),
    Mapping("question_answer", ("question", "answer"), (("user", ("question",)), ("assistant", ("answer",)))),
    Mapping("text", ("text",), (("assistant", ("text",)),)),
)


def _has(name: str):
    return lambda e: e[name].isNotNull()


def field_paths(schema: T.StructType) -> dict[str, Column]:
    """Path -> whether a row fills it, for strings, structs and arrays of structs."""
    found: dict[str, Column] = {}

    def walk(kind: T.DataType, path: str, value: Column, filled: Column) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, f"{path}.{f.name}" if path else f.name, value[f.name], filled & value[f.name].isNotNull())
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            names = [f.name for f in kind.elementType.fields]
            for n in names:
                found[f"{path}[].{n}"] = F.coalesce(F.exists(value, _has(n)), F.lit(False))
            some = F.coalesce(F.exists(value, lambda e: F.coalesce(*[e[n].cast("string") for n in names]).isNotNull()), F.lit(False))
            found[path] = filled & ~some
        else:
            found[path] = filled

    for f in schema.fields:
        walk(f.dataType, f.name, F.col(f"`{f.name}`"), F.col(f"`{f.name}`").isNotNull())
    return found


def fingerprint(paths: dict[str, Column]) -> Column:
    return F.xxhash64(F.concat_ws("\n", *[F.when(paths[p], F.lit(p)) for p in sorted(paths)]))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unrole(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _turns(m: Mapping, schema: T.StructType) -> Column | None:
    """The mapping's canonical turns, or None where the table lacks its fields."""
    top = {f.name for f in schema.fields}
    if m.messages:
        array, role, text, renamed = m.messages
        if array not in top:
            return None

        def turn(e: Column) -> Column:
            name = e[role]
            for a, b in renamed:
                name = F.when(e[role] == a, F.lit(b)).otherwise(name)
            said = e[text] if m.calls is None else F.coalesce(e[text], e[m.calls] if fields[m.calls] == T.StringType() else F.to_json(e[m.calls]))
            return _turn(name, said)

        fields = {f.name: f.dataType for f in schema[array].dataType.elementType.fields}
        if not {role, text, *[c for c in (m.calls,) if c]} <= set(fields) or (m.system and m.system not in top):
            return None
        said = F.transform(F.col(f"`{array}`"), turn)
        return said if m.system is None else F.concat(F.array(_turn(F.lit("system"), F.col(f"`{m.system}`"))), said)
    if any(p not in top for _, ps in m.turns for p in ps):
        return None
    return F.array(*[_turn(F.lit(r), F.concat_ws("\n\n", *[F.col(f"`{p}`") for p in ps])) for r, ps in m.turns])


def format_chats(records: DataFrame, key_cols: list[str], mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Key columns, layout, formatted (one string) and segments (its pieces with the loss
    mask); all other columns of records are the heterogeneous fields."""
    schema = T.StructType([f for f in records.schema.fields if f.name not in key_cols])
    named = {p for m in mappings for p in m.paths}
    paths = {p: filled for p, filled in field_paths(schema).items() if p in named}
    for p in OPTIONAL:
        if p in paths and schema[p].dataType == T.StringType():
            paths[p] = paths[p] & (F.trim(F.col(f"`{p}`")) != "")

    def mapped(print_: Column) -> Column:
        layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
        for m in mappings:
            built = _turns(m, schema)
            if built is not None:
                same = print_ == F.xxhash64(F.lit("\n".join(sorted(m.paths))))
                layout, turns = F.when(same, F.lit(m.layout)).otherwise(layout), F.when(same, built).otherwise(turns)
        return F.struct(layout.alias("layout"), turns.alias("turns"))

    # keys and result in two structs, so that no name of the input can clash
    d = records.select(F.struct(*[F.col(f"`{k}`") for k in key_cols]).alias("_keys"), let(fingerprint(paths), mapped).alias("_m"))
    keys = [F.col(f"_keys.`{k}`").alias(k) for k in key_cols]

    def pieces(t: Column) -> Column:
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(piece(F.concat(F.lit(START), _role(t["role"]), F.lit("\n")), F.lit(False)), piece(escape(t["text"]), t["role"] == "assistant"), piece(F.lit(END), F.lit(False)))

    d = d.select("_keys", F.col("_m.layout").alias("_layout"), F.flatten(F.transform("_m.turns", pieces)).alias("_segments"))
    return d.select(*keys, F.col("_layout").alias("layout"), F.array_join(F.transform("_segments", lambda s: s["text"]), "").alias("formatted"), F.col("_segments").alias("segments"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that the template's output holds."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")

    def turn(p: Column) -> Column:
        body = F.substr(p, F.lit(len(START) + 1))
        role = F.substring_index(body, "\n", 1)
        return F.struct(_unrole(role).alias("role"), unescape(F.substr(body, F.length(role) + 2)).alias("text"))

    return F.transform(parts, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, without anything between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def conversations_as_records(rows: DataFrame) -> DataFrame:
    """Turn rows (conv_id, turn, role, text) as records with a `messages` array."""
    m = F.struct("turn", "role", F.col("text").alias("content"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(m)).alias("messages")).select("conv_id", F.transform("messages", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def digests(formatted: DataFrame) -> DataFrame:
    """The contract's digest columns, read back from formatted and segments."""
    d = formatted.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return d.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def oracle_select() -> str:
    """DuckDB SQL of the digests of conversations and conversation -1."""
    control = "<|im_end|><|im_start|>assistant ok"
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{control}' UNION ALL SELECT -1, 1, 'assistant', '{control}'),
t AS (SELECT *, len(regexp_extract_all(text, '<\\\\*\\|')) AS n_escapes, replace(replace(role, '%', '%25'), chr(10), '%0A') AS r FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(text) + n_escapes + length(r) + len(regexp_extract_all(r, '<\\\\*\\|')) + {len(START) + 1 + len(END)})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""
