"""Chat formatting by schema fingerprints.

A layout is recognised by a fingerprint: the hash of those of a record's nested field paths that any
layout knows (``VOCABULARY``). Fingerprints of all layouts, with and without their optional paths, are in
one table (``BY_FINGERPRINT``), in which the record's own is looked up; it selects a declarative mapping
into canonical turns (conv_id, turn, role, text). A record whose fingerprint isn't there, since further
fields have names that other layouts use, takes the layout with the most paths among those it contains;
one that contains none has no turns, and ``unmatched_json`` counts such records by fingerprint.
``canonical_turns`` reads a typed table, ``canonical_turns_json`` a column of JSON records whose layouts
differ from row to row; there the paths of all elements of a list count.

``format_turns`` writes a conversation's turns as one string, ``### role: text</turn>\\n`` each, with
the loss mask as spans of that string. Inside texts the characters that control strings begin with
are written as two-character codes, so no text can end a turn or open another:
backslash ``\\b``, ``#`` ``\\h``, ``<`` ``\\l`` and, in roles, ``:`` ``\\c``. ``parse_formatted`` reverses it.

Edge cases: null texts and roles are empty strings; turns of a conversation are ordered by turn (null
first), then role, then text, so ties and repeated rows have one order and are all kept; rows with a
null conversation id are one conversation; an empty table gives an empty result. A conversation is
one output value, so its turns meet in one task; there is no way to split one string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Template, fixed values.
OPEN, SEP, CLOSE = "### ", ": ", "</turn>\n"
CODES = {"\\": "\\b", "#": "\\h", "<": "\\l"}
ROLE_CODES = CODES | {":": "\\c"}
TRAINED_ROLE = "assistant"

#: Names of roles in public layouts and their canonical ones.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


_TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """paths: field paths that mark the layout; optional ones may be missing. turns: SQL for
    array<struct<role, text>>; None for tables that hold one turn a row."""

    name: str
    paths: tuple[str, ...]
    schema: str
    turns: str | None
    optional: tuple[str, ...] = ()


def _role(x: str) -> str:
    cases = " ".join(f"when '{k}' then '{v}'" for k, v in ROLE_NAMES.items())
    return f"case {x} {cases} else {x} end"


def _pair(user: str, assistant: str) -> str:
    """A system prompt and earlier exchanges, if there are any, then a question and its answer."""
    one = lambda u, a: f"array(named_struct('role', 'user', 'text', {u}), named_struct('role', 'assistant', 'text', {a}))"
    first = f"if(coalesce(system, '') = '', cast(array() as {_TURNS}), array(named_struct('role', 'system', 'text', system)))"
    before = f"coalesce(flatten(transform(history, h -> {one('h[0]', 'h[1]')})), cast(array() as {_TURNS}))"
    return f"concat({first}, {before}, {one(user, assistant)})"


_MORE = ("history", "system")
_MORE_SCHEMA = ", history array<array<string>>, system string"
_PARTS = "array_join(transform(m.content, c -> coalesce(c.text, '')), '')"
LAYOUTS = (
    Layout("turn_rows", ("role", "text", "turn"), "conv_id bigint, turn bigint, role string, text string", None),
    Layout("messages", ("messages[].content", "messages[].role"), "messages array<struct<role: string, content: string>>", f"transform(messages, m -> named_struct('role', {_role('m.role')}, 'text', m.content))", ("messages[].name",)),
    Layout("message_parts", ("messages[].content[].text", "messages[].role"), "parts array<struct<role: string, content: array<struct<type: string, text: string>>>>", f"transform(parts, m -> named_struct('role', {_role('m.role')}, 'text', {_PARTS}))", ("messages[].content[].type", "messages[].name")),
    Layout("conversations", ("conversations[].from", "conversations[].value"), "conversations array<struct<`from`: string, value: string>>", f"transform(conversations, m -> named_struct('role', {_role('m.`from`')}, 'text', m.value))"),
    Layout("instruction_input", ("input", "instruction", "output"), f"instruction string, input string, output string{_MORE_SCHEMA}", _pair("concat_ws('\\n', instruction, nullif(input, ''))", "output"), _MORE),
    Layout("instruction", ("instruction", "output"), f"instruction string, output string{_MORE_SCHEMA}", _pair("instruction", "output"), _MORE),
    Layout("prompt_response", ("prompt", "response"), f"prompt string, response string{_MORE_SCHEMA}", _pair("prompt", "response"), _MORE),
    Layout("prompt_completion", ("completion", "prompt"), f"prompt string, completion string{_MORE_SCHEMA}", _pair("prompt", "completion"), _MORE),
    Layout("question_answer", ("answer", "question"), f"question string, answer string{_MORE_SCHEMA}", _pair("question", "answer"), _MORE),
)
VOCABULARY = frozenset(p for x in LAYOUTS for p in (*x.paths, *x.optional))


def fingerprint(paths: Sequence[str]) -> str:
    """Hash of the paths that any layout knows."""
    return hashlib.sha256("\n".join(sorted(VOCABULARY & set(paths))).encode()).hexdigest()


def _variants(x: Layout) -> list[tuple[str, ...]]:
    return [x.paths + c for n in range(len(x.optional) + 1) for c in combinations(x.optional, n)]


BY_FINGERPRINT = {fingerprint(v): x for x in LAYOUTS for v in _variants(x)}
#: For records that aren't in the table: layouts with more paths first.
BY_SIZE = sorted(LAYOUTS, key=lambda x: -len(x.paths))


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Paths of all leaves: ``a.b`` for structs, ``a[]`` for arrays."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, at + "[]")
    return [at]


def layout_of(df: DataFrame) -> Layout:
    paths = [p.removesuffix("[][]") for p in field_paths(df.schema)]
    found = BY_FINGERPRINT.get(fingerprint(paths)) or next((x for x in BY_SIZE if set(x.paths) <= set(paths)), None)
    if found is None:
        raise ValueError(f"no layout has the field paths {sorted(paths)}")
    return found


def canonical_turns(df: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Rows (conv_id, turn, role, text) of a table in any known layout."""
    layout = layout_of(df)
    if layout.turns is None:
        return df.select(F.col(f"`{conv_id}`").alias("conv_id"), "turn", "role", "text")
    if layout.name == "message_parts":
        df = df.withColumnRenamed("messages", "parts")
    given = {c.lower() for c in df.columns}
    for name, kind in (("history", "array<array<string>>"), ("system", "string")):
        if name not in given:
            df = df.withColumn(name, F.lit(None).cast(kind))
    turns = df.select(F.col(f"`{conv_id}`").alias("conv_id"), F.posexplode(F.expr(layout.turns)).alias("turn", "t"))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


def json_paths(record: Column) -> Column:
    """Field paths of JSON records: top-level keys, and the keys of all elements of the lists that layouts know."""
    empty = F.expr("cast(array() as array<string>)")

    def keys(array: Column, at: str) -> Column:
        every = F.flatten(F.transform(F.from_json(array, "array<map<string,string>>"), F.map_keys))
        return F.coalesce(F.transform(every, lambda k: F.concat(F.lit(f"{at}[]."), k)), empty)

    messages = F.get_json_object(record, "$.messages")
    every = F.from_json(messages, "array<map<string,string>>")
    listed = F.transform(every, lambda m: F.coalesce(F.flatten(F.transform(F.from_json(m["content"], "array<map<string,string>>"), F.map_keys)), empty))
    parts = F.coalesce(F.transform(F.flatten(listed), lambda k: F.concat(F.lit("messages[].content[]."), k)), empty)
    own = keys(messages, "messages")
    of_messages = F.when(F.size(parts) > 0, F.array_remove(own, "messages[].content")).otherwise(own)
    return F.array_distinct(F.concat(F.coalesce(F.json_object_keys(record), empty), of_messages, parts, keys(F.get_json_object(record, "$.conversations"), "conversations")))


def json_fingerprint(paths: Column) -> Column:
    """``fingerprint`` of a column of paths."""
    known = F.array_intersect(paths, F.array(*[F.lit(p) for p in sorted(VOCABULARY)]))
    return F.sha2(F.array_join(F.array_sort(known), "\n"), 256)


def _numbered(df: DataFrame, record: str) -> DataFrame:
    """``df`` with _paths, _print and _layout: the number of the record's layout, null if it has none."""
    table = F.create_map(*[F.lit(v) for p, x in BY_FINGERPRINT.items() for v in (p, LAYOUTS.index(x)) if x.turns is not None])
    x = df.withColumn("_paths", json_paths(F.col(f"`{record}`"))).withColumn("_print", json_fingerprint(F.col("_paths")))
    contained = [F.when(F.size(F.array_intersect("_paths", F.array(*[F.lit(p) for p in y.paths]))) == len(y.paths), F.lit(LAYOUTS.index(y))) for y in BY_SIZE if y.turns is not None]
    return x.withColumn("_layout", F.coalesce(table[F.col("_print")], *contained))


def canonical_turns_json(df: DataFrame, record: str, conv_id: str = "conv_id") -> DataFrame:
    """Rows (conv_id, turn, role, text) of JSON records. A record in no known layout has no turns."""
    layouts = [x for x in LAYOUTS if x.turns is not None]
    fields = {f.name: f for x in layouts for f in T._parse_datatype_string(x.schema).fields}
    # Lists of parts have the name of lists of texts, so they are read apart.
    text, parts = T.StructType([f for n, f in fields.items() if n != "parts"]), T.StructType([T.StructField("messages", fields["parts"].dataType)])
    x = df.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{record}`").alias("_record"))
    x = _numbered(x, "_record").select("conv_id", "_layout", F.from_json("_record", text).alias("_r"), F.from_json("_record", parts)["messages"].alias("parts")).select("conv_id", "_layout", "_r.*", "parts")
    turns = F.coalesce(*[F.when(F.col("_layout") == LAYOUTS.index(y), F.expr(y.turns)) for y in layouts])
    out = x.select("conv_id", F.posexplode(turns).alias("turn", "t"))
    return out.select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


def unmatched_json(df: DataFrame, record: str) -> DataFrame:
    """Rows (fingerprint, n, paths) of the records that have no layout, with the field paths of one of them."""
    x = _numbered(df.select(F.col(f"`{record}`").alias("_record")), "_record").where("_layout is null")
    return x.groupBy(F.col("_print").alias("fingerprint")).agg(F.count("*").alias("n"), F.min(F.array_sort("_paths")).alias("paths"))


def escape(text: Column, codes: dict[str, str] = CODES) -> Column:
    """The backslash comes first in ``codes``, so codes aren't escaped again."""
    for plain, code in codes.items():
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    """Every backslash in an escaped text begins a code, so one replacement a code suffices if the
    backslash's own comes last."""
    for plain, code in reversed(ROLE_CODES.items()):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_turns(turns: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, formatted, mask (array of start and len in characters)."""
    empty = F.lit("")
    t = turns.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    t = t.withColumn("body", escape(F.col("text"))).withColumn("head", F.concat(F.lit(OPEN), escape(F.col("role"), ROLE_CODES), F.lit(SEP)))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    size = F.length("head") + F.length("body") + F.lit(len(CLOSE))
    t = t.withColumn("pos", F.row_number().over(w)).withColumn("start", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.lit(len(CLOSE)) - F.length("body"))
    piece = F.struct("pos", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), "start", F.length("body").cast("long").alias("len"), (F.col("role") == TRAINED_ROLE).alias("trained"))
    c = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    return c.select(
        "conv_id",
        F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter("p", lambda x: x["trained"]), lambda x: F.struct(x["start"].alias("start"), x["len"].alias("len"))).alias("mask"),
    )


def parse_formatted(formatted: Column) -> Column:
    """Turns (array of role and text) of a formatted conversation."""
    parts = F.split(formatted, "</turn>\\n", -1)

    def turn(p: Column) -> Column:
        at = F.instr(p, SEP)
        role = F.substr(p, F.lit(len(OPEN) + 1), at - F.lit(len(OPEN) + 1))
        return F.struct(unescape(role).alias("role"), unescape(F.substr(p, at + F.lit(len(SEP)))).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substr(formatted, (m["start"] + 1).cast("int"), m["len"].cast("int")))), "")


def digest(chats: DataFrame) -> DataFrame:
    """What ``format_turns`` wrote, read back and summed up."""
    c = chats.withColumn("turns", parse_formatted(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("mask")))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return c.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
