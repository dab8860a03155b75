"""Chat formatting by schema fingerprints; DataFrame functions only.

A record's fingerprint is the SHA-256 of its sorted nested field paths (``messages[].role``); it selects a declarative
layout, whose mapping turns the record into canonical (role, text) turns. Turns are then rendered into one marked
string per conversation with a loss mask over the assistant texts.

Defined results: a null text is empty, a null role is the empty role (a turn row may have both); records whose fingerprint no layout knows get
``layout`` null and no turns (``canonical_turns`` keeps them when ``keep_unmapped``); turns of one conversation that tie
in order are ordered by role, then text; repeated rows stay repeated turns; a null conversation id is a conversation
like any other; an empty table gives no rows; columns beyond the layouts' paths are ignored, whatever their names.
One conversation is one output row, so its turns meet in one task; rows of different conversations never do so.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Markers of the template, and the control strings of other common templates that texts must not contain.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CONTROLS = (OPEN, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


@dataclass(frozen=True)
class Say:
    """One turn: a role (literal, or the path of a field if ``role_field``) and text paths joined by a blank line."""

    role: str
    texts: tuple[str, ...]
    role_field: bool = False


@dataclass(frozen=True)
class Each:
    """A turn for every element of an array of structs."""

    array: str
    role: str
    text: str


@dataclass(frozen=True)
class Layout:
    name: str
    required: tuple[str, ...]
    turns: tuple[Say | Each, ...]
    optional: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)
    #: Records without any path are also of this layout where the schema has all of its paths.
    blank: bool = False

    def fingerprints(self) -> list[str]:
        return [fingerprint_of([*self.required, *some]) for n in range(len(self.optional) + 1) for some in combinations(self.optional, n)]


# Role names of common layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant"}

LAYOUTS = (
    Layout("turn_row", ("role",), (Say("role", ("text",), role_field=True),), optional=("text",), blank=True),
    Layout("turn_row_no_role", ("text",), (Say("role", ("text",), role_field=True),)),
    Layout("prompt_response", ("prompt", "response"), (Say("system", ("system",)), Say("user", ("prompt",)), Say("assistant", ("response",))), optional=("system",)),
    Layout("prompt_completion", ("prompt", "completion"), (Say("user", ("prompt",)), Say("assistant", ("completion",)))),
    Layout("question_answer", ("question", "answer"), (Say("user", ("question",)), Say("assistant", ("answer",)))),
    Layout("instruction", ("instruction", "output"), (Say("user", ("instruction", "input")), Say("assistant", ("output",))), optional=("input",)),
    Layout("messages_content", ("messages[].role",), (Each("messages", "role", "content"),), optional=("messages[].content",), roles=ROLES),
    Layout("messages_value", ("conversations[].from",), (Each("conversations", "from", "value"),), optional=("conversations[].value",), roles=ROLES),
)


def fingerprint_of(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def nested_paths(schema: T.StructType) -> dict[str, Column]:
    """Every leaf path of the schema, with an expression that says whether a row has it."""
    found: dict[str, Column] = {}

    def walk(kind: T.DataType, path: str, get, has) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, f"{path}.{f.name}", lambda x, n=f.name, get=get: get(x)[n], has)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            for f in kind.elementType.fields:
                if not isinstance(f.dataType, (T.StructType, T.ArrayType)):
                    found[f"{path}[].{f.name}"] = has(lambda x, n=f.name, get=get: F.exists(get(x), _has_field(n)))
        else:
            found[path] = has(lambda x, get=get: get(x).isNotNull())

    for f in schema.fields:
        col = F.col(f"`{f.name}`")
        walk(f.dataType, f.name, lambda x: x, lambda test, col=col: F.coalesce(test(col), F.lit(False)))
    return found


def _element(rule: Each, fields: set[str]):
    def turn(e: Column) -> Column:
        text = e[rule.text] if rule.text in fields else F.lit(None)
        return F.struct(e[rule.role].cast("string").alias("role"), text.cast("string").alias("text"))

    return turn


def _has_field(name: str):
    return lambda e: e[name].isNotNull()


def _turns(layout: Layout, schema: T.StructType) -> Column:
    kind = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
    names = set(schema.fieldNames())
    parts = []
    for rule in layout.turns:
        if isinstance(rule, Each):
            parts.append(F.transform(F.col(f"`{rule.array}`"), _element(rule, {f.name for f in schema[rule.array].dataType.elementType.fields})))
            continue
        texts = [F.col(f"`{p}`").cast("string") for p in rule.texts if p in names]
        joined = F.concat_ws("\n\n", *texts) if texts else F.lit("")
        role = (F.col(f"`{rule.role}`") if rule.role in names else F.lit("")) if rule.role_field else F.lit(rule.role)
        one = F.array(F.struct(role.alias("role"), joined.alias("text")))
        absent = not rule.role_field and all(p in layout.optional for p in rule.texts)
        parts.append(F.when(F.coalesce(*texts).isNotNull(), one).otherwise(F.array().cast(kind)) if absent and texts else F.array().cast(kind) if absent else one)
    out = F.concat(*[p.cast(kind) for p in parts])
    if layout.roles:
        known = F.create_map(*[F.lit(x) for kv in layout.roles.items() for x in kv])
        out = F.transform(out, lambda e: F.struct(F.coalesce(known[e["role"]], e["role"]).alias("role"), e["text"].alias("text")))
    return F.transform(out, lambda e: F.struct(F.coalesce(e["role"], F.lit("")).alias("role"), F.coalesce(e["text"], F.lit("")).alias("text")))


def canonical_turns(records: DataFrame, id_col: str, order_col: str | None = None, layouts: tuple[Layout, ...] = LAYOUTS, keep_unmapped: bool = False) -> DataFrame:
    """(conv_id, turn, part, role, text, layout, fingerprint): a row for every turn of every record.

    ``order_col`` orders records of one conversation (turn rows); ``part`` orders the turns within a record."""
    present = {p: c for p, c in nested_paths(records.schema).items() if p not in (id_col, order_col)}
    spoken = {p for x in layouts for p in (*x.required, *x.optional)}
    used = sorted(p for p in present if p in spoken)
    found = F.array_compact(F.array(*[F.when(present[p], F.lit(p)) for p in used])) if used else F.array().cast("array<string>")
    free = "__fp"
    while free in records.columns:
        free += "_"
    marked = records.withColumn(free, F.sha2(F.array_join(found, "\n"), 256))
    turns, name = None, None
    for layout in layouts:
        if not set(layout.required) <= set(used):
            continue
        blank = [fingerprint_of([])] if layout.blank and {*layout.required, *layout.optional} <= set(used) else []
        fits = F.col(free).isin(layout.fingerprints() + blank)
        value = _turns(layout, records.schema)
        turns = F.when(fits, value) if turns is None else turns.when(fits, value)
        name = F.when(fits, F.lit(layout.name)) if name is None else name.when(fits, F.lit(layout.name))
    if turns is None:
        turns, name = F.lit(None).cast("array<struct<role:string,text:string>>"), F.lit(None).cast("string")
    order = F.col(f"`{order_col}`").cast("long") if order_col else F.lit(0).cast("long")
    slim = marked.select(F.col(f"`{id_col}`").alias("conv_id"), order.alias("turn"), F.col(free).alias("fingerprint"), name.alias("layout"), turns.alias("turns"))
    explode = F.posexplode_outer if keep_unmapped else F.posexplode
    rows = slim.select("conv_id", "turn", "fingerprint", "layout", explode("turns").alias("part", "said"))
    return rows.select("conv_id", "turn", "part", F.col("said.role").alias("role"), F.col("said.text").alias("text"), "layout", "fingerprint")


def _literal(x: str) -> str:
    return "".join("\\" + c if c in "\\.[]{}()*+-?^$|/<>" else c for c in x)


#: Matches the first character of every control string.
_BREAK = "|".join(f"{_literal(c[0])}(?={_literal(c[1:])})" for c in CONTROLS)


def escape(text: Column) -> Column:
    """Double every backslash, then break every control string by a backslash after its first character."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({_BREAK})", r"$1\\")


def unescape(text: Column) -> Column:
    """A backslash goes; of a pair of them the second stays."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans): one marked string per conversation; spans are (start, length) in code points."""
    from pyspark.sql import Window

    head = F.concat(F.lit(OPEN), F.url_encode("role"), F.lit("\n"))
    pieces = turns.select("conv_id", "turn", "part", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"))
    pieces = pieces.withColumn("piece_len", F.length("head") + F.length("body") + len(CLOSE) + 1)
    before = Window.partitionBy("conv_id").orderBy("turn", "part", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.col("piece_len").cast("long")).over(before), F.lit(0)) + F.length("head")
    span = F.when(F.col("role") == loss_role, F.struct(F.col("at").alias("start"), F.length("body").cast("long").alias("length")))
    placed = pieces.withColumn("at", at).select(
        "conv_id", F.struct("at", F.concat("head", "body", F.lit(CLOSE + "\n")).alias("piece"), span.alias("span")).alias("x"))
    rows = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return rows.select(
        "conv_id", F.size("xs").cast("long").alias("n_turns"),
        F.array_join(F.transform("xs", lambda x: x["piece"]), "").alias("formatted"),
        F.array_compact(F.transform("xs", lambda x: x["span"])).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (array of role, text) and ``loss_texts`` (array), both read from ``formatted`` alone and its spans."""
    pieces = F.split("formatted", _literal(CLOSE) + "\n")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    cut = lambda p: F.instr(p, "\n")
    turn = lambda p: F.struct(
        F.url_decode(F.substr(p, F.lit(len(OPEN) + 1), cut(p) - len(OPEN) - 1)).alias("role"), unescape(F.substr(p, cut(p) + 1)).alias("text"))
    text = lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return formatted.withColumn("turns", F.transform(pieces, turn)).withColumn("loss_texts", F.transform("loss_spans", text))
