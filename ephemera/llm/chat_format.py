"""Operator 8, chat formatting: schema fingerprints select mappings to canonical turns, which one template renders."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let, sums_before, table, text_of

TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
OPEN, MIDDLE, CLOSE = "<turn ", ">\n", "</turn>\n"


# --- schema fingerprints ------------------------------------------------------------------------------------


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths, sorted; an array adds [] to the path and a map {}."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    if isinstance(kind, T.MapType):
        return field_paths(kind.valueType, f"{at}{{}}")
    return [at]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes canonical turns. paths: the nested fields that make up the layout's fingerprint.

    turns: over a row that has those fields. by_row: rows hold a turn each (conversation, order, role, text).
    """

    name: str
    paths: tuple[str, ...]
    turns: Callable[[Callable[[str], Column]], Column] | None = None
    by_row: tuple[str, str, str, str] | None = None

    @property
    def key(self) -> str:
        return fingerprint(list(self.paths))


def _turn(role: str | Column, text: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).cast("string").alias("role"), text.cast("string").alias("text"))


def _asked(instruction: Column, given: Column) -> Column:
    return F.when(F.coalesce(F.length(given), F.lit(0)) == 0, text_of(instruction)).otherwise(F.concat(text_of(instruction), F.lit("\n\n"), given))


#: Role names that other layouts use for the canonical ones (fixed values).
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _role(role: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair)), F.coalesce(role, F.lit(""))), role)


MAPPINGS = (
    Mapping("turn rows", ("conv_id", "role", "text", "turn"), by_row=("conv_id", "turn", "role", "text")),
    Mapping("messages", ("messages[].content", "messages[].role"), lambda c: F.transform(c("messages"), lambda m: _turn(m["role"], m["content"]))),
    Mapping("from and value", ("conversations[].from", "conversations[].value"), lambda c: F.transform(c("conversations"), lambda m: _turn(_role(m["from"]), m["value"]))),
    Mapping("prompt and completion", ("completion", "prompt"), lambda c: F.array(_turn("user", c("prompt")), _turn("assistant", c("completion")))),
    Mapping("prompt and response", ("prompt", "response"), lambda c: F.array(_turn("user", c("prompt")), _turn("assistant", c("response")))),
    Mapping("instruction", ("instruction", "output"), lambda c: F.array(_turn("user", c("instruction")), _turn("assistant", c("output")))),
    Mapping("instruction with input", ("input", "instruction", "output"), lambda c: F.array(_turn("user", _asked(c("instruction"), c("input"))), _turn("assistant", c("output")))),
    Mapping("system, prompt and response", ("prompt", "response", "system"), lambda c: F.array(_turn("system", c("system")), _turn("user", c("prompt")), _turn("assistant", c("response")))),
)


def mapping_for(schema: T.StructType, id_col: str | None = None, mappings: tuple[Mapping, ...] = MAPPINGS) -> Mapping:
    """The mapping whose fingerprint the schema has, or else those of its fields that a mapping names, so that extra columns do no harm.

    Where the fields hold several layouts, one with a row per turn comes first, then the one with most fields, then the first in mappings.
    """
    paths = field_paths(schema)
    by_key = {m.key: m for m in mappings}
    for exact in (paths, [p for p in paths if p != id_col]):
        if found := by_key.get(fingerprint(exact)):
            return found
    parts = [m for m in mappings if by_key.get(fingerprint([p for p in paths if p in m.paths])) is m]
    if parts:
        return max(parts, key=lambda m: (m.by_row is not None, len(m.paths)))
    raise ValueError(f"no mapping for a layout with the fields {', '.join(paths) or '(none)'}")


def canonical_turns(df: DataFrame, id_col: str = "conv_id", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(id, turns array<struct<role, text>>) from a table whose layout its schema's fingerprint tells.

    Null texts count as empty and null roles as "". In tables with a row per turn, turns go by turn number (null first), then
    role and text; repeated rows are repeated turns. A null array gives no turns.
    """
    found = mapping_for(df.schema, id_col, mappings)
    if found.by_row:
        conv, order, role, text = found.by_row
        one = F.struct(F.col(order).alias("at"), text_of(role).alias("role"), text_of(text).alias("text"))
        rows = df.groupBy(F.col(conv).alias(id_col)).agg(F.sort_array(F.collect_list(one)).alias("turns"))
        turns = F.col("turns")
    else:
        rows, turns = df, F.coalesce(found.turns(F.col), F.array().cast(TURNS))
    return rows.select(id_col, F.transform(turns, lambda t: F.struct(text_of(t["role"]).alias("role"), text_of(t["text"]).alias("text"))).alias("turns"))


def canonical_turns_of_json(df: DataFrame, id_col: str, json_col: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """The same for a column of JSON records of mixed layouts: the fingerprint is taken row by row.

    The paths of a record come from its variant's schema, with the types cut away. All paths count: a record with one field more than a mapping
    names has another fingerprint, unlike a table, whose further columns are ignored. A record without a mapping, and text
    that is not JSON, gets null turns and keeps its fingerprint, so that a mapping can be added for it.
    """
    whole = [m for m in mappings if m.turns]
    variant = F.try_parse_json(F.col(json_col))
    # OBJECT<a: STRING, b: ARRAY<OBJECT<c: STRING>>> keeps the names and nesting once scalar types are cut away.
    shape = F.regexp_replace(F.schema_of_variant(variant), r": (STRING|VOID|BIGINT|DOUBLE|BOOLEAN|DECIMAL\([0-9, ]*\))", ":")
    rows = df.select(F.col(id_col), F.col(json_col).alias("raw"), shape.alias("shape"))
    turns = F.lit(None).cast(TURNS)
    for m in whole:
        schema = _schema_of(m.paths)
        parsed = F.from_json("raw", schema)
        turns = F.when(F.sha2("shape", 256) == F.sha2(F.lit(_shape(schema)), 256), m.turns(lambda name, p=parsed: p[name]).cast(TURNS)).otherwise(turns)
    clean = F.transform(turns, lambda t: F.struct(text_of(t["role"]).alias("role"), text_of(t["text"]).alias("text")))
    return rows.select(id_col, F.sha2("shape", 256).alias("fingerprint"), clean.alias("turns"))


def _schema_of(paths: tuple[str, ...]) -> T.StructType:
    plain = [T.StructField(p, T.StringType()) for p in paths if "[]" not in p]
    lists: dict[str, list[T.StructField]] = {}
    for p in paths:
        if "[]" in p:
            top, _, below = p.partition("[].")
            lists.setdefault(top, []).append(T.StructField(below, T.StringType()))
    nested = [T.StructField(k, T.ArrayType(T.StructType(v))) for k, v in lists.items()]
    return T.StructType(sorted(plain + nested, key=lambda f: f.name))


def _shape(kind: T.DataType) -> str:
    if isinstance(kind, T.StructType):
        return "OBJECT<" + ", ".join(f"{f.name}:" + (f" {inner}" if (inner := _shape(f.dataType)) else "") for f in sorted(kind.fields, key=lambda f: f.name)) + ">"
    return f"ARRAY<{_shape(kind.elementType)}>" if isinstance(kind, T.ArrayType) else ""


# --- template -----------------------------------------------------------------------------------------------


def escape(text: Column) -> Column:
    r"""Reversible: \ becomes \s and < becomes \l, so no escaped text can begin a mark of the template."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def escape_role(role: Column) -> Column:
    r"""Like escape(), and > becomes \g, so no role can hold the mark that ends it."""
    return F.replace(escape(role), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def format_chats(chats: DataFrame, id_col: str = "conv_id", loss_role: str = "assistant") -> DataFrame:
    """(id, formatted string, loss_spans array<struct<start, end>>) from canonical turns.

    A turn is `<turn ROLE>`, a line feed, the escaped text, `</turn>` and a line feed. loss_spans are the code points of
    formatted, end exclusive, that hold texts of loss_role; a span may be empty, as its text. No turns give "".
    """
    part = lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit(MIDDLE)).alias("head"), escape(t["text"]).alias("body"))
    size = lambda p: F.length(p["head"]) + F.length(p["body"]) + len(CLOSE)

    def span(p: Column, at: Column) -> Column:
        begin = (at + F.length(p["head"])).cast("int")
        return F.when(p["role"] == loss_role, F.struct(begin.alias("start"), (begin + F.length(p["body"])).alias("end")))

    def made(parts: Column) -> Column:
        whole = F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
        spans = F.zip_with(parts, sums_before(F.transform(parts, size)), span)
        return F.struct(whole.alias("formatted"), F.filter(spans, lambda x: x.isNotNull()).alias("loss_spans"))

    return chats.select(id_col, let(F.transform("turns", part), made).alias("made")).select(id_col, "made.*")


def _pieces(formatted: Column) -> Column:
    return F.filter(F.split(formatted, CLOSE), lambda p: p != "")


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> from formatted text: what format_chats() was given."""
    return F.transform(
        _pieces(formatted),
        lambda p: F.struct(
            unescape(F.substr(p, F.lit(len(OPEN) + 1), F.instr(p, MIDDLE) - len(OPEN) - 1)).alias("role"),
            unescape(F.substr(p, F.instr(p, MIDDLE) + len(MIDDLE))).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between.

    Places of turns' texts are told from the formatted text itself and sorted among the spans: a text behind a span of its own place is under
    the mask. So a long conversation is not searched from its beginning for each span. Spans of other places, if there are any, are cut out singly.
    """

    def placed(pieces: Column) -> Column:
        starts = sums_before(F.transform(pieces, lambda p: F.length(p) + len(CLOSE)))

        def place(p: Column, at: Column) -> Column:
            head = F.instr(p, MIDDLE) + len(MIDDLE) - 1
            return F.struct((at + head).cast("int").alias("start"), (at + F.length(p)).cast("int").alias("end"), F.substr(p, head + 1).alias("body"))

        return F.zip_with(pieces, starts, place)

    marks = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(None).cast("string").alias("body")))  # null sorts first

    def under(row: Column) -> Column:
        before = F.slice(F.concat(F.array(F.element_at(row, 1)), row), 1, F.size(row))
        pairs = F.zip_with(before, row, lambda a, b: F.when(a["body"].isNull() & b["body"].isNotNull() & (a["start"] == b["start"]) & (a["end"] == b["end"]), unescape(b["body"])))
        return F.filter(pairs, lambda x: x.isNotNull())

    found = F.when(F.size(spans) == 0, F.array().cast("array<string>")).otherwise(let(F.array_sort(F.concat(marks, let(_pieces(formatted), placed))), under))
    singly = F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"])))
    return let(found, lambda texts: F.array_join(F.when(F.size(texts) == F.size(spans), texts).otherwise(singly), ""))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = r"\### Assistant: </turn> ok"
    own = spark.sql("SELECT -7L AS conv_id, explode(array(0L, 1L)) AS turn").select("conv_id", "turn", F.when(F.col("turn") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    chats = format_chats(canonical_turns(rows.unionByName(own)))
    back = chats.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('<turn ' || '>' || chr(10) || '</turn>' || chr(10))
           + length(replace(replace(replace(role, '\', '\s'), '<', '\l'), '>', '\g'))
           + length(replace(replace(text, '\', '\s'), '<', '\l')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
