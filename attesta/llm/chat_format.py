"""Chat formatting by schema fingerprints.

The nested field paths of a source are hashed; the fingerprint selects a
declared layout, which says how prompt, instruction or message fields become
canonical turns (conv_id, turn, role, text).  Tables are fingerprinted by their
schema, JSON texts each by the shape of its own value.

The template writes a turn as TURN role TEXT text END.  Inside roles and texts a
backslash is doubled and a control string gets a backslash behind its first
character, so no control string of the output comes from a text, and reading
back drops one backslash of each pair or lone one.  ``loss_start`` and
``loss_end`` bound the text of an assistant's turn within its segment.

Rows: null role or text counts as empty; turns of a conversation are ordered by
turn (nulls first), then role, then text; repeated rows are turns of their own;
rows whose conv_id is null form one conversation; an empty table gives an empty
table; columns that no layout names are ignored.  A table that fits several
layouts takes the first; one that fits none is refused.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings that are escaped inside texts.
CONTROLS = [TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>"]
_AHEAD = "|".join(re.escape(c[1:]) for c in CONTROLS)
SEGMENT = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)


@dataclass(frozen=True)
class Layout:
    """How a source's fields become turns: a row each, a list of messages, or one field a turn."""

    name: str
    key: str
    kind: str  # rows, list or fields
    array: str = ""
    role: str = ""
    text: str = ""
    turn: str = ""
    fields: tuple[tuple[str, str], ...] = ()  # (role, field); fields of one role are joined by a blank line
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    @property
    def paths(self) -> list[str]:
        if self.kind == "rows":
            return [self.key, self.turn, self.role, self.text]
        if self.kind == "list":
            return [self.key, f"{self.array}[].{self.role}", f"{self.array}[].{self.text}"]
        return [self.key, *(f for _, f in self.fields)]


LAYOUTS = [
    Layout("turn rows", "conv_id", "rows", turn="turn", role="role", text="text"),
    Layout("messages", "id", "list", array="messages", role="role", text="content"),
    Layout("conversations", "id", "list", array="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"}),
    Layout("instruction with input", "id", "fields", fields=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("instruction", "id", "fields", fields=(("user", "instruction"), ("assistant", "output"))),
    Layout("prompt and response", "id", "fields", fields=(("user", "prompt"), ("assistant", "response"))),
    Layout("prompt and completion", "id", "fields", fields=(("user", "prompt"), ("assistant", "completion"))),
]


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """The paths of a type's leaves; [] stands for the elements of an array."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, at + "[]")
    return [at]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(x.paths): x for x in LAYOUTS}
VOCABULARY = {p for x in LAYOUTS for p in x.paths}


def layout_of(schema: T.StructType) -> Layout:
    """The layout of the schema's fingerprint over the paths that any layout names."""
    paths = field_paths(schema)
    found = BY_FINGERPRINT.get(fingerprint([p for p in paths if p in VOCABULARY]))
    found = found or next((x for x in LAYOUTS if set(x.paths) <= set(paths)), None)
    if found is None:
        raise ValueError(f"no layout for {sorted(paths)}")
    return found


def _role(layout: Layout, role: Column) -> Column:
    out = role
    for theirs, ours in layout.roles.items():
        out = F.when(role == theirs, F.lit(ours)).otherwise(out)
    return out


def _turn_array(layout: Layout, get) -> Column:
    """The turns of a record of kind list or fields; get(name) is its column."""
    if layout.kind == "list":
        return F.transform(get(layout.array), lambda m: F.struct(_role(layout, m[layout.role]).alias("role"), m[layout.text].alias("text")))
    turns: dict[str, list[Column]] = {}
    for role, name in layout.fields:
        turns.setdefault(role, []).append(F.nullif(get(name), F.lit("")))
    return F.array(*(F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *texts).alias("text")) for role, texts in turns.items()))


def to_turns(source: DataFrame) -> DataFrame:
    """Canonical turns (conv_id, turn, role, text) of a table of any declared layout."""
    layout = layout_of(source.schema)
    if layout.kind == "rows":
        return source.select(F.col(layout.key).alias("conv_id"), F.col(layout.turn).cast("long").alias("turn"), F.col(layout.role).alias("role"), F.col(layout.text).alias("text"))
    rows = source.select(F.col(layout.key).alias("conv_id"), F.posexplode(_turn_array(layout, F.col)).alias("turn", "t"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


def json_to_turns(source: DataFrame, key: str, json: str) -> DataFrame:
    """Canonical turns of JSON records, each by the fingerprint of its own shape.

    Returns (conv_id, turn, role, text, layout); records that aren't JSON or have
    an unknown shape keep one row with null turn and layout.
    """

    def shape(layout: Layout) -> str:
        if layout.kind == "list":
            inner = ", ".join(f"{n}: " for n in sorted((layout.role, layout.text)))
            return f"OBJECT<{layout.array}: ARRAY<OBJECT<{inner}>>>"
        return "OBJECT<" + ", ".join(f"{n}: " for n in sorted(f for _, f in layout.fields)) + ">"

    of = F.sha2(F.regexp_replace(F.schema_of_variant(F.try_parse_json(F.col(json))), "STRING|VOID", ""), 256)
    rows = source.select(F.col(key).alias("conv_id"), F.col(json).alias("json"), of.alias("shape"))
    turns, name = F.lit(None).cast("array<struct<role:string,text:string>>"), F.lit(None).cast("string")
    for layout in LAYOUTS[1:]:
        schema = f"{layout.array} array<struct<`{layout.role}`:string,`{layout.text}`:string>>" if layout.kind == "list" else ", ".join(f"`{f}` string" for _, f in layout.fields)
        parsed = F.from_json("json", schema)
        fits = F.col("shape") == hashlib.sha256(shape(layout).encode()).hexdigest()
        turns, name = F.when(fits, _turn_array(layout, parsed.getField)).otherwise(turns), F.when(fits, F.lit(layout.name)).otherwise(name)
    rows = rows.select("conv_id", name.alias("layout"), F.posexplode_outer(turns).alias("turn", "t"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text", "layout")


def escaped(text: Column) -> Column:
    doubled = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\")
    return F.regexp_replace(doubled, rf"([<\[])(?={_AHEAD})", r"$1\\")


def unescape(text: str) -> str:
    return re.sub(r"\\(\\|)", r"\1", text) if "\\" in text else text


def segments(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, segment, loss_start, loss_end): a formatted segment each turn; a conversation is its segments in order."""
    role, text = escaped(F.col("role")), escaped(F.col("text"))
    head = F.concat(F.lit(TURN), role, F.lit(TEXT))
    loss = F.col("role") == "assistant"
    return turns.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.concat(head, text, F.lit(END)).alias("segment"),
        F.when(loss, F.char_length(head)).alias("loss_start"),
        F.when(loss, F.char_length(head) + F.char_length(text)).alias("loss_end"),
    )


def in_order(formatted: DataFrame) -> DataFrame:
    """A conversation's segments in one partition, one behind the other."""
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def digests(formatted: DataFrame) -> DataFrame:
    """Each conversation as read back from its segments: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).

    Segments stream past running hashes, so a conversation of any length takes
    the memory of one batch.
    """
    schema = T.StructType(
        [
            T.StructField("conv_id", formatted.schema["conv_id"].dataType),
            T.StructField("n_turns", T.LongType()),
            T.StructField("turns_sha256", T.StringType()),
            T.StructField("loss_chars", T.LongType()),
            T.StructField("loss_sha256", T.StringType()),
            T.StructField("formatted_chars", T.LongType()),
        ]
    )

    def run(batches):
        rows, state = [], None

        def close():
            conv, n, turns, chars, loss, total = state
            rows.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), total))

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=schema.names)

        types = None
        for batch in batches:
            types = types or [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            for conv, segment, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or state[0] != conv:
                    if state is not None:
                        close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = map(unescape, SEGMENT.fullmatch(segment).groups())
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    masked = unescape(segment[start:end])
                    state[3] += len(masked)
                    state[4].update(masked.encode())
                state[5] += len(segment)
            if rows:
                yield batch_of(rows)
                rows.clear()
        if state is not None:
            close()
            yield batch_of(rows)

    return in_order(formatted).select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(run, schema)
