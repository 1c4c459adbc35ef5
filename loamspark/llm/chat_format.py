"""Chat formatting by schema fingerprints, DataFrame functions only.

The nested field paths of a record (``messages[].role``) that any declared layout knows
are sorted and hashed; the hash selects a declarative mapping from that layout to canonical
turns, an array of (role, text). Where a record mixes fields of several layouts, the first
layout whose own paths have its hash is taken. A typed table has one fingerprint, taken from its schema;
a column of JSON records has one per row, taken from its keys.

Template: a turn is ``### role:\\n`` text ``\\n</turn>\\n``. Inside texts every backslash,
``###`` and ``</turn>`` gets a backslash before it, so the end mark, which follows a line
feed directly, cannot occur in a text, and one replacement restores it. Roles have % and
line feeds percent-encoded. The loss mask is a run-length code over the characters of the
output: three segments a turn (header, text, end mark), set for texts of ``assistant``.

Defined cases: a null text or role is empty. Turns are ordered by (turn, role, text), nulls
first; repeated rows stay. A record whose fingerprint no layout has gets null turns and null
output. Fields that no layout knows, whatever their names, do not count. An empty array of
turns gives an empty output, a null element of one an empty turn, an empty table an empty
result. A null conv_id is a conversation like any other. Texts of any length are taken whole;
a conversation is one row of the output and is held in one task.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

END = "\n</turn>\n"
CONTROL = r"(\\|###|</turn>)"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """Where a layout keeps its turns: an array of objects, fixed fields, or one row a turn."""

    name: str
    array: str | None = None
    role: str | None = None
    text: str | None = None
    #: (role, fields joined by a blank line) in order; for layouts without an array.
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ()
    #: Columns (conversation, turn) for layouts with one row a turn.
    rows: tuple[str, str] | None = None
    renamed: dict[str, str] = field(default_factory=dict, hash=False)

    def paths(self) -> list[str]:
        if self.rows:
            return sorted([self.rows[1], self.role, self.text])
        if self.array:
            return sorted([self.array, f"{self.array}[].{self.role}", f"{self.array}[].{self.text}"])
        return sorted(f for _, fields in self.fixed for f in fields)

    def variants(self) -> list[list[str]]:
        """The path lists that select this layout: with and without each optional field."""
        out = [self.paths()]
        for name in self.optional:
            out += [[p for p in ps if p != name] for ps in out]
        return out


ALIASES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}
LAYOUTS = (
    Layout("turn_rows", role="role", text="text", rows=("conv_id", "turn")),
    Layout("messages", array="messages", role="role", text="content", renamed=ALIASES),
    Layout("from_value", array="conversations", role="from", text="value", renamed=ALIASES),
    Layout("turns", array="turns", role="speaker", text="utterance", renamed=ALIASES),
    Layout("instruction", fixed=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("system", "input")),
    Layout("prompt_completion", fixed=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt_response", fixed=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question_answer", fixed=(("user", ("question",)), ("assistant", ("answer",)))),
)


def fingerprint(paths: list[str]) -> str:
    """Hash of sorted field paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def _known(layouts: tuple[Layout, ...]) -> list[str]:
    return sorted({p for layout in layouts for p in layout.paths()})


def _selected(layouts: tuple[Layout, ...]) -> dict[str, Layout]:
    return {fingerprint(v): layout for layout in reversed(layouts) for v in layout.variants()}


def schema_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """The nested field paths of a table's schema."""
    out = []
    for f in schema.fields:
        kind, path = f.dataType, prefix + f.name
        out.append(path)
        if isinstance(kind, T.ArrayType):
            kind, path = kind.elementType, path + "[]"
        if isinstance(kind, T.StructType):
            out += schema_paths(kind, path + ".")
    return out


def layout_of(schema: T.StructType, layouts: tuple[Layout, ...] = LAYOUTS) -> Layout | None:
    """The layout that the fingerprint of a schema's known paths selects."""
    paths, known = schema_paths(schema), set(_known(layouts))
    exact = _selected(layouts).get(fingerprint([p for p in paths if p in known]))
    if exact:
        return exact
    own = lambda x: fingerprint([p for p in paths if p in x.paths()])
    return next((x for x in layouts if own(x) in map(fingerprint, x.variants())), None)


def json_paths(payload: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The known field paths of one JSON record, sorted."""
    tops = F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>"))
    nested = [F.transform(_element_keys(payload, a), _prefixed(f"{a}[].")) for a in sorted({x.array for x in layouts if x.array})]
    known = F.array(*[F.lit(p) for p in _known(layouts)])
    return F.array_sort(F.array_intersect(F.concat(tops, *nested), known))


def _element_keys(payload: Column, array: str) -> Column:
    rows = F.from_json(F.get_json_object(payload, f"$.{array}"), "array<map<string,string>>")
    none = F.array().cast("array<string>")
    return F.coalesce(F.flatten(F.transform(rows, lambda m: F.coalesce(F.map_keys(m), none))), none)


def _prefixed(prefix: str):
    return lambda k: F.concat(F.lit(prefix), k)


def path_hash(paths: Column, known: list[str] | None = None) -> Column:
    """Hash of sorted paths, or of those among them that are known."""
    if known is not None:
        paths = F.array_sort(F.array_intersect(paths, F.array(*[F.lit(p) for p in known])))
    return F.sha2(F.array_join(paths, "\n"), 256)


def json_fingerprint(payload: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    return path_hash(json_paths(payload, layouts))


def _turn(role: Column, text: Column, layout: Layout) -> Column:
    role = F.coalesce(role.cast("string"), F.lit(""))
    for old, new in layout.renamed.items():
        role = F.when(role == old, F.lit(new)).otherwise(role)
    return F.struct(role.alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _fixed_turns(layout: Layout, value) -> Column:
    """Turns from single fields; optional fields that are empty are left out."""
    turns = []
    for role, names in layout.fixed:
        parts = [F.nullif(value(n), F.lit("")) for n in names]
        text = F.concat_ws("\n\n", *parts)
        turn = _turn(F.lit(role), text, layout)
        turns.append(F.when(F.lit(not set(names) <= set(layout.optional)) | (text != ""), turn))
    return F.filter(F.array(*turns), lambda t: t.isNotNull()).cast(TURNS)


def turns_from_json(payload: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Canonical turns of JSON records of mixed layouts; null where no layout fits."""
    layouts = tuple(x for x in layouts if not x.rows)
    paths = json_paths(payload, layouts)
    exact, looser = F.lit(None).cast(TURNS), F.lit(None).cast(TURNS)
    for layout in reversed(layouts):
        if layout.array:
            rows = F.from_json(F.get_json_object(payload, f"$.{layout.array}"), "array<map<string,string>>")
            turns = F.transform(rows, _map_turn(layout)).cast(TURNS)
        else:
            turns = _fixed_turns(layout, lambda n: F.get_json_object(payload, f"$.{n}"))
        marks = [fingerprint(v) for v in layout.variants()]
        exact = F.when(path_hash(paths).isin(marks), turns).otherwise(exact)
        looser = F.when(path_hash(paths, layout.paths()).isin(marks), turns).otherwise(looser)
    return F.coalesce(exact, looser)


def _map_turn(layout: Layout):
    return lambda m: _turn(F.try_element_at(m, F.lit(layout.role)), F.try_element_at(m, F.lit(layout.text)), layout)


def canonical_turns(df: DataFrame, id_col: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS, payload: str | None = None) -> DataFrame:
    """conv_id, turns: by the table's own fingerprint, or by each row's if ``payload`` names a JSON column."""
    if payload:
        return df.select(F.col(id_col).alias("conv_id"), turns_from_json(F.col(payload), layouts).alias("turns"))
    layout = layout_of(df.schema, layouts)
    if layout is None:
        return df.select(F.col(id_col).alias("conv_id"), F.lit(None).cast(TURNS).alias("turns"))
    if layout.rows:
        key, order = layout.rows
        rows = df.select(F.col(key).alias("conv_id"), F.struct(F.col(order).alias("o"), F.col(layout.role).alias("role"), F.col(layout.text).alias("text")).alias("row"))
        grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
        return grouped.select("conv_id", F.transform("rows", lambda r: _turn(r["role"], r["text"], layout)).cast(TURNS).alias("turns"))
    if layout.array:
        turns = F.transform(F.col(layout.array), lambda r: _turn(r[layout.role], r[layout.text], layout)).cast(TURNS)
    else:
        turns = _fixed_turns(layout, lambda n: F.col(n).cast("string") if n in df.columns else F.lit(None).cast("string"))
    return df.select(F.col(id_col).alias("conv_id"), turns.alias("turns"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\" + CONTROL, "$1")


def _header(role: Column) -> Column:
    safe = F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))
    return F.concat(F.lit("### "), safe, F.lit(":\n"))


def format_turns(df: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask: array of (chars, loss) segments."""
    pieces = df.select("conv_id", F.transform("turns", lambda t: F.struct(_header(t["role"]).alias("h"), escape(t["text"]).alias("t"), (t["role"] == "assistant").alias("loss"))).alias("p"))
    segment = lambda chars, loss: F.struct(chars.alias("chars"), loss.alias("loss"))
    return pieces.select(
        "conv_id",
        F.array_join(F.transform("p", lambda x: F.concat(x["h"], x["t"], F.lit(END))), "").alias("formatted"),
        F.flatten(
            F.transform(
                "p",
                lambda x: F.array(segment(F.length(x["h"]), F.lit(False)), segment(F.length(x["t"]), x["loss"]), segment(F.lit(len(END)), F.lit(False))),
            )
        ).alias("loss_mask"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns that an output states, restored."""
    pieces = F.split(formatted, END, -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        header = F.substring_index(piece, "\n", 1)
        role = F.substring(header, F.lit(5), F.length(header) - 5)
        role = F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))
        text = F.substring(piece, F.length(header) + 2, F.length(piece))
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def masked_text(formatted: Column, loss_mask: Column) -> Column:
    """All text under the loss mask, unescaped text by text and joined."""
    pieces = F.split(formatted, END, -1)
    texts = F.transform(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        lambda p, i: F.when(
            F.get(loss_mask, 3 * i + 1)["loss"],
            unescape(F.substring(p, F.get(loss_mask, 3 * i)["chars"] + 1, F.get(loss_mask, 3 * i + 1)["chars"])),
        ).otherwise(F.lit("")),
    )
    return F.array_join(texts, "")


def format_chat(df: DataFrame, id_col: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS, payload: str | None = None) -> DataFrame:
    """conv_id, formatted, loss_mask of a table in any declared layout."""
    return format_turns(canonical_turns(df, id_col, layouts, payload))
