"""Repair of conversation structure by error-correcting Earley parsing over a weighted role grammar.

A sound conversation reads ``(s?(ua)+)?`` in the initials of its roles. The grammar below
says so with left-linear rules, and every terminal has error productions: a row may be kept
(K, free), given another role (R), deleted (D), or a row may be inserted (I) before it. A
chart column holds the completed items with the minimum (cost, audit) of each, audit being
the initials of the edits so far; as the rules are left-linear, every item begins at column
0 and a column never has more items than the grammar has nonterminals.

Long conversations are parsed in segments of ``SEGMENT`` rows, in many tasks: a segment is
parsed once from each nonterminal that may be complete before it, which gives a small
matrix of (cost, audit). Inserted rows belong to the row they stand before, so two audits
of one segment end with as many rows, none is a beginning of another, and their ranks
inside the segment decide between audits of whole conversations. Levels of ``FANOUT``
matrices are folded until each conversation has one; the cheapest accepted entry is then
traced back to the segments. No task holds more than ``SEGMENT`` rows or ``FANOUT``
matrices, whatever a conversation's length; only the audit, which the report states as one
string, and the digest over all its text, a stream through one task, follow its length.

Rows are in the order of turn (nulls first), role, text. A row's first fault counts: blank
(no character but white space), duplicate (role and text seen earlier), truncated (last
such character is none of ``.!?``).

Defined cases: a null role or text is one space, so it is blank or fits no role. A null
conversation id is a conversation of its own. Ties of turn are ordered by role and text;
repeated rows are duplicates. A conversation of deleted rows only is repaired to nothing.
Very long texts are taken whole. Other columns do not matter, whatever their names. An
empty table gives empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamspark.llm.common import checkpointed

#: (made, from, terminal): ``made`` is complete when ``from`` is and the terminal follows.
RULES = (("headed", "open", "s"), ("asked", "open", "u"), ("asked", "headed", "u"), ("asked", "even", "u"), ("even", "asked", "a"))
STATES = ("open", "headed", "asked", "even")
START, ACCEPTED = "open", ("open", "even")
#: Terminals that edits can make, with the role they make.
MADE = {"u": "user", "a": "assistant"}
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
SEGMENT, FANOUT = 512, 64
SPACE = r"\x20\x09-\x0D"
SOUND, BLANK, DUPLICATE, CUT = 0, 1, 2, 3

#: An item's value: cost, audit (edit initials), walk (the same with roles: inserted u/a, K, made U/A, D).
Item = tuple[int, str, str]


def _put(column: dict[str, Item], state: str, item: Item) -> bool:
    if state not in column or item[:2] < column[state][:2]:
        column[state] = item
        return True
    return False


def completed(column: dict[str, Item]) -> dict[str, Item]:
    """The column with all that insert productions complete in it."""
    out, agenda = dict(column), list(column)
    while agenda:
        at = agenda.pop()
        cost, audit, walk = out[at]
        for made, before, terminal in RULES:
            if before == at and terminal in MADE and _put(out, made, (cost + INSERT, audit + "I", walk + terminal)):
                agenda.append(made)
    return out


def scanned(column: dict[str, Item], initial: str, fault: int) -> dict[str, Item]:
    """The next column: the row deleted, kept as its terminal, or given a role."""
    out: dict[str, Item] = {}
    for at, (cost, audit, walk) in completed(column).items():
        _put(out, at, (cost + DELETE, audit + "D", walk + "D"))
        if fault in (BLANK, DUPLICATE):
            continue
        more = TRUNCATED if fault == CUT else 0
        for made, before, terminal in RULES:
            if before == at:
                if terminal == initial:
                    _put(out, made, (cost + more, audit + "K", walk + "K"))
                if terminal in MADE:
                    _put(out, made, (cost + more + REROLE, audit + "R", walk + terminal.upper()))
    return out


def parse(rows: list[tuple[str, int]], enter: str = START) -> dict[str, Item]:
    """The last column of the chart over (initial, fault) rows, without trailing inserts."""
    column: dict[str, Item] = {enter: (0, "", "")}
    for initial, fault in rows:
        column = scanned(column, initial, fault)
    return column


def closing(state: str) -> Item | None:
    """What must be inserted after the last row for the chart to be accepted."""
    ends = completed({state: (0, "", "")})
    return min((ends[s] for s in ACCEPTED if s in ends), default=None)


_MATRIX = "cost long, grade int, enter string, leave string, walk string"


def _charts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of rows into their matrices: one list of entries a segment."""
    for batch in batches:
        made = {n: [] for n in ("cost", "grade", "enter", "leave", "walk")}
        counts = []
        for seg, initials, faults in zip(*(batch.column(n).to_pylist() for n in ("seg", "initials", "faults")), strict=True):
            rows = list(zip(initials, faults, strict=True))
            entries = [(enter, leave, *item) for enter in ((START,) if seg == 0 else STATES) for leave, item in parse(rows, enter).items()]
            grades = {a: g for g, a in enumerate(sorted({e[3] for e in entries}))}
            counts.append(len(entries))
            for enter, leave, cost, audit, walk in entries:
                for name, value in (("cost", cost), ("grade", grades[audit]), ("enter", enter), ("leave", leave), ("walk", walk)):
                    made[name].append(value)
        yield _repeated(batch.select(["c", "seg"]), counts, made)


def _repeated(keys: pa.RecordBatch, counts: list[int], made: dict[str, list]) -> pa.RecordBatch:
    import numpy as np

    taken = keys.take(pa.array(np.repeat(np.arange(len(counts)), counts)))
    types = {"cost": pa.int64(), "grade": pa.int32()}
    arrays = [pa.array(v, type=types.get(k, pa.list_(pa.string()) if k == "path" else pa.string())) for k, v in made.items()]
    return pa.RecordBatch.from_arrays([*taken.columns, *arrays], names=[*taken.schema.names, *made])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to ``FANOUT`` matrices in a row into one; ``path`` has the state after each of them."""
    for batch in batches:
        made = {n: [] for n in ("cost", "grade", "enter", "leave", "path")}
        counts = []
        for seg, entries in zip(batch.column("seg").to_pylist(), batch.column("entries").to_pylist(), strict=True):
            children: dict[int, list[dict]] = {}
            for e in entries:
                children.setdefault(e["seg"], []).append(e)
            found = []
            for enter in (START,) if seg == 0 else STATES:
                column = {enter: (0, (), ())}
                for at in sorted(children):
                    after: dict[str, tuple] = {}
                    for e in children[at]:
                        if e["enter"] in column:
                            cost, grades, path = column[e["enter"]]
                            item = (cost + e["cost"], (*grades, e["grade"]), (*path, e["leave"]))
                            if e["leave"] not in after or item[:2] < after[e["leave"]][:2]:
                                after[e["leave"]] = item
                    column = after
                found += [(enter, leave, *item) for leave, item in column.items()]
            order = {g: n for n, g in enumerate(sorted({f[3] for f in found}))}
            counts.append(len(found))
            for enter, leave, cost, grades, path in found:
                for name, value in (("cost", cost), ("grade", order[grades]), ("enter", enter), ("leave", leave), ("path", list(path))):
                    made[name].append(value)
        yield _repeated(batch.select(["c", "seg"]), counts, made)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of the lines of each conversation, joined by newlines, of a stream sorted by conversation and place."""
    name, state, lines = None, None, 0

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"c": [name], "digest": [state.hexdigest()], "lines": [lines]})

    for batch in batches:
        for c, line in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if c != name or state is None:
                if state is not None:
                    yield done()
                name, state, lines = c, hashlib.sha256(), 0
            state.update((b"\n" if lines else b"") + line.as_py().encode("utf-8", "surrogatepass"))
            lines += 1
    if state is not None:
        yield done()


def conversation_key(col: Column) -> Column:
    """An id as a text that no other id has; the null id has one too."""
    return F.when(col.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), col.cast("string")))


def in_order(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """c, turn, role, text and pos, the row's place in its conversation from 0.

    Rows are sorted by ranges over the whole table, so a conversation of any length spreads
    over tasks; places are offsets inside a range plus the rows of earlier ranges.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select(conversation_key(F.col(id_col)).alias("c"), F.col(turn_col).alias("turn"), filled(role_col).alias("role"), filled(text_col).alias("text"))
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("uid")]
    ranges = rows.withColumn("uid", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = checkpointed(ranges.drop("uid").withColumn("at", F.monotonically_increasing_id()).withColumn("range", F.spark_partition_id()))
    here = placed.groupBy("c", "range").agg(F.min("at").alias("lo"), F.count("*").alias("n"))
    earlier = Window.partitionBy("c").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = here.select("c", "range", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("lo")).alias("shift"))
    return placed.join(offsets, ["c", "range"]).select("c", "turn", "role", "text", (F.col("at") + F.col("shift")).alias("pos"))


def with_faults(rows: DataFrame) -> DataFrame:
    """``in_order`` rows with initial and fault."""
    marked = rows.withColumn("k", F.sha2(F.concat("c", F.lit("\n"), F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    repeated = marked.groupBy("k").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").select("k", "first")
    fault = (
        F.when(~F.col("text").rlike(f"[^{SPACE}]"), BLANK)
        .when(F.col("pos") > F.col("first"), DUPLICATE)
        .when(~F.col("text").rlike(rf"[.!?][{SPACE}]*\z"), CUT)
        .otherwise(SOUND)
    )
    return marked.join(repeated, "k", "left").select("c", "turn", "role", "text", "pos", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


@dataclass
class Repair:
    """``rows``: the damaged rows in order with faults; ``report``: one row a conversation; ``lines``: the repaired rows."""

    rows: DataFrame
    report: DataFrame
    lines: DataFrame


def repair(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment: int = SEGMENT, fanout: int = FANOUT) -> Repair:
    """Faults, cheapest edits and repaired rows of all conversations (``c`` is ``conversation_key`` of the id)."""
    rows = checkpointed(with_faults(in_order(df, id_col, turn_col, role_col, text_col)))
    seg = F.floor(F.col("pos") / segment).cast("long")
    entry = F.array_sort(F.collect_list(F.struct("pos", "initial", "fault")))
    segments = checkpointed(
        rows.groupBy("c", seg.alias("seg"))
        .agg(entry.alias("e"))
        .select("c", "seg", F.col("e.initial").alias("initials"), F.col("e.fault").alias("faults"))
    )
    id_fields = "c string, seg long"
    charts = checkpointed(segments.mapInArrow(_charts, f"{id_fields}, {_MATRIX}"))
    levels = [charts.select("c", "seg", "cost", "grade", "enter", "leave")]
    while (levels[-1].agg(F.max("seg")).first()[0] or 0) > 0:
        groups = levels[-1].groupBy("c", F.floor(F.col("seg") / fanout).cast("long").alias("above")).agg(F.collect_list(F.struct("seg", "cost", "grade", "enter", "leave")).alias("entries"))
        levels.append(checkpointed(groups.select("c", F.col("above").alias("seg"), "entries").mapInArrow(_folded, f"{id_fields}, cost long, grade int, enter string, leave string, path array<string>")))

    # The cheapest accepted entry of each conversation, then what it enters and leaves segment by segment.
    ends = {s: closing(s) for s in STATES}
    pick = lambda i: F.coalesce(*[F.when(F.col("leave") == s, F.lit(e[i])) for s, e in ends.items() if e])
    top = levels[-1].select("c", "leave", F.struct((F.col("cost") + pick(0)).alias("cost"), "grade", F.struct(F.lit(START).alias("enter"), "leave", pick(2).alias("closing")).alias("of")).alias("best"))
    best = checkpointed(top.groupBy("c").agg(F.min("best").alias("best")))
    chosen = best.select("c", F.lit(0).cast("long").alias("seg"), F.col("best.of.enter").alias("enter"), F.col("best.of.leave").alias("leave"))
    for level in reversed(levels[1:]):
        steps = level.join(chosen, ["c", "seg", "enter", "leave"]).select("c", "seg", "enter", F.posexplode("path").alias("i", "leave"), "path")
        before = F.when(F.col("i") == 0, F.col("enter")).otherwise(F.element_at("path", F.greatest(F.col("i"), F.lit(1))))
        chosen = steps.select("c", (F.col("seg") * fanout + F.col("i")).alias("seg"), before.alias("enter"), "leave")
    walks = checkpointed(charts.join(chosen, ["c", "seg", "enter", "leave"]).select("c", "seg", "walk"))

    # Edits of rows: each row with what is inserted before it; the closing ones after the last.
    steps = walks.select("c", (F.col("seg") * segment).alias("from"), F.posexplode(F.expr("regexp_extract_all(walk, '[ua]*[DKUA]', 0)")).alias("i", "step"))
    edits = steps.select("c", (F.col("from") + F.col("i")).alias("pos"), "step")
    added = lambda walk: F.transform(F.filter(F.split(walk, ""), lambda x: x.isin(*MADE)), lambda x: F.struct(_role(x).alias("role"), F.lit("").alias("text")))
    own = F.right("step", F.lit(1))
    kept = F.when(own == "D", F.array()).otherwise(F.array(F.struct(F.when(own == "K", F.col("role")).otherwise(_role(F.lower(own))).alias("role"), F.col("text").alias("text"))))
    edited = rows.join(edits, ["c", "pos"]).select("c", "pos", F.posexplode(F.concat(added(F.col("step")), kept)).alias("part", "row"))
    size = rows.groupBy("c").agg(F.max("pos").alias("pos"))
    ended = best.where("best.of.closing != ''").join(size, "c").select("c", (F.col("pos") + 1).alias("pos"), F.posexplode(added(F.col("best.of.closing"))).alias("part", "row"))
    lines = edited.unionByName(ended).select("c", "pos", "part", "row.role", "row.text")

    audit = walks.groupBy("c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "walk"))), lambda s: s["walk"]), "").alias("walk"))
    after = Window.partitionBy("c").orderBy("seg")
    pairs = F.when(F.size("initials") > 1, F.arrays_zip(F.slice("initials", F.lit(1), F.size("initials") - 1).alias("l"), F.slice("initials", F.lit(2), F.size("initials") - 1).alias("r"))).otherwise(F.array())
    legal = lambda x, y: F.concat(x, F.lit("|"), y).isin("s|u", "u|a", "a|u")
    inside = F.size(F.filter(pairs, lambda p: ~legal(p["l"], p["r"])))
    last = F.lag(F.element_at("initials", -1)).over(after)
    edge = F.when(last.isNotNull() & ~legal(last, F.element_at("initials", 1)), 1).otherwise(0)
    illegal = segments.select("c", (inside + edge).alias("illegal")).groupBy("c").agg(F.sum("illegal").alias("illegal"))
    turns = rows.groupBy("c", "turn").agg(*[F.sum((F.col("fault") == k).cast("long")).alias(n) for k, n in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (CUT, "truncated"))])
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    counts = turns.groupBy("c").agg(gaps.alias("gaps"), *[F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")])
    whole = F.concat("walk", "best.of.closing")
    report = (
        counts.join(illegal, "c").join(best, "c").join(audit, "c")
        .select("c", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"), F.translate(whole, "uaUA", "IIRR").alias("audit"))
    )
    return Repair(rows, report, lines)


def _role(terminal: Column) -> Column:
    return F.coalesce(*[F.when(terminal == t, F.lit(r)) for t, r in MADE.items()])


def line_digests(lines: DataFrame) -> DataFrame:
    """c, digest: sha256 of the repaired ``role:text`` rows, newline-joined; one stream for each conversation."""
    stream = lines.select("c", F.concat("role", F.lit(":"), "text").alias("line"), "pos", "part").repartition("c").sortWithinPartitions("c", "pos", "part")
    return stream.mapInArrow(_digests, "c string, digest string, lines long").select("c", "digest")
