"""Line dedup by a suffix array over line-ID sequences, DataFrame functions only.

A text's sequence is its \\n-split lines that hold a letter or digit, each named by two hashes
(96 bits). Equal texts are one sequence, that of the smallest doc_id. All suffixes of all
sequences are sorted by distributed prefix doubling: ranks after 1 line are refined to ranks
after 2, 4, 8, ... lines from pairs of ranks, until every suffix stands alone. A rank is the
place in the suffix array at which a class begins, so ranks of different rounds compare and
a suffix that stands alone is not sorted again. A line that occurs once stands alone from the
start and ends every run.

A round is a scan, not a join: rows go to ranges of (rank, next rank, place), each range
numbers its own classes, and two rows a range (its edges) go to the driver, which carries
counts and open classes from range to range. The order ends in the row's own place, so a
class as large as the table is spread over all ranges like any other.

Where a class splits, the rows beside the cut have a longest common prefix between the
lengths of the two rounds; ranks of the earlier rounds give it exactly, from the widest down
(``common_prefixes``). Suffixes of one interval of the array with common prefixes of n lines
or more begin with equal runs of n lines. ``maximal_runs`` are the runs that can be extended
to neither side and still occur twice.

A run counts when it has ``min_lines`` lines or ``min_words`` words. Of equal runs the first
by (doc_id, line) stays, later copies are deleted. Copies may overlap: a run that begins
later than an equal one is a later copy even where it lies inside the first, so of six equal
lines, which are four equal runs of three, one line is left. Each line of a longer run lies in a run of
at most ``min_lines`` lines that counts, so the deleted lines are the union over the
intervals of 1 to ``min_lines`` lines, and common prefixes are needed up to there only. Lines
without a letter or digit (blank, braces, rules) are in no run; they go if the nearest lines
with words before and after them go.

Text moves once, in the join that applies the result.

Defined cases: a null text has no lines and stays null; an empty text has one line without
words. Rows with equal doc_id and equal text are one document given twice: both get the same
result. A null doc_id comes first in order. An empty table gives an empty result. Very long
texts are taken whole; the work on one is linear in its lines, but for sorting. The input's
columns all stay, whatever their names.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamspark.llm.common import checkpointed, keyed_text

WORD_GAP = r"[\x20\x09-\x0D]+"
HOLDS_WORD = r"[\p{L}\p{N}]"
RUNS = "array<struct<first:int,last:int>>"
#: Places of the suffix array in a range of the last scan, at least, and ranges at most; a row of each goes to the driver.
BLOCK, MOST_BLOCKS = 1 << 17, 4096
#: Rows that a task of a round takes at least, so that late rounds over few rows have few tasks.
TASK_ROWS = 50_000


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _sequence(text: Column) -> Column:
    """Struct of arrays over the lines that hold a word: number, hashes and words of each."""
    lines = F.split(text, "\n", -1)
    words = lambda x: F.size(F.filter(F.split(x, WORD_GAP, -1), lambda w: w != ""))
    named = F.transform(lines, lambda x, i: F.when(x.rlike(HOLDS_WORD), F.struct(i.alias("ln"), F.xxhash64(x).alias("h1"), F.hash(x).alias("h2"), words(x).alias("w"))))
    return _let(F.filter(named, lambda s: s.isNotNull()), lambda s: F.struct(*[s[n].alias(n) for n in ("ln", "h1", "h2", "w")]))


def distinct_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """d, doc_id, t1, t2 and the sequence of each distinct text; d numbers them by smallest doc_id."""
    rows = keyed_text(df, id_col, text_col).where(F.col("text").isNotNull())
    keyed = rows.select("doc_id", F.xxhash64("text").alias("t1"), F.hash("text").alias("t2"), _sequence(F.col("text")).alias("s"))
    grouped = keyed.groupBy("t1", "t2").agg(F.min(F.struct("doc_id")).alias("least"), F.first("s").alias("s"))
    ordered = grouped.select("least.doc_id", "t1", "t2", "s.*").repartitionByRange("doc_id", "t1", "t2").sortWithinPartitions("doc_id", "t1", "t2")
    return checkpointed(ordered.withColumn("d", F.monotonically_increasing_id()))


# --- prefix doubling ------------------------------------------------------------------------


def _listed(rows: list[dict], schema: str) -> Column:
    """Rows as one literal array, a row a range, in the order of ``part``."""
    known = {x["part"]: x for x in rows}
    filled = [known.get(i, {}) for i in range(max(known, default=-1) + 1)]
    return F.from_json(F.lit(json.dumps(filled)), f"array<struct<{schema}>>")


def _dense(df: DataFrame, n: int) -> DataFrame:
    """``df`` of some n rows in no more tasks than they are worth; a narrow step, no shuffle."""
    return df.coalesce(n // TASK_ROWS + 1)


@dataclass
class Level:
    """One round: suffixes (d, c, r, open) with their ranks and whether others share them, the cuts it made, how many suffixes share ranks."""

    rows: DataFrame
    cuts: DataFrame
    span: int
    shared: int


def _refined(rows: DataFrame, keys: list[str], span: int, n: int, keep_alone: bool = True) -> Level:
    """Classes of equal (r, keys) among ``rows`` (d, c, r, keys); a null key stands alone.

    ``span`` is the number of lines that the two sides of a cut inside a class have in
    common at least, n the number of rows. Without ``keep_alone`` rows that stand alone are
    left out.
    """
    order = ["r", *keys, "d", "c"]
    by = W.partitionBy("part").orderBy(*order)
    upto = by.rowsBetween(W.unboundedPreceding, 0)
    equal = lambda side, names: F.coalesce(reduce(Column.__and__, [side(n).over(by) == F.col(n) for n in names]), F.lit(False))
    dealt = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    marked = _dense(dealt, n).select(
        "part", "d", "c", "r", F.struct(*keys).alias("key"),
        F.row_number().over(by).alias("at"),
        (~equal(F.lag, ["r"])).alias("opens"),
        (~equal(F.lag, ["r", *keys])).alias("begins"),
        equal(F.lead, ["r", *keys]).alias("more"),
        F.lead("d").over(by).isNull().alias("ends"),
        F.lag(F.struct("d", "c")).over(by).alias("before"),
        *keys,
    )
    # s1 and s2: where the class of r and that of (r, keys) begin in this range.
    placed = marked.select(
        "part", "d", "c", "r", "at", "more", "ends",
        F.max(F.when(F.col("opens"), F.col("at"))).over(upto).alias("s1"),
        F.max(F.when(F.col("begins"), F.col("at"))).over(upto).alias("s2"),
        F.when(F.col("begins") & ~F.col("opens"), F.col("before")).alias("before"),
        F.when((F.col("at") == 1) | F.col("ends"), F.col("key")).alias("edge"),
    )
    if not keep_alone:
        placed = placed.where((F.col("s2") < F.col("at")) | F.col("more") | F.col("edge").isNotNull())
    held = checkpointed(_dense(placed, n))
    edge = F.struct("at", "r", "edge", "s1", "s2", "d", "c")
    edges = held.groupBy("part").agg(F.min(edge).alias("first"), F.max(edge).alias("last"), F.count_if(F.col("more") | (F.col("s2") < F.col("at"))).alias("shared"))
    edges = _dense(edges, n).collect()
    carried = _carried(sorted(edges))  # a row a range
    listed = _listed(carried, "`offset` long,c1 long,c2 long,goes boolean,bd long,bc int")
    known = held.select("*", F.get(listed, F.col("part")).alias("x")).select(*held.columns, "x.*")
    g1 = F.when((F.col("s1") == 1) & F.col("c1").isNotNull(), F.col("c1")).otherwise(F.col("offset") + F.col("s1"))
    g2 = F.when((F.col("s2") == 1) & F.col("c2").isNotNull(), F.col("c2")).otherwise(F.col("offset") + F.col("s2"))
    here = F.col("offset") + F.col("at")
    open_ = (g2 != here) | F.col("more") | (F.col("ends") & F.col("goes"))
    before = F.when(F.col("at") == 1, F.struct(F.col("bd").alias("d"), F.col("bc").alias("c"))).otherwise(F.col("before"))
    final = known.select("d", "c", (F.col("r") + g2 - g1).alias("r"), open_.alias("open"), ((g2 == here) & (g1 != here)).alias("cut"), before.alias("before"))
    kept = final if keep_alone else final.where("open")
    cuts = final.where("cut").select(F.col("r").alias("g"), "d", "c", F.col("before.d").alias("bd"), F.col("before.c").alias("bc"), F.lit(span).alias("lcp"))
    return Level(kept.select("d", "c", "r", "open"), cuts, span, sum(x["shared"] for x in edges) + 2 * sum(x["goes"] for x in carried))


def _carried(edges: list) -> list[dict]:
    """For each range: rows before it, places where classes that run into it began, the row before it."""
    out: list[dict] = []
    offset, before, start1, start2 = 0, None, 0, 0
    for part, first, last, _ in edges:
        same1 = before is not None and before["r"] == first["r"]
        same2 = same1 and None not in tuple(first["edge"]) and tuple(before["edge"]) == tuple(first["edge"])
        if out:
            out[-1]["goes"] = same2
        c1, c2 = start1 if same1 else None, start2 if same2 else None
        out.append({"part": part, "offset": offset, "c1": c1, "c2": c2, "goes": False, "bd": before and before["d"], "bc": before and before["c"]})
        start1 = c1 if last["s1"] == 1 and same1 else offset + last["s1"]
        start2 = c2 if last["s2"] == 1 and same2 else offset + last["s2"]
        offset, before = offset + last["at"], last
    return out


def prefix_doubling(texts: DataFrame) -> list[Level]:
    """The rounds of sorting all suffixes of ``texts`` (d, h1, h2); lines that occur once are left out."""
    lines = texts.select("d", F.posexplode(F.arrays_zip("h1", "h2")).alias("c", "x")).select("d", "c", F.lit(0).cast("long").alias("r"), "x.h1", "x.h2")
    n = texts.agg(F.sum(F.size("h1"))).first()[0] or 0
    levels = [_refined(lines, ["h1", "h2"], 0, n, keep_alone=False)]
    done = levels[0].rows.where("false")
    while (n := levels[-1].shared):
        span = 1 << (len(levels) - 1)
        ahead = W.partitionBy("d").orderBy("c").rangeBetween(span, span)
        ranks = levels[-1].rows.unionByName(done)
        pairs = _dense(ranks.withColumn("ahead", F.max("r").over(ahead)).where("open"), n)
        # Computed above the coalesce, which a repartition right on it would drop.
        pairs = pairs.select("d", "c", "r", F.when(F.col("ahead") >= 0, F.col("ahead")).alias("r2"))
        done = done.unionByName(levels[-1].rows.where("not open"))
        levels.append(_refined(pairs, ["r2"], span, n))
    return levels


# --- suffix array, common prefixes, intervals ---------------------------------------------------


def suffix_array(levels: list[Level]) -> DataFrame:
    """(d, c, g): every suffix that begins with a repeated line, and its place."""
    return reduce(DataFrame.unionByName, [x.rows.where("not open") for x in levels]).select("d", "c", F.col("r").alias("g"))


def common_prefixes(levels: list[Level], limit: int | None = None) -> DataFrame:
    """(g, lcp): lines in common with the suffix before; places not named have none in common.

    With ``limit`` only up to there, which spares the looks into ranks that cannot matter.
    """
    found = [x.cuts for x in levels[1:] if limit is not None and x.span >= limit]
    exact: DataFrame | None = None
    for j in range(len(levels) - 2, -1, -1):
        cuts = levels[j + 1].cuts  # sides of these agree in 2**j lines, and differ within 2**(j + 1)
        if limit is None or levels[j + 1].span < limit:
            exact = cuts if exact is None else exact.unionByName(cuts)
        if exact is not None and j:
            exact = _advanced(exact, levels[j - 1])
    return reduce(DataFrame.unionByName, found + ([exact] if exact is not None else [])).select("g", "lcp") if found or exact is not None else levels[0].cuts.select("g", "lcp").where("false")


def _advanced(cuts: DataFrame, level: Level) -> DataFrame:
    """Common prefixes with the lines added that a level's classes show to be common behind them."""
    width = max(1, level.span * 2)
    shared = level.rows.where("open")
    at = lambda d, c, r: shared.select(F.col("d").alias(d), F.col("c").alias(c), F.col("r").alias(r))
    moved = cuts.withColumns({"c_": F.col("c") + F.col("lcp"), "bc_": F.col("bc") + F.col("lcp")})
    looked = moved.join(at("d", "c_", "ra"), ["d", "c_"], "left").join(at("bd", "bc_", "rb"), ["bd", "bc_"], "left")
    return looked.select("g", "d", "c", "bd", "bc", (F.col("lcp") + F.when(F.col("ra") == F.col("rb"), width).otherwise(0)).alias("lcp"))


def _blocked(levels: list[Level], limit: int | None = None) -> DataFrame:
    """(part, d, c, g, lcp), checkpointed: the array with common prefixes, in ranges of places."""
    found = suffix_array(levels).join(common_prefixes(levels, limit), "g", "left")
    held = checkpointed(_dense(found.select("d", "c", "g", F.coalesce("lcp", F.lit(0)).alias("lcp")), levels[0].shared))
    top = held.agg(F.max("g")).first()[0] or 0
    size = max(BLOCK, -(-top // MOST_BLOCKS))
    return held.withColumn("part", F.floor(F.col("g") / size).cast("int"))


def later_copies(blocks: DataFrame, lengths: int, size: int) -> DataFrame:
    """(d, c, n): runs of n = 1 to ``lengths`` lines that an earlier place has as well; ``size`` is the array's.

    For each n the array falls into intervals, each beginning at a place with a common
    prefix below n; all but the smallest (d, c) of an interval are later copies. An interval
    may run over many ranges: what ranges know of their first and last one is combined.
    """
    ns = range(1, lengths + 1)
    start = lambda n: F.when(F.col("lcp") < n, F.col("g"))
    last = blocks.groupBy("part").agg(*[F.max(start(n)).alias(f"e{n}") for n in ns])
    last = sorted(_dense(last, size).collect(), key=lambda x: x["part"])  # a row a range
    into, carry = [], [None] * lengths
    for row in last:
        into.append({"part": row["part"]} | {f"i{n}": carry[n - 1] for n in ns} | {f"e{n}": row[f"e{n}"] for n in ns})
        carry = [carry[n - 1] if row[f"e{n}"] is None else row[f"e{n}"] for n in ns]
    upto = W.partitionBy("part").orderBy("g").rowsBetween(W.unboundedPreceding, 0)
    fields = ",".join(f"i{n} long,e{n} long" for n in ns)
    listed = F.get(_listed(into, fields), F.col("part"))
    named = blocks.select("*", listed.alias("x")).select("part", "d", "c", "g", "lcp", "x.*").select(
        "part", "d", "c", *[F.coalesce(F.max(start(n)).over(upto), F.col(f"i{n}")).alias(f"k{n}") for n in ns], *[F.coalesce(f"e{n}", f"i{n}").alias(f"e{n}") for n in ns], *[f"i{n}" for n in ns]
    )
    place = F.struct("d", "c")
    ends = named.groupBy("part").agg(  # a row a range
        *[F.min(F.when(F.col(f"k{n}") == F.col(f"{side}{n}"), F.struct("d", "c", F.col(f"k{n}").alias("k")))).alias(f"{side}{n}") for n in ns for side in "ie"]
    )
    ends = _dense(ends, size).collect()
    over: dict[tuple[int, int], tuple[int, int]] = {}
    parts: dict[tuple[int, int], set[int]] = {}
    for row in ends:
        for n in ns:
            for m in (row[f"i{n}"], row[f"e{n}"]):
                if m is not None:
                    key = (n, m["k"])
                    parts.setdefault(key, set()).add(row["part"])
                    over[key] = min(over.get(key, (m["d"], m["c"])), (m["d"], m["c"]))
    rows = named
    for n in ns:
        crossing = [{f"k{n}": k, "o": {"d": dc[0], "c": dc[1]}} for (m, k), dc in over.items() if m == n and len(parts[m, k]) > 1]
        rows = rows.withColumn(f"m{n}", F.min(place).over(W.partitionBy("part", f"k{n}")))
        if crossing:
            made = rows.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(crossing)), f"array<struct<k{n}:long,o:struct<d:long,c:int>>>")))
            rows = rows.join(F.broadcast(made), f"k{n}", "left").withColumn(f"m{n}", F.coalesce("o", f"m{n}")).drop("o")
    lens = F.filter(F.array(*[F.when(place > F.col(f"m{n}"), F.lit(n)) for n in ns]), lambda n: n.isNotNull())
    return _dense(rows.select("d", "c", F.explode(lens).alias("n")), size)


def maximal_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, first, last, n_lines: every place of a run that recurs and that no line more, before or behind, lets recur.

    Of equal texts the one with the smallest doc_id is listed; ``first`` and ``last`` are
    line numbers, ``n_lines`` counts lines with words.
    """
    texts = distinct_texts(df, id_col, text_col)
    levels = prefix_doubling(texts)
    rows = _blocked(levels)
    # The longest run at a place recurs beside it in the array: before it, or behind it.
    behind = rows.select((F.col("g") - 1).alias("g"), F.col("lcp").alias("next"))
    longest = rows.join(behind, "g", "left").select("d", "c", F.greatest("lcp", F.coalesce("next", F.lit(0))).alias("n"))
    before = F.max("n").over(W.partitionBy("d").orderBy("c").rangeBetween(-1, -1))
    starts = longest.withColumn("p", before).where((F.col("n") > 0) & (F.coalesce("p", F.lit(0)) <= F.col("n")))
    return starts.join(texts.select("d", "doc_id", "ln"), "d").select(
        "doc_id", F.get("ln", F.col("c")).alias("first"), F.get("ln", F.col("c") + F.col("n") - 1).alias("last"), F.col("n").alias("n_lines")
    )


# --- deletion -------------------------------------------------------------------------------------


def _counts(w: Column, start: Column, n: Column, min_lines: int, min_words: int) -> Column:
    """Whether the run of n lines from ``start`` has lines or words enough."""
    return (n >= min_lines) | (F.aggregate(F.slice(w, start + 1, n), F.lit(0), lambda a, x: a + x) >= min_words)


def _stretches(covered: Column, ln: Column) -> Column:
    """Neighbouring numbers of a sorted array as stretches of line numbers."""

    def made(c: Column) -> Column:
        firsts = F.filter(c, lambda x, i: (i == 0) | (F.get(c, i - 1) != x - 1))
        lasts = F.filter(c, lambda x, i: (i == F.size(c) - 1) | (F.get(c, i + 1) != x + 1))
        return F.zip_with(firsts, lasts, lambda a, b: F.struct(F.get(ln, a).alias("first"), F.get(ln, b).alias("last")))

    return _let(covered, made)


def deleted_runs(texts: DataFrame, min_lines: int = 3, min_words: int = 10) -> DataFrame:
    """``texts`` (doc_id, t1, t2) with ``runs``: stretches of line numbers that are later copies."""
    levels = prefix_doubling(texts)
    copies = later_copies(_blocked(levels, min_lines), min_lines, levels[0].shared).groupBy("d").agg(F.collect_list(F.struct("c", "n")).alias("copies"))
    known = texts.select("d", "doc_id", "t1", "t2", "ln", "w").join(copies, "d", "left")
    counted = F.filter("copies", lambda x: _counts(F.col("w"), x["c"], x["n"], min_lines, min_words))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform(counted, lambda x: F.sequence(x["c"], x["c"] + x["n"] - 1)))))
    return known.select("doc_id", "t1", "t2", F.coalesce(_stretches(covered, F.col("ln")), F.array().cast(RUNS)).alias("runs"))


def _whole(text: Column, min_lines: int, min_words: int) -> Column:
    """The one stretch to delete of a text that an earlier document has."""
    none = F.array().cast(RUNS)
    words = lambda s: F.aggregate(s["w"], F.lit(0), lambda a, x: a + x)
    stretch = lambda s: F.array(F.struct(F.get(s["ln"], 0).alias("first"), F.get(s["ln"], F.size(s["ln"]) - 1).alias("last")))
    return _let(_sequence(text), lambda s: F.when((F.size(s["ln"]) > 0) & ((F.size(s["ln"]) >= min_lines) | (words(s) >= min_words)), stretch(s)).otherwise(none))


def _without(text: Column, runs: Column) -> Column:
    """A text less the lines of sorted stretches."""

    def kept(lines: Column) -> Column:
        # From behind each stretch (or the start) to before the next (or the end).
        froms = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["last"] + 1))
        tos = F.concat(F.transform(runs, lambda r: r["first"]), F.array(F.size(lines)))
        return F.flatten(F.zip_with(froms, tos, lambda a, b: F.slice(lines, a + 1, b - a)))

    return F.array_join(_let(F.split(text, "\n", -1), kept), "\n")


def dedup_lines(
    df: DataFrame, min_lines: int = 3, min_words: int = 10, id_col: str = "doc_id", text_col: str = "text", runs_col: str | None = None
) -> DataFrame:
    """``df``, with all columns, its text less later copies of runs.

    ``runs_col`` names a column to add, which must be a new name: the deleted stretches of
    line numbers.
    """
    if runs_col in df.columns:
        raise ValueError(f"the table has a column {runs_col}")
    runs = deleted_runs(distinct_texts(df, id_col, text_col), min_lines, min_words)
    own = F.col(f"row.`{text_col}`").cast("string")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    mine = rows.withColumns({"a1": F.xxhash64(own), "a2": F.hash(own)})
    here = F.col(f"row.`{id_col}`").eqNullSafe(F.col("doc_id")) & (F.col("a1") == F.col("t1")) & (F.col("a2") == F.col("t2"))
    # A text that is not its class's first is a copy of it as a whole.
    found = mine.join(runs, here, "left").select("row", F.when(own.isNull(), F.array().cast(RUNS)).otherwise(F.coalesce("runs", _whole(own, min_lines, min_words))).alias("gone"))
    text = F.when(F.size("gone") > 0, _without(own, F.col("gone"))).otherwise(own)
    columns = [text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in df.columns]
    return found.select(*columns, *([F.col("gone").alias(runs_col)] if runs_col else []))


def count_lines(runs: Column) -> Column:
    """Number of lines in stretches."""
    return F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"] + 1)
