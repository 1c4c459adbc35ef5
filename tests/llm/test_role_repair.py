"""Conversation structure repair against exhaustive search and against a plain reading of the whole query."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from loamspark.llm import queries_records, role_repair
from loamspark.llm.common import read_table

ROLES = {"u": "user", "a": "assistant"}
WHITE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, repaired lines) over all edit sequences, by dynamic programming over plain strings of roles."""
    steps = {"": {"s": "S", "u": "U"}, "S": {"u": "U"}, "U": {"a": "A"}, "A": {"u": "U"}}
    best = {"": (0, "", ())}

    def inserted(col):
        for _ in range(3):
            for at, (cost, audit, out) in list(col.items()):
                for t in "ua":
                    if t in steps[at]:
                        item = (cost + 5, audit + "I", (*out, ROLES[t] + ":"))
                        if item[:2] < col.get(steps[at][t], (10**9,))[:2]:
                            col[steps[at][t]] = item
        return col

    for role, text, fault in rows:
        after = {}
        for at, (cost, audit, out) in inserted(best).items():
            options = [(at, cost + 2, audit + "D", out)]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                for t, to in steps[at].items():
                    if role[:1] == t:
                        options.append((to, cost + more, audit + "K", (*out, f"{role}:{text}")))
                    if t in ROLES:
                        options.append((to, cost + more + 1, audit + "R", (*out, f"{ROLES[t]}:{text}")))
            for to, *item in options:
                if tuple(item[:2]) < after.get(to, (10**9,))[:2]:
                    after[to] = tuple(item)
        best = after
    ended = inserted(best)
    return min(ended[s] for s in ("", "A") if s in ended)


def plain(conversations):
    """The whole contract over (conv_id, turn, role, text) rows."""
    kept = {}
    for conv, turn, role, text in conversations:
        role, text = (" " if role is None else role), (" " if text is None else text)
        mark = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        rows = kept.setdefault(conv, [])
        if mark == 1:
            text = ""
        if mark == 2:
            text = re.sub("[.!?]", "", text)
        rows += [] if mark == 0 else [(turn, "user" if mark == 4 else role, text)] * (2 if mark == 3 else 1)
    out = {}
    for conv, rows in kept.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in rows:
            fault = ""
            if not text.strip(WHITE):
                fault = "blank"
            elif (role, text) in seen:
                fault = "duplicate"
            elif text.rstrip(WHITE)[-1] not in ".!?":
                fault = "truncated"
            seen.add((role, text))
            faults.append(fault)
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[1][:1], b[1][:1]) not in (("s", "u"), ("u", "a"), ("a", "u")) for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, lines = cheapest([(r[1], r[2], f) for r, f in zip(rows, faults, strict=True)])
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest)
    return out


def run(spark, tmp_path, rows, schema="conv_id long, turn long, role string, text string"):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    got = queries_records.op13_structure_repair(spark, str(tmp_path)).collect()
    assert len({r[0] for r in got}) == len(got)
    return {r[0]: tuple(r)[1:] for r in got}


def test_whole_query(spark, sf_dir):
    rows = [tuple(r) for r in read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in queries_records.op13_structure_repair(spark, sf_dir).collect()}
    assert got == plain(rows) and sum(r[5] for r in got.values()) > 0


def test_random_and_edge_conversations(spark, tmp_path):
    rng = random.Random(5)
    texts = ["", " \n", "ok.", "so", "why?", "é!", None, "x ", "a.\u0085", "long " * 5000 + "."]
    roles = ["user", "assistant", "system", "tool", "u", "", None, "Assistant"]
    rows = [(rng.choice([*range(60), None]), rng.choice([*range(9), None]), rng.choice(roles[: rng.choice([2, 3, 8])]), rng.choice(texts)) for _ in range(700)]
    rows += [(900, 1, "user", "same.")] * 5 + [(901, None, "assistant", "hm.")]
    assert run(spark, tmp_path, rows) == plain(rows)


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == {}


def test_parse_equals_search():
    rng = random.Random(8)
    kinds = {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}
    for _ in range(2000):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), "t", rng.choice(["", "", "", *kinds])) for _ in range(rng.randrange(9))]
        column = role_repair.completed(role_repair.parse([(r[0][0], kinds[r[2]]) for r in rows]))
        got = min(column[s] for s in role_repair.ACCEPTED if s in column)
        assert got[:2] == cheapest(rows)[:2]


def test_segments_of_any_length_agree(spark):
    rng = random.Random(2)
    rows = [(1, i, rng.choice(["user", "user", "assistant", "system"]), rng.choice(["a", "b.", "", f"{i}!", f"{i}?"])) for i in range(400)] + [(2, 0, "assistant", "x.")]
    rows = [(c, t, r, x, "clash", 1) for c, t, r, x in rows]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, c string, pos int")
    shown = []
    for segment, fanout in ((512, 64), (7, 3)):
        found = role_repair.repair(df, segment=segment, fanout=fanout)
        lines = [(r.c, r.role, r.text) for r in found.lines.orderBy("c", "pos", "part").collect()]
        shown.append((sorted(map(tuple, found.report.collect())), lines, sorted(map(tuple, role_repair.line_digests(found.lines).collect()))))
    assert shown[0] == shown[1]
    turns = "".join(r[1][0] for r in shown[0][1] if r[0] == "=1")
    assert re.fullmatch("(s?(ua)+)?", turns) and found.rows.where(F.col("fault") > 0).count() > 50
