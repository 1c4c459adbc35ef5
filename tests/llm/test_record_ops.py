"""Chat formatting and the fixity audit."""

import gzip
import hashlib
import json
import random

from pyspark.sql import functions as F

from loamspark.llm import chat_format, queries_records, warc_fixity


def read_back(df):
    out = df.select("conv_id", "formatted", "loss_mask", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    return {r["conv_id"]: r for r in out.collect()}


HARD = [r"\### Assistant: </turn> ok", "\\", "\\\\</turn>", "####", "\n</turn>\n", "</turn>", "x\n", "", "😀 é", "### user:\nno\n</turn>\n", "a" * 20_000]


def test_turn_rows_round_trip(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(HARD)]
    rows += [(2, 0, None, None), (2, 1, "assistant", None), (2, 2, "ro%0A\nle:", "t"), (None, 0, "user", "x"), (3, 5, "user", "b"), (3, 5, "user", "a"), (3, 5, "user", "a"), (3, None, "system", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as formatted", "2 as turns", "3 as o", "4 as id")
    got = read_back(chat_format.format_chat(df))
    assert [(t.role, t.text) for t in got[1]["turns"]] == [("assistant" if k % 2 else "user", t) for k, t in enumerate(HARD)]
    assert got[1]["loss"] == "".join(HARD[1::2])
    assert sum(s["chars"] for s in got[1]["loss_mask"]) == len(got[1]["formatted"])
    assert [(t.role, t.text) for t in got[2]["turns"]] == [("", ""), ("assistant", ""), ("ro%0A\nle:", "t")]
    assert [t.text for t in got[3]["turns"]] == ["first", "a", "a", "b"] and got[None]["turns"][0].text == "x"


def test_layouts_by_row_fingerprint(spark):
    records = [
        {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}], "id": 5},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "do", "input": "this", "output": "done"},
        {"instruction": "do", "output": "done", "system": "be brief", "other": {"x": 1}},
        {"prompt": "p", "completion": "c"},
        {"prompt": "p", "messages": [{"role": "user", "content": None}]},
        {"question": "q?", "answer": "a!"},
        {"turns": [{"speaker": "bot", "utterance": "beep"}]},
        {"unknown": 1},
        {"messages": []},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(98, "not json"), (99, None)]
    df = spark.createDataFrame(rows, "conv_id long, payload string")
    got = {r["conv_id"]: r["turns"] for r in chat_format.canonical_turns(df, payload="payload").collect()}
    turns = lambda i: [(t.role, t.text) for t in got[i]]
    assert turns(0) == [("user", "hi"), ("assistant", "yo")]
    assert turns(1) == [("user", "q"), ("assistant", "a")]
    assert turns(2) == [("user", "do\n\nthis"), ("assistant", "done")]
    assert turns(3) == [("system", "be brief"), ("user", "do"), ("assistant", "done")]
    assert turns(4) == [("user", "p"), ("assistant", "c")]
    assert turns(5) == [("user", "")]
    assert turns(6) == [("user", "q?"), ("assistant", "a!")]
    assert turns(7) == [("assistant", "beep")]
    assert got[8] is None and got[98] is None and got[99] is None


def test_typed_layouts(spark):
    df = spark.sql("select 1L as conv_id, 'p' as prompt, 'r' as response")
    assert chat_format.layout_of(df.schema).name == "prompt_response"
    assert read_back(chat_format.format_chat(df))[1]["loss"] == "r"
    none = spark.sql("select 1L as conv_id, 'p' as nothing")
    assert chat_format.format_chat(none).first()["formatted"] is None
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.format_chat(empty).count() == 0


def test_chat_plan_is_native(spark, sf_dir):
    plan = queries_records.op1_chat_format(spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def record_set(spark, rows):
    return spark.createDataFrame(rows, warc_fixity.RECORD)


def test_audit_finds_exactly_the_differences(spark):
    rows = [(f"a{k % 3}", k * 700, 700, f"d{k}") for k in range(600)]
    other = [r for k, r in enumerate(rows) if k != 17]
    other[100] = (*other[100][:3], "changed")
    other.append(("a9", 0, 5, "new"))
    got = warc_fixity.audit(record_set(spark, rows), record_set(spark, other), base=2048, fanout=4).collect()
    assert sorted((r["archive"], r["offset"], r["status"]) for r in got) == sorted([("a2", 17 * 700, "missing"), (rows[101][0], rows[101][1], "corrupt"), ("a9", 0, "extra")])


def test_audit_edge_cases(spark):
    rows = [("a", 0, 5, "x"), ("a", 0, 5, "x"), (None, None, None, None), ("b", 7, None, "y")]
    same, none = record_set(spark, rows), record_set(spark, rows).limit(0)
    assert warc_fixity.audit(same, same.selectExpr("*", "1 as node", "2 as hash", "3 as at", "4 as l")).count() == 0
    assert warc_fixity.audit(none, none).count() == 0
    assert {r["status"] for r in warc_fixity.audit(same, none).collect()} == {"missing"}
    assert {r["status"] for r in warc_fixity.audit(none, same).collect()} == {"extra"}
    assert warc_fixity.audit(same, none).count() == 3
    a = {r["archive"]: r["hash"] for r in warc_fixity.roots(same.limit(2)).collect()}
    assert a == {r["archive"]: r["hash"] for r in warc_fixity.roots(same.where("archive = 'a'")).collect()}


def test_records_at_one_offset_pair_one_with_one(spark):
    """Unplaced records, and several at one offset: one of five changes."""
    for at in (None, -1, 0, 700):
        rows = [("a", at, 10 + k, f"d{k}") for k in range(5)]
        other = [*rows[:2], ("a", at, 12, "changed"), *rows[3:]]
        got = warc_fixity.audit(record_set(spark, rows), record_set(spark, other), base=64, fanout=2).collect()
        if at is None or at < 0:  # nothing says that the two are one record
            assert sorted((r["status"], r["offset"], r["found_offset"]) for r in got if r["status"] == "missing") == [("missing", -1, None)] and len(got) == 2
        else:
            assert [(r["status"], r["offset"], r["expected"], r["found"]) for r in got] == [("corrupt", at, "d2", "changed")]


def test_audit_of_shifted_records(spark):
    """A lost and a shortened record move what follows; only these two are wrong."""
    lengths = [300 + 7 * (k % 13) for k in range(200)]
    place = lambda ls: [sum(ls[:k]) for k in range(len(ls))]
    rows = [("a", at, n, f"d{k}") for k, (at, n) in enumerate(zip(place(lengths), lengths, strict=True))]
    kept = [(f"d{k}", n) for k, n in enumerate(lengths) if k != 50]
    kept[120] = ("cut", 100)
    other = [("a", at, n, d) for at, (d, n) in zip(place([n for _, n in kept]), kept, strict=True)]
    got = warc_fixity.audit(record_set(spark, rows), record_set(spark, other), base=1024, fanout=4).collect()
    wrong = {(r["status"], r["expected"], r["found"]) for r in got if r["status"] != "moved"}
    assert wrong <= {("missing", "d50", None), ("missing", "d121", None), ("extra", None, "cut"), ("corrupt", "d121", "cut"), ("corrupt", "d50", "cut")}
    assert {e for _, e, _ in wrong if e} == {"d50", "d121"}
    moved = {r["expected"]: (r["offset"], r["found_offset"]) for r in got if r["status"] == "moved"}
    assert moved == {f"d{k}": (rows[k][1], next(o[1] for o in other if o[3] == f"d{k}")) for k in range(51, 200) if k != 121}


def warc_record(body):
    return b"WARC/1.0\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)


def test_reader_is_linear_and_finds_its_place_again():
    import time

    rnd = random.Random(5)
    bodies = [rnd.randbytes(60) for _ in range(12_000)]
    packed = [gzip.compress(warc_record(b), 1) for b in bodies]
    start = time.time()
    found = list(warc_fixity.warc_members(b"".join(packed)))
    assert [d for *_, d in found] == [warc_record(b) for b in bodies] and time.time() - start < 5
    for pieces in (packed[:100], [warc_record(b) for b in bodies[:100]]):
        broken = list(pieces)
        broken[10] = broken[10][: len(broken[10]) // 2]  # cut
        broken[40] = broken[40][:8] + b"\xff" * 20 + broken[40][28:]  # damaged
        found = list(warc_fixity.warc_members(b"".join(broken)))
        good = {d for *_, d in found}
        assert sum(warc_record(b) in good for b in bodies[:100]) >= 98
        assert sum(n for _, n, _ in found) == sum(map(len, broken)) and [a for a, *_ in found] == [sum(n for _, n, _ in found[:k]) for k in range(len(found))]


def test_read_warc_files(spark, tmp_path):
    record = lambda body: b"WARC/1.0\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    bodies = [b"one", b"two \r\n\r\n inside", b""]
    (tmp_path / "plain.warc").write_bytes(b"".join(map(record, bodies)))
    (tmp_path / "packed.warc.gz").write_bytes(b"".join(gzip.compress(record(b)) for b in bodies))
    rows = warc_fixity.read_warc(spark, str(tmp_path)).orderBy("archive", "offset").collect()
    digests = [hashlib.sha256(record(b)).hexdigest() for b in bodies]
    assert [r["digest"] for r in rows] == digests * 2
    plain = [r for r in rows if r["archive"].endswith("plain.warc")]
    assert [r["offset"] for r in plain] == [0, len(record(bodies[0])), len(record(bodies[0])) + len(record(bodies[1]))]
