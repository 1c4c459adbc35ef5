"""The cascading erasure against the same rules over plain lists."""

import datetime as dt
import glob
import hashlib
import math
import os
import zlib
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from loamspark.llm import erasure, queries_shop
from loamspark.llm.common import read_table

VALUE = {"clients": "balance", "clicks": "value", "sales": "total", "sale_lines": "amount"}


def crc(value):
    return zlib.crc32(("" if value is None else str(value)).encode())


def sort_key(value):
    return (0, 0) if value is None else (2, 0) if value != value else (1, value)


def plain(tables):
    """{(table, file_no): (n_rows, n_erased, cents, rewritten, digest, rows)} from lists of dictionaries."""
    owner = {}
    for s in tables["sales"]:
        if s["sale_id"] is not None and s["client_id"] is not None:
            owner[s["sale_id"]] = min(owner.get(s["sale_id"], s["client_id"]), s["client_id"])
    key = {n: (lambda r: r["client_id"]) for n in ("clients", "clicks", "sales")} | {"sale_lines": lambda r: owner.get(r["sale_id"])}
    ordered = {n: sorted(rows, key=lambda r: (crc(key[n](r)), *map(sort_key, r.values()))) for n, rows in tables.items()}
    masters = {r["master_id"] for r in tables["clients"]} - {None}
    clicks = Counter(r["client_id"] for r in tables["clicks"])
    owned = {(r["client_id"], r["master_id"]) for r in tables["clients"] if r["master_id"] is not None}
    total = Counter()
    for client, master in owned:
        total[master] += clicks[client] if client is not None else 0
    top = min(masters, key=lambda m: (-total[m], m)) if masters else None
    victims = {m for m in masters if crc(m) % 100 == 0 or m == top}
    gone = {"clients": lambda r: r["master_id"] in victims}
    ids = {r["client_id"] for r in tables["clients"] if gone["clients"](r)} - {None}
    gone["clicks"] = gone["sales"] = lambda r: r["client_id"] in ids
    sales = {r["sale_id"] for r in tables["sales"] if gone["sales"](r)} - {None}
    gone["sale_lines"] = lambda r: r["sale_id"] in sales
    out = {}
    for name, rows in ordered.items():
        per = 1 + len(rows) // 150
        for no in range(-(-len(rows) // per)):
            before = rows[no * per : (no + 1) * per]
            after = [r for r in before if not gone[name](r)]
            if after:
                cents = sum(0 if r[VALUE[name]] is None or not math.isfinite(r[VALUE[name]]) else math.floor(100 * r[VALUE[name]] + 0.5) for r in after)
                first = ",".join("" if (v := next(iter(r.values()))) is None else str(v) for r in after)
                out[name, no] = (len(after), len(before) - len(after), cents, len(after) < len(before), hashlib.sha256(first.encode()).hexdigest(), after)
    return out


def held(spark, folder):
    return {n: [r.asDict() for r in read_table(spark, folder, n).collect()] for n in VALUE}


def check(spark, folder):
    want = plain(held(spark, folder))
    got = queries_shop.op12_cascading_erasure(spark, folder).collect()
    assert {(r.table_name, r.file_no): (r.n_rows, r.n_erased, r.cents, r.rewritten, r.ids_sha256) for r in got} == {k: v[:5] for k, v in want.items()}
    assert len(got) == len(want)
    if not got:
        return got
    root = os.path.dirname(os.path.dirname(got[0].path.removeprefix("file:")))
    found = {f for f in glob.glob(f"{root}/**", recursive=True) if os.path.isfile(f)}
    assert {r.path.removeprefix("file:") for r in got} == found
    for r in got:
        file = pq.ParquetFile(r.path.removeprefix("file:"))
        rows = file.read().to_pylist()
        assert rows == want[r.table_name, r.file_no][5] or any(v != v for x in rows for v in x.values())
        assert ",".join(file.schema_arrow.names) == r.columns
        stats = [file.metadata.row_group(g).column(0).statistics for g in range(file.metadata.num_row_groups)]
        ids = [v for x in rows if (v := next(iter(x.values()))) is not None]
        if ids:
            assert (min(s.min for s in stats if s.has_min_max), max(s.max for s in stats if s.has_min_max)) == (min(ids), max(ids))
    return got


def test_given_tables(spark):
    got = check(spark, "/root/testdata/sf0.001")
    assert any(r.rewritten for r in got) and not all(r.rewritten for r in got)


def write(folder, clients, clicks, sales, lines):
    when = dt.datetime(2024, 1, 2, 3, 4, 5, 678901)
    tables = {
        "clients": pa.table({"client_id": pa.array([c[0] for c in clients], pa.int64()), "master_id": pa.array([c[1] for c in clients], pa.int64()), "balance": pa.array([c[2] for c in clients], pa.float64()), "crc_": pa.array(["x"] * len(clients))}),
        "clicks": pa.table({"click_id": pa.array([c[0] for c in clicks], pa.int64()), "ts": pa.array([when if c[0] else None for c in clicks], pa.timestamp("us")), "client_id": pa.array([c[1] for c in clicks], pa.int64()), "value": pa.array([c[2] for c in clicks], pa.float64())}),
        "sales": pa.table({"sale_id": pa.array([c[0] for c in sales], pa.int64()), "client_id": pa.array([c[1] for c in sales], pa.int64()), "total": pa.array([c[2] for c in sales], pa.float64()), "day": pa.array([dt.date(2024, 5, 1)] * len(sales), pa.date32())}),
        "sale_lines": pa.table({"sale_id": pa.array([c[0] for c in lines], pa.int64()), "amount": pa.array([c[1] for c in lines], pa.float64()), "owner_": pa.array(["long " * 9000 if c[0] else None for c in lines])}),
    }
    for name, table in tables.items():
        pq.write_table(table, f"{folder}/{name}.parquet")


def test_nulls_ties_and_repeats(spark, tmp_path):
    bad = [m for m in range(2000) if zlib.crc32(str(m).encode()) % 100 == 0][:2]
    clients = [(1, bad[0], 1.005), (1, 5, 2.0), (2, 5, None), (3, None, -0.125), (None, bad[1], 9.0), (None, None, 1.0), (4, 7, float("nan")), (4, 7, float("inf"))]
    clicks = [(1, 1, 0.5), (1, 1, 0.5), (1, 1, 0.5), (2, 2, 1.0), (3, None, 2.0), (None, 4, None), (4, 99, 1.0)]
    sales = [(10, 1, 1.0), (10, 2, 1.0), (11, 2, 2.0), (12, None, 3.0), (None, 1, 4.0), (13, 4, 5.0)]
    lines = [(10, 1.0), (10, 1.0), (11, 2.0), (12, None), (None, 3.0), (77, 4.0), (13, 5.0)]
    write(tmp_path, clients, clicks, sales, lines)
    check(spark, str(tmp_path))


def test_busiest_master_ties_even_at_no_clicks(spark, tmp_path):
    write(tmp_path, [(8, 6, 1.0), (9, 5, 1.0)], [], [], [])
    assert [(r.table_name, r.n_rows) for r in check(spark, str(tmp_path))] == [("clients", 1)]


def test_empty_tables_and_nested_columns(spark, tmp_path):
    write(tmp_path, [], [], [], [])
    assert check(spark, str(tmp_path)) == []
    tables = {t.name: read_table(spark, str(tmp_path), t.name) for t in erasure.CASCADE}
    with pytest.raises(ValueError):
        erasure.erase(spark, tables | {"clients": tables["clients"].selectExpr("*", "array(1) AS nested")})


def test_larger_files_and_a_rule_of_ones_own(spark, tmp_path):
    clients = [(i, i % 7, i / 3) for i in range(1000)]
    write(tmp_path, clients, [(i, 3 if i % 3 else i % 1000, 1.5) for i in range(5000)], [], [])
    tables = {t.name: read_table(spark, str(tmp_path), t.name) for t in erasure.CASCADE}
    got = erasure.erase(spark, tables, str(tmp_path / "out"), is_victim=lambda m: m == 3, with_busiest=False).collect()
    assert sum(r.n_erased for r in got if r.table_name == "clients") <= len([c for c in clients if c[1] == 3])
    left = {i for r in got if r.table_name == "clients" for i in pq.read_table(r.path).column("client_id").to_pylist()}
    assert left == {c[0] for c in clients if c[1] != 3}
