"""Run queries against their DuckDB SQL: python tests/oracle_check.py SF_DIR [NAME...]."""

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + ('/*.parquet' if os.path.isdir(p) else '')}'")
    return con


def canon(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = [None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else round(v, 6) if isinstance(v, float) else list(v) if hasattr(v, "tolist") and getattr(v, "ndim", 0) else v for v in df[c].astype(object)]
        df[c] = df[c].map(repr)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def compare(spark_df, oracle_df):
    a, b = canon(spark_df), canon(oracle_df)
    if list(a.columns) != list(b.columns):
        return f"columns {list(a.columns)} vs {list(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    for c in a.columns:
        bad = (a[c] != b[c]).to_numpy().nonzero()[0]
        if len(bad):
            return f"{c}: {len(bad)} differ, e.g. {a.iloc[bad[0]].to_dict()} vs {b.iloc[bad[0]].to_dict()}"
    return ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf, names = sys.argv[1], sys.argv[2:] or list(entry.queries())
    con, sql = connect(sf), entry.oracle_sql()
    for name in names:
        t = time.time()
        try:
            got = entry.queries()[name](spark, sf).toPandas()
        except Exception as e:  # noqa: BLE001
            print(name, "ERROR", str(e)[:1500], flush=True)
            continue
        t1 = time.time() - t
        if name not in sql:
            print(f"{name} rows {len(got)} {t1:.1f}s no oracle", flush=True)
            continue
        t = time.time()
        try:
            said = compare(got, con.execute(sql[name]).df())
        except Exception as e:  # noqa: BLE001
            said = f"SQL ERROR {str(e)[:600]}"
        print(name, len(got), f"{t1:.1f}s", f"sql {time.time() - t:.1f}s", said or "ok", flush=True)
