"""Run registered queries against their SQL in DuckDB: ``check_queries.py [sf_dir] [name part ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from latticeloom.plans import load_queries  # noqa: E402
from latticeloom.session import get_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_integer_dtype(df[c]):
            df[c] = df[c].astype("int64")
        elif pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].astype("float64")
        else:
            df[c] = df[c].astype(object).where(df[c].notna(), None)
    return df.sort_values(list(df.columns), key=lambda s: s.astype(str) if s.dtype == object else s).reset_index(drop=True)


def compare(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} != {len(sql_df)}"
    a, b = normal(spark_df), normal(sql_df)
    for c in a.columns:
        x, y = a[c], b[c]
        if x.dtype != y.dtype:
            return f"type of {c}: {x.dtype} != {y.dtype}"
        same = (x == y) | (x.isna() & y.isna())
        if not same.all():
            i = int(np.flatnonzero(~same.to_numpy())[0])
            return f"{int((~same).sum())} values of {c}, e.g. {a.iloc[i].to_dict()} != {b.iloc[i].to_dict()}"
    return ""


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    reg = load_queries()
    spark = get_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = 0
    for name, func in reg.QUERIES.items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        start = time.time()
        try:
            got = func(spark, folder).toPandas()
            took = time.time() - start
            if name not in reg.ORACLES:
                print(f"rows-only {name}: {len(got)} rows {took:.1f}s", flush=True)
                continue
            message = compare(got, con.execute(reg.ORACLES[name]).df())
        except Exception as e:  # noqa: BLE001
            took, message = time.time() - start, f"{type(e).__name__}: {str(e)[:600]}"
        if message or len(got) == 0:
            bad += 1
        print(f"{'FAIL' if message else 'ok'} {name} {took:.1f}s {message or len(got)}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
