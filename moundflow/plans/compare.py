"""Order-insensitive comparison of a Spark result with its oracle result:
row count, column names and a hash of the sorted, normalised rows."""
from __future__ import annotations

import hashlib
import math

import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v) -> str:
    if v is None or v is pd.NA or v is pd.NaT:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        if v.is_integer():
            return str(int(v))
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "isoformat"):
        s = v.isoformat()
        return s[:10] if (not hasattr(v, "hour") or str(v).endswith("00:00:00")) else s
    if hasattr(v, "item"):
        return norm(v.item())
    return str(v)


def frame_hash(df: pd.DataFrame) -> tuple[int, str]:
    cols = sorted(df.columns)
    rows = sorted("|".join(norm(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))
    return len(rows), hashlib.sha256("\n".join(rows).encode()).hexdigest()


def duck_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark_pdf: pd.DataFrame, oracle_pdf: pd.DataFrame) -> tuple[bool, str]:
    if sorted(spark_pdf.columns) != sorted(oracle_pdf.columns):
        return False, f"columns differ: {sorted(spark_pdf.columns)} vs {sorted(oracle_pdf.columns)}"
    a, b = frame_hash(spark_pdf), frame_hash(oracle_pdf)
    if a != b:
        return False, f"rows {a[0]} vs {b[0]}, hash differs"
    return True, "ok"
