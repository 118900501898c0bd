"""Output normalisation shared by the Spark query and its oracle SQL: every
integer becomes BIGINT, every float DOUBLE rounded to 6 places (summation
order differs between engines), so schemas and value hashes line up."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPARK_TYPES = {"i": "bigint", "f": "double", "s": "string", "b": "boolean", "d": "date"}
SQL_TYPES = {"i": "BIGINT", "f": "DOUBLE", "s": "VARCHAR", "b": "BOOLEAN", "d": "DATE"}
DIGITS = 6
SCALE = 1000000.0
OFFSET = 0.501


def parse(spec: str) -> list[tuple[str, str]]:
    """'a:i b:f c:s' -> [('a','i'), ('b','f'), ('c','s')]"""
    out = []
    for tok in spec.split():
        name, kind = tok.rsplit(":", 1)
        out.append((name, kind))
    return out


def finalize_df(df: DataFrame, spec: str) -> DataFrame:
    cols = []
    for name, kind in parse(spec):
        c = F.col(name).cast(SPARK_TYPES[kind])
        if kind == "f":
            # floor(x * 10^6 + 0.501) / 10^6: plain IEEE arithmetic in both
            # engines.  The boundary sits just below the half so exact decimal
            # ties (means of 3-decimal values over 2^k rows) round the same way
            # even when the engines' summation orders differ in the last bit.
            c = (F.floor(c * SCALE + OFFSET) / SCALE).cast("double")
        cols.append(c.alias(name))
    return df.select(*cols)


def finalize_sql(source: str, spec: str) -> str:
    cols = []
    for name, kind in parse(spec):
        c = f"CAST({name} AS {SQL_TYPES[kind]})"
        if kind == "f":
            c = f"CAST(floor({c} * {SCALE} + {OFFSET}) / {SCALE} AS DOUBLE)"
        cols.append(f"{c} AS {name}")
    return "SELECT " + ", ".join(cols) + f" FROM {source}"
