"""Compare a Spark result with the SQL result on the same tables."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, pd.Timestamp):
        return value.isoformat()
    return value


def _rows(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    columns = [[_plain(v) for v in pdf[c].tolist()] for c in cols]
    return sorted(zip(*columns), key=repr)


def differences(spark_df, con, sql: str) -> list[str]:
    """What differs, in words; empty when both hold the same rows."""
    mine, other = spark_df.toPandas(), con.execute(sql).df()
    found = []
    if sorted(mine.columns) != sorted(other.columns):
        return [f"columns {sorted(mine.columns)} != {sorted(other.columns)}"]
    if len(mine) != len(other):
        found.append(f"rows {len(mine)} != {len(other)}")
    if not len(mine):
        found.append("no rows")
    a, b = _rows(mine), _rows(other)
    only_a, only_b = sorted(set(a) - set(b), key=repr), sorted(set(b) - set(a), key=repr)
    if a != b:
        found.append(f"{len(only_a)} / {len(only_b)} rows differ; {only_a[:2]} / {only_b[:2]}")
        for i, c in enumerate(sorted(mine.columns)):
            left, right = [r[i] for r in a], [r[i] for r in b]
            if sorted(map(repr, left)) != sorted(map(repr, right)):
                found.append(f"  column {c}: {mine[c].dtype} / {other[c].dtype}")
    return found
