"""Rows of a Spark query against rows of DuckDB SQL over the same Parquet files."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    """A value in a form that both engines agree on: doubles to 9 significant digits."""
    if value is None or isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if type(value).__name__ == "Decimal":
        return plain(float(value)) if value % 1 else int(value)
    return value


def counted(columns: list[str], rows) -> Counter:
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in at) for row in rows)


def of_spark(df) -> tuple[list[str], Counter]:
    return sorted(df.columns), counted(df.columns, df.collect())


def of_duckdb(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    return sorted(columns), counted(columns, got.fetchall())
