"""Spark's rows against DuckDB's, as multisets of values by column name."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, decimal.Decimal)):
        return "nan" if math.isnan(value) else float(f"{float(value):.10g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows(names: list[str], found) -> Counter:
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(plain(r[i]) for i in order) for r in found)


def family(kind: str) -> str:
    kind = kind.lower()
    if kind.startswith(("bigint", "long", "hugeint")):
        return "long"
    if kind.startswith(("integer", "int", "smallint")):
        return "int"
    if kind.startswith(("double", "float")):
        return "double"
    if kind.startswith("decimal"):
        return "decimal"
    if kind.startswith(("varchar", "string")):
        return "string"
    return kind.split("_")[0].split(" ")[0]


def differences(df, sql: str, con: duckdb.DuckDBPyConnection) -> str:
    """Empty if names, kinds of types and rows are equal."""
    got = df.collect()
    con.execute(sql)
    names = [d[0] for d in con.description]
    kinds = {d[0]: family(str(d[1])) for d in con.description}
    want = con.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    mine = {n: family(t) for n, t in df.dtypes}
    if mine != kinds:
        return f"types {[(n, mine[n], kinds[n]) for n in mine if mine[n] != kinds[n]]}"
    a, b = rows(df.columns, got), rows(names, want)
    if a != b:
        return f"{len(got)} and {len(want)} rows; only in Spark {list((a - b).items())[:3]}; only in SQL {list((b - a).items())[:3]}"
    return ""
