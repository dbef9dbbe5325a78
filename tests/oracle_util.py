"""Run a registered query in Spark and its oracle SQL in DuckDB; compare."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb
import pandas as pd

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    rel = con.sql(sql)
    return pd.DataFrame(rel.fetchall(), columns=rel.columns, dtype=object)


def frame(df) -> pd.DataFrame:
    """A Spark result with its nulls as None (pandas would make a long column with nulls a float one)."""
    return pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)


def _norm(v):
    if v is None:
        return None
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return round(v, 6)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    try:
        if pd.isna(v):
            return None
    except (TypeError, ValueError):
        pass
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    out = [tuple(_norm(r[c]) for c in cols) for _, r in df.iterrows()]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> tuple[bool, str]:
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return False, f"columns differ: {sorted(spark_pdf.columns)} vs {sorted(duck_pdf.columns)}"
    if len(spark_pdf) != len(duck_pdf):
        return False, f"row count {len(spark_pdf)} vs {len(duck_pdf)}"
    a, b = rows(spark_pdf), rows(duck_pdf)
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return False, f"row {i}: {x} vs {y}"
    return True, f"{len(a)} rows equal"


def duck_types(sql: str, sf_dir: str) -> dict[str, str]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    rel = con.sql(sql)
    return {c: str(t) for c, t in zip(rel.columns, rel.types)}


_MAP = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR",
        "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
        "date": "DATE", "smallint": "SMALLINT", "tinyint": "TINYINT"}


def spark_type_as_duck(dt) -> str:
    s = dt.simpleString()
    if s.startswith("array<"):
        from pyspark.sql.types import ArrayType
        assert isinstance(dt, ArrayType)
        return spark_type_as_duck(dt.elementType) + "[]"
    return _MAP.get(s, s.upper())


def schema_diff(spark_schema, duck: dict[str, str]) -> list[str]:
    out = []
    for f in spark_schema.fields:
        d = duck.get(f.name)
        s = spark_type_as_duck(f.dataType)
        if d != s:
            out.append(f"{f.name}: spark {s} vs duck {d}")
    return out
