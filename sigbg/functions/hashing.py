"""Portable, repeatable randomness.

Spark's ``rand``/``xxhash64`` have no DuckDB twin and ``rand`` depends on the
partitioning.  Every random decision in the library (shuffle order, split
membership, sampling, batching) is instead a function of ``md5(seed:key)``,
which both engines compute identically and which does not change when the
data is repartitioned or an executor is lost and a task recomputed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_hex(seed: int | str, *keys) -> Column:
    """32 hex chars of md5("seed:key1:key2...")."""
    parts = [F.lit(str(seed))] + [F.col(k).cast("string") if isinstance(k, str) else k.cast("string")
                                  for k in keys]
    return F.md5(F.concat_ws(":", *parts))


def hash_bucket(seed: int | str, *keys, modulo: int = 10000) -> Column:
    """Uniform integer in [0, modulo) from the first 32 bits of the md5."""
    h = hash_hex(seed, *keys)
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % F.lit(modulo)).cast("bigint")


def hash_block(hex_col: Column, digits: int = 3) -> Column:
    """Block id from the leading hex digits; monotone in the md5 order."""
    return F.conv(F.substring(hex_col, 1, digits), 16, 10).cast("int")


# DuckDB spellings of the same expressions (for oracle SQL).

def sql_hash_hex(seed: int | str, *key_sql: str) -> str:
    inner = ", ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in key_sql])
    return f"md5(concat_ws(':', {inner}))"


def sql_hash_bucket(seed: int | str, *key_sql: str, modulo: int = 10000) -> str:
    return f"(('0x' || substr({sql_hash_hex(seed, *key_sql)}, 1, 8))::BIGINT % {modulo})"
