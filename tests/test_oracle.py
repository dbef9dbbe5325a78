"""Every registered query with oracle SQL equals DuckDB on the same parquet (sf0.001)."""

import pytest

import __spark_entry__ as ent
from conftest import SF_SMALL
from oracle_util import compare, duck, frame

SQL = ent.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, name):
    sp = frame(ent.queries()[name](spark, SF_SMALL))
    ok, msg = compare(sp, duck(SQL[name], SF_SMALL))
    assert ok, msg


def test_contract_keys():
    q = ent.queries()
    assert set(SQL) <= set(q)
    assert len(q) >= 80


def test_entry_runs(spark):
    df = ent.entry(spark)
    rows = df.collect()
    assert len(rows) > 1
    assert df.columns == ["threshold", "tp", "fp", "tpr", "fpr"]
