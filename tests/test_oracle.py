"""Every registered query against its DuckDB SQL (row count, column names/types, values)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import rows_of, spark_type  # noqa: E402
from conftest import SF_SMALL  # noqa: E402
from pertlake.plans.oracle import ORACLE  # noqa: E402
from pertlake.plans.queries import REGISTRY  # noqa: E402
from pertlake.sources.tables import TABLES  # noqa: E402

KEYS = sorted(REGISTRY)
SQL = ORACLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["perturbation", "text"]


def test_every_query_has_sql_and_is_registered():
    assert set(KEYS) == set(SQL)
    assert set(KEYS) <= set(entry.queries()) and set(KEYS) <= set(entry.oracle_sql())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, key):
    df = REGISTRY[key](spark, SF_SMALL)
    sp_types = {f.name: spark_type(f.dataType) for f in df.schema.fields}
    sp_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.execute(SQL[key])
    cols = [d[0] for d in rel.description]
    dk_rows = rows_of(cols, rel.fetchall())
    dk_types = {r[0]: r[1] for r in duck.execute(f"describe {SQL[key]}").fetchall()}
    assert sorted(df.columns) == sorted(cols)
    assert sp_types == dk_types
    assert len(sp_rows) == len(dk_rows)
    assert sp_rows == dk_rows

