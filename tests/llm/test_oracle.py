"""The training-data queries that SQL can express against their DuckDB SQL."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import rows_of, spark_type  # noqa: E402
from pertlake.llm.queries import ORACLE, REGISTRY  # noqa: E402
from pertlake.sources.tables import TABLES  # noqa: E402

from .conftest import SF  # noqa: E402

# a trained model, a tokenizer's output or an algorithm that SQL can't express: brute force elsewhere
WITHOUT_SQL = {
    "op2_token_output", "op3_url_filter", "op4_decontamination", "op5_toxicity", "op6_quality_classifier",
    "op7_best_fit_packing", "op13_periodic_runs", "pipeline",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_query_is_registered_with_or_without_sql():
    assert set(REGISTRY) - set(ORACLE) == {*WITHOUT_SQL, "pipeline"} - {k for k, v in ORACLE.items() if v}
    assert set(REGISTRY) <= set(entry.queries())
    assert {int(k[2:].split("_")[0]) for k in REGISTRY if k != "pipeline"} == set(range(1, 14))


@pytest.mark.parametrize("key", sorted(k for k, v in ORACLE.items() if v))
def test_query_matches_sql(spark, duck, key):
    df = REGISTRY[key](spark, SF)
    rel = duck.execute(ORACLE[key])
    cols = [d[0] for d in rel.description]
    want = rows_of(cols, rel.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert {f.name: spark_type(f.dataType) for f in df.schema.fields} == {r[0]: r[1] for r in duck.execute(f"describe {ORACLE[key]}").fetchall()}
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want
