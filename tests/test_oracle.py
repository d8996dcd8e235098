"""Every registered query against its DuckDB oracle on the sf0.001 tables
(rows-only queries: they run and return rows)."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as E
from oracle_compare import compare, compare_in_duckdb, duck_connect

SF = os.environ.get("MERCATO_TEST_SF", "/root/testdata/sf0.001")
QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("test tables not present")
    return duck_connect(SF)


#: hundreds of thousands of rows or more: compared in DuckDB
LARGE = {"view_daily_sales", "view_daily_sales_revenue", "etl_melt", "kpi21_rolling_demand",
         "etl_top200_sample", "etl_daily_aggregated"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name, tmpdir_path):
    if name not in ORACLE:
        assert QUERIES[name](spark, SF).count() > 0
        return
    if name in LARGE:
        info = compare_in_duckdb(spark, con, name, QUERIES[name], ORACLE[name], SF, f"{tmpdir_path}/{name}")
        assert info["ok"], info
        return
    info = compare(spark, con, name, QUERIES[name], ORACLE[name], SF)
    assert info["ok"], info


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
