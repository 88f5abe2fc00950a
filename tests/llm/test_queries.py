"""Every registered query with SQL equals it, run by DuckDB on the same whole tables."""

import duckdb
import pytest

from cuesheet.llm.queries import ORACLES, QUERIES
from tools.check_queries import TABLES, compare


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, folder, name):
    got = QUERIES[name](spark, folder).toPandas()
    assert compare(got, duck.sql(ORACLES[name]).to_arrow_table().to_pandas()) == ""


def test_all_operators_are_registered():
    assert sorted({int(n[2:].split("_")[0]) for n in QUERIES}) == list(range(1, 14))
