"""Every query with a SQL twin against DuckDB on the small tables."""

import math
import os
from pathlib import Path

import pytest

from codeloom import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
if not Path(SF).exists():
    pytest.skip("no test tables", allow_module_level=True)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, float):
        return str(int(x)) if x.is_integer() else f"{x:.9g}"
    return str(x)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([plain(r[i]) for i in order] for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    mine = catalog.queries()[name](spark, SF)
    other = con.sql(catalog.oracle_sql()[name])
    assert table(mine.columns, mine.collect()) == table(other.columns, other.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_flagship(spark):
    assert catalog.flagship(spark, SF).count() >= 0
