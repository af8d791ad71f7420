"""Every query of the core that has SQL, against DuckDB on the small tables: values, column names, row counts."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from strandgraph.plans import everything

TABLES = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for path in TABLES.glob("*.parquet"):
        c.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return c


def plain(v):
    if isinstance(v, float | Decimal):
        return None if math.isnan(v) else round(float(v), 6) + 0.0
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(everything.ORACLES | everything.FIXTURE_ORACLES))
def test_query_equals_its_sql(spark, con, name):
    want = con.execute((everything.ORACLES | everything.FIXTURE_ORACLES)[name])
    columns = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in columns]
    rows = [tuple(plain(r[k]) for k in order) for r in want.fetchall()]
    df = (everything.QUERIES | everything.FIXTURES)[name](spark, str(TABLES))
    assert sorted(df.columns) == columns
    got = [tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect()]
    assert sorted(got, key=repr) == sorted(rows, key=repr)


def test_entry_module_offers_what_it_says():
    import __spark_entry__

    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(found) and set(everything.QUERIES) <= set(found)
