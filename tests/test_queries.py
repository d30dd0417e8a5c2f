"""Every registered query of the engine against its SQL in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from marlstone import queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def shown(rows):
    return sorted(tuple("" if x is None else f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, con, name):
    df = queries.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({queries.SQL[name]})").fetchall()
    assert shown(df.select(*[f"`{c}`" for c in columns]).collect()) == shown(want)


def test_entry_and_driver_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(queries.QUERIES) <= set(entry.queries())
