"""Every query that has SQL gives the same rows as another engine on the same tables."""

from collections import Counter

import pytest

duckdb = pytest.importorskip("duckdb")

from cadenza.plans import queries as plans


@pytest.fixture(scope="module")
def other(sf_dir):
    from pathlib import Path

    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_rows(spark, sf_dir, other, name):
    df = plans.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = other.sql(plans.ORACLES[name])
    assert sorted(want.columns) == columns
    place = [want.columns.index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(tuple(r[i] for i in place) for r in want.fetchall())


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
