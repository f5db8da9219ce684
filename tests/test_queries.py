"""Every query with SQL equals DuckDB's answer to it."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from claimspark import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", catalog.queries())
def test_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, DATA)
    found = duck.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(found.columns)
    order = sorted(got.columns)
    theirs = found.select(*[f'"{c}"' for c in order]).fetchall()
    ours = [tuple(r) for r in got.select(order).collect()]
    assert ours and Counter(ours) == Counter(theirs), (list((Counter(ours) - Counter(theirs)).items())[:3], list((Counter(theirs) - Counter(ours)).items())[:3])
