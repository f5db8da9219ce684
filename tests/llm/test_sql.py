"""The corpus queries with SQL equal DuckDB's answers to it."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from claimspark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    data, con = "/root/testdata/sf0.01", duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, found = queries.queries()[name](spark, data), con.sql(queries.oracle_sql()[name])
    order = sorted(got.columns)
    assert order == sorted(found.columns)
    ours, theirs = ([tuple(r) for r in rows] for rows in (got.select(order).collect(), found.select(*order).fetchall()))
    assert ours and Counter(ours) == Counter(theirs), (list((Counter(ours) - Counter(theirs)).items())[:3], list((Counter(theirs) - Counter(ours)).items())[:3])
