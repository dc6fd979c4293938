"""The queries that SQL can express give the rows that DuckDB gives."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from nodelake.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    result = con.execute(Q.oracle_sql()[name])
    names = sorted(d[0] for d in result.description)
    want = result.fetchall()
    columns = [d[0] for d in result.description]
    df = Q.queries()[name](spark, SF)
    assert sorted(df.columns) == names
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(tuple(r[columns.index(c)] for c in names) for r in want)
