"""Registered queries of the corpus operators give what their SQL gives, where they have some."""

import os

import duckdb
import pytest

from tileframe.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_what_sql_gives(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    got, want = QUERIES[name](spark, sf).toPandas(), con.sql(ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    told = lambda frame: sorted(map(str, frame[columns].itertuples(index=False, name=None)))
    assert told(got) == told(want)
