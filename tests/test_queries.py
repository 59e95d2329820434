"""Every registered query of the image conversion gives what its SQL gives."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tileframe.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(str, frame[columns].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_gives_what_sql_gives(spark, db, name):
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(db.sql(queries.ORACLE_SQL[name]).df())


def test_entry(spark):
    found = __spark_entry__.entry(spark)
    assert found.columns == ["image_id", "tile", "data_hex", "uses"] and found.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("gone", [["tileframe/llm", "tests/llm"], ["tileframe/llm", "tests/llm", "corpus_pipeline.py"]])
def test_without_the_corpus_operators(tmp_path, gone):
    """Everything else is there when the corpus operators are taken away, with their pipeline or without it."""
    root = Path(__spark_entry__.__file__).parent
    for part in ("tileframe", "__spark_entry__.py", "corpus_pipeline.py"):
        if (root / part).is_dir():
            shutil.copytree(root / part, tmp_path / part, ignore=shutil.ignore_patterns("__pycache__"))
        elif (root / part).exists():
            shutil.copy(root / part, tmp_path / part)
    for part in gone:
        shutil.rmtree(tmp_path / part, ignore_errors=True)
        (tmp_path / part).unlink(missing_ok=True)
    told = "import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()), 'pipeline' in e.queries())"
    got = subprocess.run([sys.executable, "-c", told], cwd=tmp_path, capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert got.stdout.split() == [str(len(queries.QUERIES)), "True", "False"]
