"""Every query outside the training-data subpackage runs, and equals its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from riskloom.plans import catalogue


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for f in glob.glob(f"{small}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(table):
    cols = sorted(table.column_names)
    value = lambda v: "null" if v is None else round(v, 6) if isinstance(v, float) else str(v)
    return cols, sorted((tuple(value(v) for v in r) for r in zip(*[table.column(c).to_pylist() for c in cols])), key=str)


def arrow(result):
    return result.read_all() if hasattr(result := result.arrow(), "read_all") else result


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, small, name):
    got = catalogue.QUERIES[name](spark, small).toArrow()
    if name in catalogue.ORACLE_SQL:
        assert rows(got) == rows(arrow(duck.sql(catalogue.ORACLE_SQL[name])))
    assert got.num_columns > 0


def test_entry_and_registered_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_the_rest_does_not_import_the_training_data_subpackage():
    import subprocess
    import sys

    code = "import sys, riskloom.plans.catalogue; sys.exit(any(m.startswith('riskloom.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(__file__))).returncode == 0
