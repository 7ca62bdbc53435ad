"""Every query of the subpackage runs on the smallest tables, and equals its SQL where there is any."""

import glob
import os

import duckdb
import pytest

from riskloom.llm import queries

FOUND = {"p2_found": ["row_id_a", "row_id_b"], "p3_found": ["author_a", "author_b"], "p5_found": ["table_name", "row_key", "pii_type"], "p7_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "start_pos", "end_pos"]}


def rows(table):
    cols = sorted(table.column_names)
    value = lambda v: "null" if v is None else round(v, 6) if isinstance(v, float) else str(v)
    return cols, sorted((tuple(value(v) for v in r) for r in zip(*[table.column(c).to_pylist() for c in cols])), key=str)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, small, name):
    got = queries.QUERIES[name](spark, small).toArrow()
    assert got.num_rows > 0
    if name in FOUND:
        assert got.column_names == FOUND[name]
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for f in glob.glob(f"{small}/*.parquet"):
            con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
        want = con.sql(queries.ORACLE_SQL[name]).arrow()
        assert rows(got) == rows(want.read_all() if hasattr(want, "read_all") else want)
