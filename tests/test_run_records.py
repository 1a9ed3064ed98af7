"""Queries of run records on tables that the small ones don't show."""

import hashlib
import os

import pytest

from textmill import catalog
from textmill.operators import runs

ORDERS = "o_orderkey long, o_custkey long"


@pytest.fixture
def against_sql(spark, tmp_path):
    """Asserts that a query over one table equals its SQL over the same rows."""
    import duckdb

    def check(name, table, rows, schema):
        at = str(tmp_path / f"{table}.parquet")
        spark.createDataFrame(rows, schema).write.parquet(at)
        con = duckdb.connect()
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{at}/*.parquet'")
        wanted = con.execute(catalog.oracle_sql()[name])
        names = [d[0] for d in wanted.description]
        found = catalog.queries()[name](spark, os.fspath(tmp_path)).select(*names).collect()
        assert sorted(map(tuple, found)) == sorted(wanted.fetchall())

    return check


def test_all_levels_broadcasts_nothing(spark, sf_dir, against_sql):
    """The outputs grow with the orders, though the planner takes them for few."""
    plan = catalog.queries()["i21_all_levels"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    against_sql("i21_all_levels", "orders", [(k, 1) for k in (0, 1, 2, 3, 3, 7, 12)], ORDERS)


def test_folder_fingerprints_beyond_six_digits(spark, against_sql):
    """n1000000 comes before n999999 by name, after it by number."""
    keys = (1_000_000, 999_999, 5, 1_200_001, 100_000)
    against_sql("h41_folder_fingerprints", "part", [(k, f"part {k}", "a" if k != 5 else "b") for k in (*keys, 100_001)], "p_partkey long, p_name string, p_brand string")
    files = spark.createDataFrame([("a", f"n{k:06d}", bytearray(b"x")) for k in keys], "folder string, name string, content binary")
    by_name = "".join(f"{name}1x" for name in sorted(f"n{k:06d}" for k in keys))
    assert runs.folder_fingerprint(files).first()["fingerprint"] == hashlib.sha256(by_name.encode()).hexdigest()[:16]
