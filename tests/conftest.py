import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def same_as_sql(spark, sf_dir, duck):
    """Asserts that a query's rows are those of its SQL: values, whatever their order."""

    def plain(v):
        return float(f"{v:.9g}") if isinstance(v, float) else v

    def check(query, sql):
        df = query(spark, sf_dir)
        cols = sorted(df.columns)
        found = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
        got = duck.execute(sql)
        names = [d[0] for d in got.description]
        assert sorted(names) == cols
        wanted = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in got.fetchall()), key=str)
        assert found == wanted

    return check
