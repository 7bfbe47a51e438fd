import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    work = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    conf = {"spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"{work}/checkpoints", "spark.local.dir": f"{work}/local", "spark.sql.warehouse.dir": f"{work}/warehouse", "spark.driver.memory": "4g"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")

    def run(sql):
        found = con.execute(sql)
        return [c[0] for c in found.description], found.fetchall()

    return run


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return value


@pytest.fixture(scope="session")
def same(duck):
    """Compares a DataFrame with the rows of SQL, whatever their order."""

    def check(df, sql):
        cols, want = duck(sql)
        assert sorted(cols) == sorted(df.columns)
        order = sorted(cols)
        a = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
        b = sorted((tuple(plain(r[cols.index(c)]) for c in order) for r in want), key=repr)
        assert a == b

    return check
