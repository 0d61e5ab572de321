import duckdb
import pytest

import __spark_entry__ as entry
from logsift import queries as base

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(base.ORACLE_SQL))
def test_same_rows_as_sql(spark, db, name):
    df = base.QUERIES[name](spark, SF)
    r = db.execute(base.ORACLE_SQL[name])
    columns = [c[0] for c in r.description]
    order = [columns.index(c) for c in df.columns]
    rows = sorted((tuple(x[i] for i in order) for x in r.fetchall()), key=repr)
    assert sorted(map(tuple, df.collect()), key=repr) == rows


def test_entry(spark):
    assert entry.entry(spark).columns == ["timestamp", "data"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_wal_replay(spark):
    assert base.QUERIES["wal_replay"](spark, SF).count() == spark.read.parquet(f"{SF}/events.parquet").count()
