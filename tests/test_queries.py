"""Registered engine queries against their SQL, on the smallest tables."""
import datetime
import decimal

import pytest

from stratalog.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    return int(x) if isinstance(x, decimal.Decimal) and x == int(x) else x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else x


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    df = QUERIES[name].run(spark, SF)
    cols = sorted(df.columns)
    r = db.sql(QUERIES[name].sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(row[names.index(c)]) for c in cols) for row in r.fetchall()), key=str)
    assert sorted((tuple(plain(row[c]) for c in cols) for row in df.collect()), key=str) == want
