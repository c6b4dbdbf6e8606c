import duckdb
import pytest

import __spark_entry__ as entry
from millrace.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def oracle(name, sql, folder=DATA):
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "pages", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    return sorted(names), sorted(repr([plain(dict(zip(names, r, strict=True))[n]) for n in sorted(names)]) for r in result.fetchall())


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


def mine(df):
    names = sorted(df.columns)
    return names, sorted(repr([plain(r[n]) for n in names]) for r in df.collect())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    assert mine(QUERIES[name](spark, DATA)) == oracle(name, ORACLE_SQL[name])


def test_contract(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
