"""Every query with SQL over the smallest data: Spark and DuckDB agree on columns and rows."""

import collections
import decimal
import glob
import os

import pytest

from blockloom.plans import image_queries, problems, table_queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def _plain(v):
    return round(v, 6) if isinstance(v, float) else float(v) if isinstance(v, decimal.Decimal) else v


def compare(df, sql):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    cols = sorted(df.columns)
    mine = collections.Counter(repr(tuple(map(_plain, r))) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = collections.Counter(repr(tuple(_plain(r[i]) for i in at)) for r in cur.fetchall())
    assert mine == theirs, (list((mine - theirs).items())[:3], list((theirs - mine).items())[:3])


@pytest.mark.parametrize("module", [problems, table_queries, image_queries], ids=lambda m: m.__name__)
def test_sql(spark, module):
    for name, f in module.QUERIES.items():
        df = f(spark, DATA)
        if name in module.SQL:
            compare(df, module.SQL[name])
        else:
            df.count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert {f"p{n}_" for n in (1, 2, 5)} <= {q.split("_")[0] + "_" for q in e.queries()}
