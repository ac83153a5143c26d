import glob
import os

import duckdb
import pytest

import __spark_entry__
from lexiloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def keyed(rows, columns):
    return sorted(tuple("%.9g" % v if isinstance(v, float) else str(v) for v in (r[c] for c in columns)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, name):
    got = catalogue.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for p in glob.glob(SF + "/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    want = con.execute(catalogue.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = [dict(zip(names, r)) for r in want.fetchall()]
    assert keyed([r.asDict() for r in got.collect()], sorted(names)) == keyed(rows, sorted(names))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
