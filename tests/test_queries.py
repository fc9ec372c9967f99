"""Every registered grammar query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest
from glyphloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def rows(frame):
    clean = lambda x: None if x is None or x != x else int(x) if isinstance(x, float) and x.is_integer() else x
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(repr([clean(x) for x in r]) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, FOLDER).toPandas()
    assert rows(got) == rows(duck.sql(catalog.oracle_sql()[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(catalog.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
