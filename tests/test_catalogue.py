"""Every query of the catalogue against its SQL at a small size."""

import math
import os

import duckdb
import pytest

from varstrata.plans import catalogue


@pytest.fixture(scope="module")
def db(small):
    c = duckdb.connect()
    for name in os.listdir(small):
        c.execute(f"create view {name[:-8]} as select * from '{small}/{name}'")
    return c


def plain(row):
    return tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in row)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, small, db, name):
    got = catalogue.queries()[name](spark, small)
    columns = sorted(got.columns)
    rows = sorted((plain(r[c] for c in columns) for r in got.collect()), key=repr)
    assert rows or name == "cat_block_range"
    if name in catalogue.oracle_sql():
        said = db.execute(catalogue.oracle_sql()[name])
        names = [d[0] for d in said.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert rows == sorted((plain(r[k] for k in at) for r in said.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["record_idx", "user_id", "event_type"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
