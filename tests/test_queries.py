"""Every query with SQL gives the rows that an independent engine gives for it."""

import math
import os

import pytest

from haargrid.jobs import images_sql, oracle, restructure_sql, studies, studies_sql  # noqa: F401
from haargrid.jobs.queries import QUERIES

ORACLE_SQL = oracle.ORACLE_SQL | studies_sql.ORACLE_SQL | restructure_sql.ORACLE_SQL | images_sql.ORACLE_SQL


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


@pytest.fixture(scope="module")
def con(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in os.listdir(sf_dir):
        c.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{sf_dir}/{t}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_others_give_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).limit(1).count() == 1
