"""Every query with SQL gives the rows of that SQL over the smallest tables."""

from __future__ import annotations

import os

import pytest
from compare import duck, rows_of

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"
_Q, _S = __spark_entry__.queries(), __spark_entry__.oracle_sql()


def test_every_sql_has_a_query():
    assert set(_S) <= set(_Q)
    assert len(_Q) > 150


@pytest.fixture(scope="module")
def con():
    """The tables in the other engine."""
    return duck(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", sorted(_S))
def test_rows(spark, con, name):
    df = _Q[name](spark, FOLDER)
    cur = con.execute(_S[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(cols, cur.fetchall())
