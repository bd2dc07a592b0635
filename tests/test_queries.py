"""Every query of the core against its SQL, on the smallest tables."""

import pytest
from oracle import compare

from blockloom.queries import catalog

QUERIES = {n: q for m in catalog.modules() for n, q in m.QUERIES.items()}
ORACLE = {n: s for m in catalog.modules() for n, s in m.ORACLE.items()}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    if name in ORACLE:
        _, ours, theirs = compare(df, ORACLE[name], data)
        assert not ours and not theirs
    else:
        assert df.count() >= 0
        assert len(set(df.columns)) == len(df.columns)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
