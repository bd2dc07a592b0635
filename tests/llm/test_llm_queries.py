"""Every query of the subpackage against its SQL, or by its shape."""

import pytest
from oracle import compare

from blockloom.llm import modules

QUERIES = {n: q for m in modules() for n, q in m.QUERIES.items()}
ORACLE = {n: s for m in modules() for n, s in m.ORACLE.items()}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    if name in ORACLE:
        _, ours, theirs = compare(df, ORACLE[name], data)
        assert not ours and not theirs
    else:
        assert df.count() >= 0
        assert len(set(df.columns)) == len(df.columns)


def test_registered():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLE) <= set(QUERIES)
