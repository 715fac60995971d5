"""Every registered query against its DuckDB twin (the driver's gate, locally)."""
import pytest

import __spark_entry__ as E
from oracle_check import compare, duck_connect
from conftest import SF_SMALL

NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    return duck_connect(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    srows = [r.asDict(recursive=True) for r in E.queries()[name](spark, SF_SMALL).collect()]
    cur = duck.execute(E.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    drows = [dict(zip(cols, r)) for r in cur.fetchall()]
    ok, why = compare(srows, drows)
    assert ok, why


def test_every_query_has_oracle_or_is_rows_only():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["Department", "employees", "attrition_rate"]
