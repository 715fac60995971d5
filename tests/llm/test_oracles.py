"""The training-data queries against their DuckDB twins on a larger table than the general test uses."""
import pytest

from conftest import SF_MID
from hrlens.llm import queries
from oracle_check import compare, duck_connect


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_its_sql(spark, name):
    got = [r.asDict(recursive=True) for r in queries.QUERIES[name](spark, SF_MID).collect()]
    cur = duck_connect(SF_MID).execute(queries.ORACLE[name])
    cols = [d[0] for d in cur.description]
    ok, why = compare(got, [dict(zip(cols, r)) for r in cur.fetchall()])
    assert ok, why
