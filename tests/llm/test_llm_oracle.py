"""Every registered query with SQL equals it on the small tables."""
import pytest

from tripstats.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    rel = duck.execute(queries.ORACLE[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(r[names.index(c)] for c in cols) for r in rel.fetchall()), key=repr)
