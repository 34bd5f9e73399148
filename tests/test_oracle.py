"""Every catalog query equals its DuckDB SQL twin on the small tables."""
import math

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from tripstats.plans import catalog

KEYS = sorted(catalog.queries())       # the optional subpackage tests its own


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def test_every_query_has_an_oracle():
    assert set(KEYS) <= set(E.oracle_sql()) and set(KEYS) <= set(E.queries())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, key):
    df = E.queries()[key](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in rel.description]
    assert sorted(dcols) == cols
    want = sorted((tuple(_norm(r[dcols.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert len(got) == len(want)
    assert got == want


def test_entry_runs(spark):
    df = E.entry(spark)
    out = df.collect()
    assert [r.pickup_days for r in out][:1] == ["Monday"]
    assert df.columns == ["pickup_days", "avg_trip_days"]
