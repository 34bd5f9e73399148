import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from tripstats.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    ck = tmp_path_factory.mktemp("checkpoint")
    s = build_session("local[4]", app="tripstats-tests", shuffle_partitions=8,
                      extra={"spark.checkpoint.dir": str(ck)})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def rows(df, cols=None):
    cols = cols or df.columns
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def scanned_rows(df):
    """Rows that the file scans of ``df`` hand on, when it runs."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.collectAsList() if hasattr(df._jdf, "collectAsList") else df.collect()
    while plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.executedPlan()

    def scans(node):
        own = [node] if node.nodeName().startswith("Scan") else []
        kids = node.children()
        return own + [s for i in range(kids.size()) for s in scans(kids.apply(i))]
    return sum(s.metrics().apply("numOutputRows").value() for s in scans(plan))
