"""The registered queries against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from unitlife.plans import oracle
from tools.check_oracle import TABLES, normal

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")

NAMES = sorted(oracle.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    theirs = sorted(tuple(normal(v) for v in row) for row in cursor.fetchall())
    assert sorted(tuple(normal(r[c]) for c in columns) for r in df.collect()) == theirs


def test_sorted_results_are_in_order(spark):
    """The rows of the ordered reports as they come."""
    run = entry.queries()
    report = run["drift_report"](spark, SMALL).collect()
    assert report == sorted(report, key=lambda r: (-r.psi, r.feature))
    metrics = run["metrics_report"](spark, SMALL).collect()
    assert [r.split for r in metrics] == sorted((r.split for r in metrics), reverse=True)
    for split in {r.split for r in metrics}:
        own = [(r.horizon, r.mae, r.unit_id, r.method) for r in metrics if r.split == split]
        assert [x[0] for x in own] == sorted(x[0] for x in own)
        assert all(a[0] != b[0] or a[1] <= b[1] + 1e-12 for a, b in zip(own, own[1:], strict=False))
    examples = [(r.unit_id, r.cycle_index, r.capacity_ah) for r in run["capacity_examples"](spark, SMALL).collect()]
    assert examples == sorted(examples)
