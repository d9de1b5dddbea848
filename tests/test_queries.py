"""Each query with SQL against the other engine."""

import pytest

from sparkrisk.plans import queries as engine

from .conftest import SMALL, same_rows

SQL = engine.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    same_rows(engine.queries()[name](spark, SMALL).toPandas(), duck.sql(SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["boosted_scores", "anomaly_scores", "graph_snapshots"])
def test_runs(spark, name):
    assert engine.queries()[name](spark, SMALL).count() > 0


def test_scores_next_to_a_half(spark, tmp_path):
    """Scores that lie next to a half in the place that is rounded away are the other engine's, and so are counts at thresholds."""
    import duckdb

    events = duckdb.sql(f"SELECT * EXCLUDE k REPLACE (k AS event_id, CAST(CASE WHEN k % 10 = 9 THEN 196 ELSE 93.6 END AS DOUBLE) AS value, 'error' AS event_type) FROM '{SMALL}/events.parquet', (SELECT unnest(range(1000)) AS k) WHERE event_id = 0")
    events.write_parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    for name in ("decisions", "threshold_points"):
        same_rows(engine.queries()[name](spark, str(tmp_path)).toPandas(), con.sql(SQL[name]).df())
