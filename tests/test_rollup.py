"""The job rollup counts every event: DuckDB's rollup of all events, which st3_stream_job_progress has as its SQL."""

import duckdb

from itemloom.plans import registry


def test_rollup_of_all_events(spark, sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf}/events.parquet')")
    columns = ["job_id", "processed", "imported", "review", "errors", "status"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE_SQL['st3_stream_job_progress']})").fetchall()
    got = [tuple(r) for r in registry.QUERIES["a9_job_rollup"](spark, sf).select(columns).collect()]
    assert sorted(got) == sorted(want)
    assert sum(r[1] for r in got) == con.execute("SELECT count(*) FROM events").fetchone()[0]
