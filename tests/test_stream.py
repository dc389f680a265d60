import duckdb

from lakesync.plans.oracles import UPSERT
from lakesync.plans.suite import EVENTS_SCHEMA, STORED_SCHEMA, events, events_spec, restamped
from lakesync.sources import read_table, write_json
from lakesync.streaming import run_upsert_stream

from conftest import SF0001


def _rows(rows):
    return sorted((r[0], str(r[1]), r[2], str(r[3]), r[4]) for r in rows)


def test_available_now_twice_and_matches_upsert_oracle(spark, tmp_path):
    root = str(tmp_path)
    spec = events_spec(f"{root}/table")
    ev = events(spark, SF0001)
    write_json(ev, f"{root}/input/b0")
    r1 = run_upsert_stream(spark, f"{root}/input/*", EVENTS_SCHEMA, spec, f"{root}/ckpt")
    assert sum(r.rows_in for r in r1) == ev.count()
    # nothing new: the second run consumes no file and changes nothing
    n1 = read_table(spark, spec.path, STORED_SCHEMA).count()
    r2 = run_upsert_stream(spark, f"{root}/input/*", EVENTS_SCHEMA, spec, f"{root}/ckpt")
    assert sum(r.rows_in for r in r2) == 0
    assert read_table(spark, spec.path, STORED_SCHEMA).count() == n1

    write_json(restamped(ev), f"{root}/input/b1")
    r3 = run_upsert_stream(spark, f"{root}/input/*", EVENTS_SCHEMA, spec, f"{root}/ckpt", max_files_per_trigger=2)
    assert len(r3) >= 1
    got = read_table(spark, spec.path, STORED_SCHEMA).select("user_id", "event_date", "event_id", "ts", "value")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF0001}/events.parquet')")
    assert _rows(got.collect()) == _rows(con.sql(UPSERT).fetchall())


def test_byte_bound_splits_backlog_into_batches(spark, tmp_path):
    from lakesync.plans.oracles import LATEST

    root = str(tmp_path)
    spec = events_spec(f"{root}/table")
    ev = events(spark, SF0001)
    write_json(ev.repartition(4), f"{root}/input/b0")
    res = run_upsert_stream(spark, f"{root}/input/*", EVENTS_SCHEMA, spec, f"{root}/ckpt",
                            max_bytes_per_trigger=1)
    assert len(res) >= 2 and sum(r.rows_in for r in res) == ev.count()
    assert {r.strategy for r in res[1:]} <= {"broadcast", "shuffle"}
    got = read_table(spark, spec.path, STORED_SCHEMA).select("event_id").collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF0001}/events.parquet')")
    assert sorted(r[0] for r in got) == sorted(r[0] for r in con.sql(LATEST).fetchall())
