import os

from pyspark.sql import functions as F

from lakesync.functions import conform
from lakesync.sinks import plan_upsert, upsert_to_path, write_table
from lakesync.sources import file_manifest, read_json, read_partitions, read_table
from lakesync.spec import TableSpec

from ticks import DROP, TICKS_SCHEMA, tick, ticks_spec, write_lines


def _validate(df):
    good, _ = conform(df, TICKS_SCHEMA, required=TICKS_SCHEMA.fieldNames())
    return good


def _load(spark, tmp, name, rows):
    write_lines(str(tmp / name), rows)
    return read_json(spark, str(tmp / name), TICKS_SCHEMA)


def _table(spark, spec):
    return {(r.symbol, str(r.date)): (r.ts, r.volume) for r in spark.read.parquet(spec.path).collect()}


def test_stock_ticks_cases(spark, tmp_path):
    spec = ticks_spec(str(tmp_path / "table"))
    b1 = _load(spark, tmp_path, "b1", [
        tick(ts="2018-08-31 09:30:00"), tick(ts="2018-08-31 10:30:00"),            # base
        tick(date="2018/09/01", ts="2018-09-01 09:00:00"),                       # other day
        tick(volume="x"),                                                        # bad type
        tick(symbol=DROP),                                                       # null key
    ])
    r1 = upsert_to_path(b1, spec, validate=_validate, exact_counts=True)
    assert _table(spark, spec) == {("A", "2018-08-31"): ("2018-08-31 10:30:00", 100),
                                   ("A", "2018-09-01"): ("2018-09-01 09:00:00", 100)}
    assert (r1.rows_in, r1.rejected, r1.duplicates, r1.inserted, r1.updated) == (5, 2, 1, 2, 0)
    # partition directory is the dashed DATE, not the escaped slash form
    assert {d for d in os.listdir(spec.path) if d.startswith("date=")} == {"date=2018-08-31", "date=2018-09-01"}

    b2_rows = [tick(ts="2018-08-31 08:00:00", volume=1),     # late
               tick(ts="2018-08-31 10:30:00", volume=999)]   # tie: incoming wins
    b2 = _load(spark, tmp_path, "b2", b2_rows)
    r2 = upsert_to_path(b2, spec, validate=_validate, exact_counts=True)
    after = _table(spark, spec)
    assert after[("A", "2018-08-31")] == ("2018-08-31 10:30:00", 999)
    assert (r2.stale, r2.updated, r2.inserted, r2.duplicates) == (0, 1, 0, 1)
    assert r2.pruned and r2.partitions == 1

    late = _load(spark, tmp_path, "b3", [tick(ts="2018-08-31 08:00:00", volume=1)])
    r3 = upsert_to_path(late, spec, validate=_validate, exact_counts=True)
    assert r3.stale == 1 and r3.updated == 0 and _table(spark, spec) == after
    # without exact counts the same batch reports one superseded row
    r3b = upsert_to_path(_load(spark, tmp_path, "b3b", [tick(ts="2018-08-31 08:00:00", volume=1)]), spec)
    assert (r3b.superseded, r3b.stale, r3b.updated) == (1, None, 0)

    # replay of the second batch changes nothing
    upsert_to_path(_load(spark, tmp_path, "b2r", b2_rows), spec, validate=_validate)
    assert _table(spark, spec) == after


def test_untouched_partitions_keep_their_files(spark, tmp_path):
    spec = ticks_spec(str(tmp_path / "table"))
    upsert_to_path(_load(spark, tmp_path, "b1", [tick(), tick(date="2018/09/01", ts="2018-09-01 09:00:00")]), spec)
    other = tmp_path / "table" / "date=2018-09-01"
    before = {f: os.stat(other / f).st_mtime_ns for f in os.listdir(other)}
    upsert_to_path(_load(spark, tmp_path, "b2", [tick(ts="2018-08-31 11:00:00", volume=5)]), spec)
    assert {f: os.stat(other / f).st_mtime_ns for f in os.listdir(other)} == before
    assert _table(spark, spec)[("A", "2018-08-31")] == ("2018-08-31 11:00:00", 5)


def test_unpartitioned_upsert(spark, tmp_path):
    spec = TableSpec(path=str(tmp_path / "flat"), keys=("symbol",), order="ts")
    upsert_to_path(_load(spark, tmp_path, "b1", [tick(symbol="A"), tick(symbol="B")]), spec)
    upsert_to_path(_load(spark, tmp_path, "b2", [tick(symbol="A", ts="2018-08-31 12:00:00", volume=7)]), spec)
    out = {r.symbol: r.volume for r in spark.read.parquet(spec.path).collect()}
    assert out == {"A": 7, "B": 100}


def test_semi_join_fallback_matches_pruned(spark, tmp_path):
    rows = [tick(symbol=s, date=f"2018/08/{d:02d}", ts=f"2018-08-{d:02d} 09:00:00") for s in "AB" for d in (1, 2, 3)]
    spec_a = ticks_spec(str(tmp_path / "a"))
    spec_b = ticks_spec(str(tmp_path / "b"), max_pruned_partitions=1)
    for spec in (spec_a, spec_b):
        upsert_to_path(_load(spark, tmp_path, "b1", rows), spec)
        res = upsert_to_path(_load(spark, tmp_path, "b2", [tick(symbol="A", date="2018/08/02", ts="2018-08-02 10:00:00", volume=3),
                                                          tick(symbol="C", date="2018/08/03", ts="2018-08-03 10:00:00")]), spec)
        assert res.inserted == 1 and res.updated == 1
    assert _table(spark, spec_a) == _table(spark, spec_b)


def test_write_read_partitions_and_manifest(spark, tmp_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("event_date", F.to_date("ts"))
    path = str(tmp_path / "ev")
    write_table(ev, path, "event_date", parallelism=3)
    schema = ev.schema
    back = read_partitions(spark, path, "event_date=2024-01-1*", schema)
    assert dict(back.dtypes)["event_date"] == "date"
    assert back.count() == ev.where(F.date_format("ts", "yyyy-MM-dd").like("2024-01-1%")).count()
    # folders outside the glob are not in the plan
    assert {f.split("event_date=")[1][:9] for f in back.inputFiles()} == {"2024-01-1"}
    man = file_manifest(read_table(spark, path, schema), ["event_date"])
    assert man.agg(F.sum("row_count")).first()[0] == ev.count()
    assert man.where(F.col("file_size") <= 0).count() == 0


def test_read_json_corrupt_column(spark, tmp_path):
    write_lines(str(tmp_path / "j"), [tick(), "{not json", tick(volume="x")])
    df = read_json(spark, str(tmp_path / "j"), TICKS_SCHEMA, corrupt_col="_corrupt")
    good, rejected = conform(df, TICKS_SCHEMA, required=TICKS_SCHEMA.fieldNames(), corrupt_col="_corrupt")
    assert good.count() == 1
    assert sorted(r._reject_reason for r in rejected.collect()) == ["corrupt record", "corrupt record"]


def test_inferred_json_read(spark, tmp_path):
    write_lines(str(tmp_path / "j"), [tick()])
    df = read_json(spark, str(tmp_path / "j"))
    assert dict(df.dtypes)["year"] == "bigint" and "symbol" in df.columns


def test_interrupted_commit_is_recovered_from_stage(spark, tmp_path):
    spec = ticks_spec(str(tmp_path / "table"))
    upsert_to_path(_load(spark, tmp_path, "b1", [tick(), tick(date="2018/09/01", ts="2018-09-01 09:00:00")]), spec)
    b2 = _load(spark, tmp_path, "b2", [tick(ts="2018-08-31 11:00:00", volume=5)])
    # first attempt: the merge is staged, then the process "dies" before commit
    merged, _ = plan_upsert(b2, spec)
    stage = str(tmp_path / "stage")
    write_table(merged.drop("_src"), stage, "date")
    assert _table(spark, spec)[("A", "2018-08-31")] == ("2018-08-31 09:30:00", 100)
    # replay with the same staging folder commits the staged result as it is
    res = upsert_to_path(b2, spec, stage_path=stage)
    assert res.extra.get("recovered") and not os.path.exists(stage)
    assert _table(spark, spec) == {("A", "2018-08-31"): ("2018-08-31 11:00:00", 5),
                                   ("A", "2018-09-01"): ("2018-09-01 09:00:00", 100)}
    # a normal replay afterwards changes nothing
    upsert_to_path(b2, spec, stage_path=stage)
    assert _table(spark, spec)[("A", "2018-08-31")] == ("2018-08-31 11:00:00", 5)


def _merge_rows(spark, spec):
    from lakesync.plans.suite import STORED_SCHEMA
    t = read_table(spark, spec.path, STORED_SCHEMA)
    return sorted((r.user_id, str(r.event_date), r.event_id, str(r.ts), r.value)
                  for r in t.select("user_id", "event_date", "event_id", "ts", "value").collect())


def test_broadcast_and_shuffle_merge_agree_with_oracle(spark, tmp_path):
    import duckdb

    from conftest import SF0001
    from lakesync.plans.oracles import UPSERT
    from lakesync.plans.suite import events, events_spec, restamped

    ev = events(spark, SF0001)
    got, counts = {}, {}
    for strategy in ("broadcast", "shuffle"):
        spec = events_spec(str(tmp_path / strategy))
        assert upsert_to_path(ev, spec).strategy == "create"
        r = upsert_to_path(restamped(ev), spec, strategy=strategy, exact_counts=True)
        assert r.strategy == strategy
        got[strategy] = _merge_rows(spark, spec)
        counts[strategy] = (r.rows_in, r.duplicates, r.stale, r.inserted, r.updated, r.stored_read)
    assert got["broadcast"] == got["shuffle"]
    assert counts["broadcast"] == counts["shuffle"]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF0001}/events.parquet')")
    want = sorted((r[0], str(r[1]), r[2], str(r[3]), r[4]) for r in con.sql(UPSERT).fetchall())
    assert got["broadcast"] == want


def test_auto_strategy_follows_measured_sizes(spark, tmp_path):
    # the stored day holds 5,000 symbols; the batch updates one of them
    big = [tick(symbol=f"S{i:04d}", ts="2018-08-31 09:00:00") for i in range(5000)]
    one = [tick(symbol="S0001", ts="2018-08-31 10:00:00", volume=7)]
    outweighed = ticks_spec(str(tmp_path / "outweighed"))
    never = ticks_spec(str(tmp_path / "never"), broadcast_bytes=0)
    for spec in (outweighed, never):
        upsert_to_path(_load(spark, tmp_path, "big", big), spec)
    r_big = upsert_to_path(_load(spark, tmp_path, "one", one), outweighed)
    r_never = upsert_to_path(_load(spark, tmp_path, "one", one), never)
    # within the bound and the stored side outweighs the batch: broadcast;
    # a zero bound: shuffle; same table either way
    assert (r_big.strategy, r_never.strategy) == ("broadcast", "shuffle")
    assert r_big.batch_bytes == r_never.batch_bytes > 0
    assert _table(spark, outweighed) == _table(spark, never)
    assert (r_big.updated, r_big.inserted, r_big.stored_read) == (1, 0, 5000)
    # a stored side not much larger than the batch: shuffle merge
    small = ticks_spec(str(tmp_path / "small"))
    upsert_to_path(_load(spark, tmp_path, "b1", [tick(symbol=s) for s in "ABC"]), small)
    r_small = upsert_to_path(_load(spark, tmp_path, "b2", [tick(ts="2018-08-31 10:00:00", volume=7)]), small)
    assert r_small.strategy == "shuffle" and (r_small.updated, r_small.inserted) == (1, 0)


def test_stored_read_lists_only_touched_partitions(spark, tmp_path):
    from lakesync.sinks.table import UpsertResult, _incoming, _read_stored

    spec = ticks_spec(str(tmp_path / "table"))
    rows = [tick(date=f"2018/08/{d:02d}", ts=f"2018-08-{d:02d} 09:00:00") for d in range(1, 11)]
    upsert_to_path(_load(spark, tmp_path, "b1", rows), spec)
    # one touched partition is stored, the other does not exist yet
    b2 = _incoming(_load(spark, tmp_path, "b2", [tick(date="2018/08/03", ts="2018-08-03 10:00:00"),
                                                 tick(date="2018/09/30", ts="2018-09-30 10:00:00")]), spec, None)
    res = UpsertResult(spec.path)
    stored, dirs = _read_stored(spark, spec, b2.schema, b2, res)
    assert [d.rsplit("/", 1)[-1] for d in dirs] == ["date=2018-08-03"]
    files = stored.inputFiles()
    assert files and all("/date=2018-08-03/" in f for f in files)
    assert res.partitions == 2 and stored.count() == 1
    r = upsert_to_path(_load(spark, tmp_path, "b3", [tick(date="2018/08/03", ts="2018-08-03 10:00:00"),
                                                     tick(date="2018/09/30", ts="2018-09-30 10:00:00")]), spec)
    assert (r.updated, r.inserted, r.stored_read) == (1, 1, 1)
    assert len(_table(spark, spec)) == 11


def test_full_overwrite_is_static_whatever_the_session_default(spark, tmp_path):
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "dynamic"
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("event_date", F.to_date("ts"))
    path = str(tmp_path / "t")
    write_table(ev, path, "event_date")
    one_day = ev.where(F.col("event_date") == F.lit("2024-01-05").cast("date"))
    write_table(one_day, path, "event_date", mode="overwrite")
    assert spark.read.parquet(path).count() == one_day.count()
    write_table(ev, path, "event_date", mode="overwrite")
    write_table(one_day, path, "event_date", mode="overwrite", dynamic=True)
    assert spark.read.parquet(path).count() == ev.count()


def test_existing_paths_and_content_bytes(spark, tmp_path):
    from lakesync.session import content_bytes, existing_paths

    (tmp_path / "a" / "x").mkdir(parents=True)
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "f.txt").write_text("hello")
    paths = [str(tmp_path / "a" / "x"), str(tmp_path / "a" / "y"), str(tmp_path / "b" / "f.txt"),
             str(tmp_path / "missing" / "z"), str(tmp_path / "b") + "/"]
    got = existing_paths(spark, paths)
    assert got == {paths[0]: True, paths[1]: False, paths[2]: True, paths[3]: False, paths[4]: True}
    assert content_bytes(spark, str(tmp_path / "b")) == 5
    assert content_bytes(spark, str(tmp_path / "missing")) == 0


def test_upserts_keep_untouched_partitions_under_a_static_session_default(spark, tmp_path):
    old = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    try:
        for strategy in ("broadcast", "shuffle"):
            spec = ticks_spec(str(tmp_path / strategy))
            upsert_to_path(_load(spark, tmp_path, "b1", [tick(), tick(date="2018/09/01", ts="2018-09-01 09:00:00")]),
                           spec)
            upsert_to_path(_load(spark, tmp_path, "b2", [tick(ts="2018-08-31 11:00:00", volume=5)]), spec,
                           strategy=strategy)
            assert _table(spark, spec) == {("A", "2018-08-31"): ("2018-08-31 11:00:00", 5),
                                           ("A", "2018-09-01"): ("2018-09-01 09:00:00", 100)}
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", old)


def test_existing_paths_listing_mode_agrees(spark, tmp_path, monkeypatch):
    import importlib

    session = importlib.import_module("lakesync.session")
    for i in range(0, 40, 3):
        (tmp_path / f"p={i}").mkdir()
    paths = [str(tmp_path / f"p={i}") for i in range(40)]
    monkeypatch.setattr(session, "_EXISTS_PER_PATH", 1000)
    per_path = session.existing_paths(spark, paths)
    monkeypatch.setattr(session, "_EXISTS_PER_PATH", 0)
    listed = session.existing_paths(spark, paths)
    assert per_path == listed and sum(per_path.values()) == 14
