import pytest
from pyspark.sql import functions as F

from lakesync.plans import run_batch, run_inline, run_separate, run_validate
from lakesync.spec import TableSpec

from ticks import TICKS_SCHEMA, tick, ticks_spec, write_lines

ROWS = [tick(ts="2018-08-31 09:30:00"), tick(ts="2018-08-31 10:30:00"),
        tick(symbol="B", ts="2018-08-31 10:00:00"), tick(date="2018/09/01", ts="2018-09-01 09:00:00"),
        tick(symbol="C", ts="bad"), tick(volume="x")]


def _state(spark, name):
    rows = sorted((r.symbol, str(r.date), str(r.ts), r.volume) for r in spark.table(name).collect())
    parts = sorted(r.partition for r in spark.sql(f"SHOW PARTITIONS {name}").collect())
    return rows, parts


def test_inline_equals_separate(spark, tmp_path):
    write_lines(str(tmp_path / "in"), ROWS)
    a = ticks_spec(str(tmp_path / "a"), database="plans_db", table="ticks_inline")
    b = ticks_spec(str(tmp_path / "b"), database="plans_db", table="ticks_separate")
    sa = run_inline(spark, str(tmp_path / "in"), TICKS_SCHEMA, a, order_format="yyyy-MM-dd HH:mm:ss")
    sb = run_separate(spark, str(tmp_path / "in"), TICKS_SCHEMA, b, order_format="yyyy-MM-dd HH:mm:ss")
    assert sa.ok and sb.ok
    assert _state(spark, a.qualified_name) == _state(spark, b.qualified_name)
    rows, parts = _state(spark, a.qualified_name)
    assert [r[:2] for r in rows] == [("A", "2018-08-31"), ("A", "2018-09-01"), ("B", "2018-08-31")]
    assert parts == ["date=2018-08-31", "date=2018-09-01"]
    assert sa.totals()["rejected"] == 2  # bad time (lenient) and bad volume
    assert dict(spark.table(a.qualified_name).dtypes)["ts"] == "timestamp_ntz"
    # a second inline run finds no new file
    again = run_inline(spark, str(tmp_path / "in"), TICKS_SCHEMA, a, order_format="yyyy-MM-dd HH:mm:ss")
    assert again.totals()["rows_in"] == 0


def test_separate_skips_publish_after_failed_ingest(spark, tmp_path):
    write_lines(str(tmp_path / "in"), ROWS)
    spec = ticks_spec(str(tmp_path / "t"), database="plans_db", table="ticks_strict")
    s = run_separate(spark, str(tmp_path / "in"), TICKS_SCHEMA, spec, order_format="yyyy-MM-dd HH:mm:ss",
                     strict=True)
    assert not s.ok and s.publish is None
    assert not spark.catalog.tableExists(spec.qualified_name)


def test_batch_strict_throws_lenient_rejects(spark, tmp_path):
    write_lines(str(tmp_path / "in"), [tick(ts="2018-08-31 09:30:00"), tick(ts="2018-08-31 10:30:00"),
                                        tick(symbol="C", ts="bad")])
    strict = ticks_spec(str(tmp_path / "s"), database="plans_db", table="ticks_batch_strict")
    with pytest.raises(Exception):
        run_batch(spark, str(tmp_path / "in"), strict)
    lenient = ticks_spec(str(tmp_path / "l"), database="plans_db", table="ticks_batch")
    s = run_batch(spark, str(tmp_path / "in"), lenient, strict=False)
    assert s.batches[0]["rejected"] == 1
    out = spark.table(lenient.qualified_name).collect()
    assert [(r.symbol, str(r.ts)) for r in out] == [("A", "2018-08-31 10:30:00")]


def test_validate_verdicts(spark, tmp_path):
    write_lines(str(tmp_path / "in"), ROWS[:2])
    ok = ticks_spec(str(tmp_path / "ok"), database="plans_db", table="ticks_ok")
    run_inline(spark, str(tmp_path / "in"), TICKS_SCHEMA, ok, order_format="yyyy-MM-dd HH:mm:ss")
    missing = TableSpec(path=str(tmp_path / "missing"), keys=("symbol",), order="ts",
                        database="plans_db", table="ticks_missing")
    checks, verdicts = run_validate(spark, [ok, missing])
    v = {r.target: (r.success, r.n_checks, r.n_failed) for r in verdicts.collect()}
    assert v == {ok.qualified_name: (True, 3, 0), missing.qualified_name: (False, 3, 2)}
    assert checks.where(F.col("success")).count() == 4


def test_second_inline_run_registers_only_touched_partitions(spark, tmp_path):
    write_lines(str(tmp_path / "in"), ROWS[:4], name="part-0.json")
    spec = ticks_spec(str(tmp_path / "t"), database="plans_db", table="ticks_incremental")
    first = run_inline(spark, str(tmp_path / "in"), TICKS_SCHEMA, spec, order_format="yyyy-MM-dd HH:mm:ss")
    assert first.publish["created"] and first.partitions == {"ADD": 2, "DROP": 0}
    write_lines(str(tmp_path / "in"), [tick(date="2018/09/02", ts="2018-09-02 09:00:00"),
                                       tick(ts="2018-08-31 11:00:00", volume=5)], name="part-1.json")
    second = run_inline(spark, str(tmp_path / "in"), TICKS_SCHEMA, spec, order_format="yyyy-MM-dd HH:mm:ss")
    assert second.partitions == {"ADD": 1, "DROP": 0}
    rows, parts = _state(spark, spec.qualified_name)
    assert parts == ["date=2018-08-31", "date=2018-09-01", "date=2018-09-02"]
    assert ("A", "2018-08-31", "2018-08-31 11:00:00", 5) in rows and len(rows) == 4
