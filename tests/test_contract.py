"""Faults that once lost or changed stored data; each has its rule in the README contract."""

import os

import pytest
from pyspark.sql import functions as F

from lakesync.catalog.publish import publish, sync_partitions
from lakesync.functions import partition_value, record_key
from lakesync.operators.audits import audit_databases
from lakesync.plans import ingest, run_batch, run_inline, run_separate
from lakesync.sinks.table import upsert_to_path, write_table
from lakesync.spec import TableSpec

from ticks import write_lines

SCHEMA = "k string, p string, o int, v int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def spec_at(path, **kw):
    return TableSpec(path=str(path), keys=("k",), order="o", partition="p", **kw)


def test_both_merges_keep_stored_rows_the_batch_does_not_name(spark, tmp_path):
    stored = [("a", "x", 1, 1), ("d", "x", 1, 2), ("d", "x", 5, 3), (None, "x", 1, 4), (None, "x", 2, 5), ("e", "x", 9, 6), ("e", "x", 9, 7), ("f", "x", None, 8)]
    batch = [("a", "x", 2, 10), ("e", "x", 3, 11), ("f", "x", None, 12), ("n", "x", 1, 13)]
    got = {}
    for strategy in ("broadcast", "shuffle"):
        spec = spec_at(tmp_path / strategy)
        write_table(spark.createDataFrame(stored, SCHEMA), spec.path, "p")
        res = upsert_to_path(spark.createDataFrame(batch, SCHEMA), spec, strategy=strategy)
        assert res.strategy == strategy and (res.inserted, res.updated, res.superseded) == (1, 2, 1)
        got[strategy] = rows(spark.read.parquet(spec.path).select("k", "p", "o", "v"))
    want = [r for r in stored if r[0] not in ("a", "f")] + [batch[0], batch[2], batch[3]]
    assert got["broadcast"] == got["shuffle"] == sorted(want, key=str)


def test_empty_partition_is_rejected(spark, tmp_path):
    spec = spec_at(tmp_path / "t")
    upsert_to_path(spark.createDataFrame([("a", "", 1, 1), ("b", "x", 1, 2)], SCHEMA), spec)
    res = upsert_to_path(spark.createDataFrame([("c", "", 1, 1), ("d", "__HIVE_DEFAULT_PARTITION__", 1, 1)], SCHEMA), spec)
    assert res.rejected == 2 and [r.k for r in spark.read.parquet(spec.path).collect()] == ["b"]


@pytest.mark.parametrize("part", ["p", None])
def test_lost_or_retyped_column_fails_before_the_write(spark, tmp_path, part):
    spec = TableSpec(path=str(tmp_path / "t"), keys=("k",), order="o", partition=part)
    upsert_to_path(spark.createDataFrame([("a", "x", 1, 7)], SCHEMA), spec)
    for bad in (spark.createDataFrame([("b", "x", 1)], "k string, p string, o int"), spark.createDataFrame([("b", "x", 1, "s")], "k string, p string, o int, v string")):
        with pytest.raises(ValueError, match="incompatibly"):
            upsert_to_path(bad, spec)
    assert rows(spark.read.parquet(spec.path).select("k", "v")) == [("a", 7)]
    upsert_to_path(spark.createDataFrame([("b", "x", 1, 2, 3)], SCHEMA + ", w int"), spec)  # a new column is fine
    assert spark.read.option("mergeSchema", True).parquet(spec.path).where("w = 3").count() == 1


def test_unpartitioned_inline_twice_and_checkpoint_survives_a_batch_run(spark, tmp_path):
    src = str(tmp_path / "in")
    spec = TableSpec(path=str(tmp_path / "t"), keys=("k",), order="o", database="contract", table="flat")
    write_lines(src, [{"k": "a", "o": 1}], "1.json")
    run_inline(spark, src, "k string, o int", spec)
    write_lines(src, [{"k": "b", "o": 1}, {"k": "a", "o": 2}], "2.json")
    run_inline(spark, src, "k string, o int", spec)
    assert rows(spark.table("contract.flat")) == [("a", 2), ("b", 1)]
    run_batch(spark, src, spec, schema="k string, o int")
    assert os.path.exists(f"{spec.path}.lakesync_checkpoint")
    assert run_inline(spark, src, "k string, o int", spec).totals()["rows_in"] == 0
    with pytest.raises(ValueError, match="inside the table"):
        run_inline(spark, src, "k string, o int", spec, checkpoint=f"{spec.path}/ckpt")


def test_lost_publication_is_made_up(spark, tmp_path, monkeypatch):
    src = str(tmp_path / "in")
    spec = spec_at(tmp_path / "t", database="contract", table="lost")
    write_lines(src, [{"k": "a", "p": "x", "o": 1, "v": 1}], "1.json")
    run_separate(spark, src, SCHEMA, spec)
    write_lines(src, [{"k": "a", "p": "y", "o": 1, "v": 1}], "2.json")
    with monkeypatch.context() as m:
        m.setattr(ingest, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            run_separate(spark, src, SCHEMA, spec)
    assert spark.table("contract.lost").count() == 1
    write_lines(src, [{"k": "a", "p": "z", "o": 1, "v": 1}], "3.json")
    assert run_separate(spark, src, SCHEMA, spec).partitions["ADD"] == 2
    assert spark.table("contract.lost").count() == 3


def test_sync_settles_whatever_the_values(spark, tmp_path):
    spec = spec_at(tmp_path / "t", database="contract", table="odd")
    values = ["a+b", "a b", "c%d", "e=f", "g/h", "i'j", "ü"]
    write_table(spark.createDataFrame([("k", v, 1, 1) for v in values], SCHEMA), spec.path, "p")
    publish(spark, spec, spark.createDataFrame([], "k string, o int, v int, p string").schema)
    assert sync_partitions(spark, spec) == {"ADD": len(values), "DROP": 0}
    assert sync_partitions(spark, spec) == {"ADD": 0, "DROP": 0}
    assert sorted(r.p for r in spark.table("contract.odd").collect()) == sorted(values)


def test_database_names_match_in_any_case(spark):
    out = audit_databases(spark.createDataFrame([("MyDb",)], "database string"), spark.createDataFrame([("mydb",)], "database string"))
    assert out.first().success


def test_batch_run_rejects_what_the_others_reject(spark, tmp_path):
    src = str(tmp_path / "in")
    spec = TableSpec(path=str(tmp_path / "t"), keys=("k",), order="ts", database="contract", table="bad")
    lines = ['{"k": "a", "ts": "2024-01-01 00:00:00", "v": 1}', '{"k": "b", "ts": "2024-01-01 00:00:00", "v": "x"}', "{broken",
             '{"k": "c", "ts": null, "v": 2}', '{"k": null, "ts": "2024-01-01 00:00:00", "v": 3}']
    write_lines(src, lines)
    schema = "k string, ts string, v bigint"
    run_batch(spark, src, spec, schema=schema)
    assert dict(spark.table("contract.bad").dtypes) == {"k": "string", "ts": "timestamp_ntz", "v": "bigint"}
    assert [r.k for r in spark.table("contract.bad").collect()] == ["a"]
    other = TableSpec(path=str(tmp_path / "u"), keys=("k",), order="ts", database="contract", table="bad_inline")
    assert run_inline(spark, src, schema, other).totals()["rejected"] == 4
    assert spark.table("contract.bad_inline").schema == spark.table("contract.bad").schema
    write_lines(src, lines[:1] + ["{broken"], "part-0.json")
    run_batch(spark, src, spec)  # inferred: the malformed line leaves no column behind
    assert set(spark.table("contract.bad").columns) == {"k", "ts", "v"}


@pytest.mark.parametrize("n", [9, 50])
def test_parallelism_is_the_number_of_write_tasks(spark, n):
    from lakesync.sinks.table import _layout

    df = spark.range(60000).selectExpr("cast(id as string) k", "cast(id % 30 as string) p", "id o")
    assert _layout(df, ["p"], n).rdd.getNumPartitions() == n
    assert _layout(df, [], n).rdd.getNumPartitions() == n


def test_keys_and_partition_values(spark):
    df = spark.createDataFrame([("1,b:2", None), ("1", "2"), ("1", "\\N"), ("1", None)], "a string, b string")
    assert df.select(record_key("a", "b").alias("r")).distinct().count() == 4
    one = spark.createDataFrame([("date=2018%2F08%2F31",), ("2018/08/31",)], "d string").select(partition_value("d").alias("d"))
    assert [str(r.d) for r in one.collect()] == ["2018-08-31"] * 2 and F
