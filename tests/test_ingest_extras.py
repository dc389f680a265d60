"""One-pass inference, the reject store, exact counts, described specs and the history of checks."""

import json

import pytest
from pyspark.sql import functions as F

from lakesync.catalog import describe_dataset, described_spec, publish, read_spec
from lakesync.functions import conform_tagged
from lakesync.operators import check_history, latest_checks, record_checks, run_changes
from lakesync.plans import replay, run_inline, run_separate
from lakesync.sinks import table as tables
from lakesync.sinks import upsert_to_path
from lakesync.sinks.rejects import read_rejects, store_rejects
from lakesync.sources import read_json, read_json_inferred
from lakesync.spec import TableSpec

from ticks import write_lines

SCHEMA = "k string, p string, o int, v int"
LINES = ['{"k": "a", "p": "x", "o": 1, "v": 1}', '{"k": "b", "p": "x", "o": 1, "v": "two"}', "{broken", '{"k": null, "p": "x", "o": 1, "v": 3}',
         '{"k": "c", "p": "x", "v": 4}', '{"k": "d", "p": "", "o": 1, "v": 5}', '{"k": "a", "p": "x", "o": 2, "v": 6}', '{"k": "e", "o": 1, "v": 7}']
REASONS = {"corrupt record": 2, "null required field: k": 1, "null required field: o": 1, "unusable partition: p": 1, "null partition: p": 1}


def spec_at(path, **kw):
    return TableSpec(path=str(path), keys=("k",), order="o", partition="p", **kw)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# ------------------------------------------------------------------ S2
def test_inferred_types(spark, tmp_path):
    lines = ['{"a": 1, "b": "x", "c": {"d": 1.5, "e": [1, 2]}, "g\'h": true, "big": 123456789012345678901, "n": null, "m": 1}',
             '{"a": 2.5, "b": null, "c": {"d": 2, "f": "y"}, "m": "two", "é-1 x": 1}', '{"m": {"z": [1]}, "o": {}}', "{broken", "[1, 2]", "7", "", "  "]
    write_lines(str(tmp_path / "j"), lines)
    df = read_json_inferred(spark, str(tmp_path / "j"), corrupt_col="bad")
    assert dict(df.dtypes) == {"a": "double", "b": "string", "big": "double", "c": "struct<d:double,e:array<bigint>,f:string>", "g'h": "boolean", "m": "string",
                               "n": "string", "o": "string", "é-1 x": "bigint", "bad": "string"}
    good = {r.m: r for r in df.where("bad is null").collect()}
    assert set(good) == {"1", "two", '{"z":[1]}'} and good["1"].a == 1.0 and good["two"].c.f == "y" and good["1"].c.e == [1, 2] and good["1"]["g'h"] is True
    assert good["1"].big == 123456789012345678901.0 and good["two"].c.d == 2.0 and good["two"]["é-1 x"] == 1
    assert sorted(r.bad for r in df.where("bad is not null").collect()) == ["7", "[1, 2]", "{broken"]
    assert read_json_inferred(spark, str(tmp_path / "j")).count() == 3


def test_inferred_read_scans_the_text_once(spark, tmp_path):
    write_lines(str(tmp_path / "j"), ['{"a": 1}', '{"a": 2}'])
    df = read_json_inferred(spark, str(tmp_path / "j"))
    assert str(tmp_path / "j") not in " ".join(df.inputFiles()) and df.agg(F.sum("a")).first()[0] == 3
    write_lines(str(tmp_path / "e"), ["", "{no"])
    assert read_json_inferred(spark, str(tmp_path / "e")).columns == []


def test_inferred_schema_equals_the_two_pass_reader(spark, tmp_path):
    lines = [json.dumps({"s": "x", "i": i, "d": i / 4, "t": "2024-01-01 00:00:00", "l": [i], "o": {"q": str(i)}, "b": i % 2 == 0}) for i in range(20)]
    write_lines(str(tmp_path / "j"), lines)
    one, two = read_json_inferred(spark, str(tmp_path / "j")), read_json(spark, str(tmp_path / "j"))
    assert one.dtypes == two.dtypes and rows(one) == rows(two)


# ------------------------------------------------------------------ F2 rejects, exact counts
@pytest.mark.parametrize("run", [run_inline, run_separate])
def test_rejects_are_kept_by_reason_and_replayed(spark, tmp_path, run):
    src, store = str(tmp_path / "in"), str(tmp_path / "rejects")
    spec = spec_at(tmp_path / "t", database="extras", table=f"rejects_{run.__name__}")
    write_lines(src, LINES)
    summary = run(spark, src, SCHEMA, spec, rejects=store, exact_counts=True)
    assert summary.totals() == {"rows_in": 8, "rejected": 6, "superseded": 1, "duplicates": 1, "stale": 0, "inserted": 1, "updated": 0}
    assert summary.batches[0]["reasons"] == REASONS
    kept = {r._raw: r._reject_reason for r in read_rejects(spark, store).collect()}
    assert len(kept) == 6 and kept["{broken"] == "corrupt record" and kept[LINES[1]] == "corrupt record"
    # two of them can be corrected, the others stay with their reason of now
    fix = (lambda r: r.withColumn("_raw", F.when(F.col("_raw") == LINES[1], LINES[1].replace('"two"', "2"))
                                  .when(F.col("_raw").contains('"v":4'), '{"k": "c", "p": "y", "o": 9, "v": 4}').otherwise(F.col("_raw"))))
    assert replay(spark, store, fix, SCHEMA, spec).replayed == 2
    assert rows(spark.table(spec.qualified_name).select("k", "p", "o", "v")) == [("a", "x", 2, 6), ("b", "x", 1, 2), ("c", "y", 9, 4)]
    left = read_rejects(spark, store)
    assert left.count() == 4 and {r.batch for r in left.collect()} == {"0"} and "{broken" in {r._raw for r in left.collect()}
    assert replay(spark, store, lambda r: r, SCHEMA, spec).replayed == 0 and read_rejects(spark, store).count() == 4


def test_a_replayed_batch_adds_no_reject_twice(spark, tmp_path):
    store = str(tmp_path / "rejects")
    one = spark.createDataFrame([("r1", "a"), ("r2", "a")], "_raw string, _reject_reason string")
    for _ in range(2):
        store_rejects(one, store, "0")
    store_rejects(one.limit(1), store, "1")
    assert read_rejects(spark, store).count() == 3
    store_rejects(one.limit(0), store, "1")
    assert {r.batch for r in read_rejects(spark, store).collect()} == {"0"}
    assert read_rejects(spark, str(tmp_path / "none")).count() == 0


def test_a_batch_of_rejects_only(spark, tmp_path):
    spec = spec_at(tmp_path / "t")
    tag = lambda df: conform_tagged(df, SCHEMA, ["k", "o"])
    bad = spark.createDataFrame([(None, "x", 1, 1)], SCHEMA)
    for _ in range(2):  # creates the table, then meets it
        res = upsert_to_path(bad, spec, tagged=tag, exact_counts=True)
        assert (res.rows_in, res.rejected, res.inserted, res.duplicates) == (1, 1, 0, 0)


def test_counts_are_exact_when_a_stage_runs_again(spark, tmp_path, monkeypatch):
    """Every stage of the source and the batch runs twice: the counts stay those of the rows."""
    spec = spec_at(tmp_path / "t")
    data = spark.range(300).selectExpr("if(id % 10 = 0, null, cast(id % 100 as string)) k", "'x' p", "cast(id as int) o", "1 v").repartition(4)
    real = tables._incoming

    def twice(batch, *a, **kw):
        out = real(batch, *a, **kw)
        if kw.get("dedupe", True) and a[1] is not None:
            out.write.format("noop").mode("overwrite").save()  # as after a lost executor: observed rows pass again
        return out

    monkeypatch.setattr(tables, "_incoming", twice)
    tag = lambda df: conform_tagged(df, SCHEMA, ["k", "o"])
    res = upsert_to_path(data, spec, tagged=tag, exact_counts=True)
    assert (res.rows_in, res.rejected, res.duplicates, res.inserted) == (300, 30, 180, 90)


# ------------------------------------------------------------------ C5
@pytest.mark.parametrize("more", [{}, {"tie": ("v", "k"), "parallelism": 3, "broadcast_bytes": 0, "order_format": None, "max_pruned_partitions": 7},
                                  {"partition_expr": "concat(p, '\\'', 'x\\\\y')"}, {"partition": None}, {"versioned": True}])
def test_a_published_spec_reads_back(spark, tmp_path, more):
    table = f"t{abs(hash(str(more))) % 10**8}"
    spec = TableSpec(**{"path": str(tmp_path / "t"), "keys": ("k", "a,b"), "order": "o", "partition": "p", "database": "extras", "table": table} | more)
    schema = spark.createDataFrame([], "k string, `a,b` string, o int, v struct<x:int,y:array<string>>" + (", p string" if spec.partition else "")).schema
    publish(spark, spec, schema)
    assert read_spec(spark, spec.qualified_name) == (spec, spark.table(spec.qualified_name).schema)
    small = describe_dataset(spark, spec.qualified_name, threshold=20)
    assert described_spec(small, spec.qualified_name, spec.path)[0] == spec
    with pytest.raises(ValueError, match="published"):
        described_spec(small.where("name not like 'lakesync%'"), spec.qualified_name, spec.path)


# ------------------------------------------------------------------ V5, V6
def test_check_history(spark, tmp_path):
    path = str(tmp_path / "history")
    checks = "target string, check_name string, success boolean, message string, validation_type string"

    def run(n, data):
        record_checks(spark.createDataFrame([(t, c, ok, "", "x") for t, c, ok in data], checks), path, n)

    assert check_history(spark, path).count() == 0
    run(1, [("a", "1", True), ("a", "2", True), ("b", "1", False), ("c", "1", True), ("e", "1", False)])
    run(2, [("a", "1", True), ("a", "2", False), ("b", "1", True), ("d", "1", False), ("e", "1", False)])
    run(2, [("a", "1", True), ("a", "2", False), ("b", "1", True), ("d", "1", False), ("e", "1", False)])  # recorded again
    history = check_history(spark, path)
    assert history.count() == 10
    assert rows(run_changes(history, 1, 2)) == [("a", "newly failing", 0, 1), ("b", "newly passing", 1, 0), ("c", "disappeared", 0, None), ("d", "appeared", None, 1)]
    assert rows(run_changes(history, 1, 2, mode="any")) == [("b", "newly passing", 1, 0), ("c", "disappeared", 0, None), ("d", "appeared", None, 1)]
    assert {(r.target, r.check_name): r.run for r in latest_checks(history).collect()}[("c", "1")] == 1 and latest_checks(history).count() == 6
