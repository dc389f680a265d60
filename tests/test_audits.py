import os

from lakesync.operators import (
    audit_databases,
    audit_datasets,
    audit_paths,
    audit_tables,
    check_table,
    find_dataset,
    verdict,
)
from lakesync.sources import storage_listing


def test_audit_databases_and_tables(spark):
    exp_db = spark.createDataFrame([("a",), ("b",), ("",)], "database string")
    snap_db = spark.createDataFrame([("a",), ("a",), ("c",)], "database string")
    out = {r.target: (r.success, r.message) for r in audit_databases(exp_db, snap_db).collect()}
    assert out == {"a": (True, "database a is in the catalog"), "b": (False, "database b is missing from the catalog"),
                   "": (False, "no database given")}

    exp = spark.createDataFrame([("db", "T1"), ("db", "t2"), ("db", None)], "database string, table_name string")
    snap = spark.createDataFrame([("DB", "t1")], "database string, table_name string")
    res = {r.target: r.success for r in audit_tables(exp, snap).collect()}
    assert res == {"db.T1": True, "db.t2": False, "db": False}


def test_audit_paths(spark, tmp_path):
    full = tmp_path / "full"
    full.mkdir()
    (full / "f.parquet").write_bytes(b"x")
    empty = tmp_path / "empty"
    empty.mkdir()
    missing = tmp_path / "missing"
    roots = [str(full), str(empty), str(missing)]
    exp = spark.createDataFrame([(r,) for r in roots] + [("",)], "path string")
    out = {r.target: r.success for r in audit_paths(exp, storage_listing(spark, roots)).collect()}
    assert out == {str(full): True, str(empty): True, str(missing): False, "": False}
    assert not os.path.exists(missing)


def test_audit_datasets_and_find(spark):
    reg = spark.createDataFrame([("urn:li:dataset:(urn:li:dataPlatform:lake,db.t1,PROD)",),
                                 ("urn:li:dataset:(urn:li:dataPlatform:lake,db.t1,PROD)",),
                                 ("urn:li:dataset:(urn:li:dataPlatform:hive,db.t2,PROD)",)], "entity string")
    exp = spark.createDataFrame([("db", "t1"), ("db", "t2")], "database string, table_name string")
    out = {r.target: r.success for r in audit_datasets(exp, reg, platform="lake").collect()}
    assert out == {"db.t1": True, "db.t2": False}
    assert find_dataset(reg, "db", "t2", "hive").count() == 1
    assert find_dataset(reg, "db", "t2", "lake").count() == 0


def test_check_table_and_verdict(spark):
    a = spark.createDataFrame([("x", "c1", True, "m", "v"), ("y", "c1", True, "m", "v")],
                              "target string, check_name string, success boolean, message string, validation_type string")
    b = spark.createDataFrame([("x", "c2", False, "m", "v")],
                              "target string, check_name string, success boolean, message string, validation_type string")
    checks = check_table(a, b)
    assert checks.count() == 3
    targets = spark.createDataFrame([("x",), ("y",), ("z",)], "target string")
    all_ = {r.target: r.success for r in verdict(checks, "target", "all", targets=targets).collect()}
    any_ = {r.target: r.success for r in verdict(checks, "target", "any", targets=targets).collect()}
    assert all_ == {"x": False, "y": True, "z": False}  # no checks -> fails
    assert any_ == {"x": True, "y": True, "z": False}


def test_audit_paths_existence_only_lists_no_files(spark, tmp_path):
    full = tmp_path / "full"
    full.mkdir()
    (full / "f.parquet").write_bytes(b"x")
    roots = [str(full), str(tmp_path / "missing")]
    listing = storage_listing(spark, roots, list_files=False)
    assert listing.where("path IS NOT NULL").count() == 0
    exp = spark.createDataFrame([(r,) for r in roots], "path string")
    out = {r.target: (r.success, r.message) for r in audit_paths(exp, listing, count_files=False).collect()}
    assert out == {str(full): (True, f"path {full} is there"),
                   roots[1]: (False, f"path {roots[1]} is missing")}
