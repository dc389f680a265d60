import json

from pyspark.sql import functions as F

from lakesync.catalog import catalog_partitions, describe_dataset, publish, sync_partitions
from lakesync.operators import needs_sync, partition_drift
from lakesync.plans.suite import STORED_SCHEMA, events, events_spec
from lakesync.sinks import write_table
from lakesync.sources import catalog_snapshot, storage_partitions

from conftest import SF0001


def _written(spark, path, where=None):
    ev = events(spark, SF0001).withColumn("event_date", F.to_date("ts"))
    if where is not None:
        ev = ev.where(where)
    write_table(ev, path, "event_date", mode="append")
    return ev


def test_publish_drift_sync_no_drift(spark, tmp_path):
    path = str(tmp_path / "t")
    ev = _written(spark, path, F.col("ts") < "2024-01-15")
    spec = events_spec(path, database="cat_t1", table="events")
    schema = spark.read.schema(STORED_SCHEMA).parquet(path).schema
    assert publish(spark, spec, schema)["created"]
    assert spark.table(spec.qualified_name).count() == 0  # partitions not registered yet

    def drift():
        return partition_drift(storage_partitions(spark, path, "event_date"),
                               catalog_partitions(spark, spec.qualified_name, "event_date"), "event_date")

    assert {r.action for r in drift().collect()} == {"ADD"}
    assert sync_partitions(spark, spec)["ADD"] == 14
    assert not needs_sync(drift())
    assert spark.table(spec.qualified_name).count() == ev.count()

    # new partitions on storage, and a catalog partition without storage
    _written(spark, path, F.col("ts") >= "2024-01-15")
    spark.sql(f"ALTER TABLE {spec.qualified_name} ADD PARTITION (event_date='2031-01-01') "
              f"LOCATION '{tmp_path}/nowhere'")
    acts = {r.action for r in drift().collect()}
    assert acts == {"ADD", "DROP"}
    res = sync_partitions(spark, spec)
    assert res == {"ADD": 16, "DROP": 1}
    assert not needs_sync(drift())
    assert spark.table(spec.qualified_name).count() == events(spark, SF0001).count()
    # conditional sync: no drift, nothing to do
    assert sync_partitions(spark, spec) == {"ADD": 0, "DROP": 0}


def test_schema_growth_adds_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    _written(spark, path)
    spec = events_spec(path, database="cat_t2", table="events")
    schema = spark.read.schema(STORED_SCHEMA).parquet(path).schema
    publish(spark, spec, schema)
    grown = schema.add("extra", "string")
    assert publish(spark, spec, grown)["added_columns"] == ["extra"]
    assert "extra" in spark.table(spec.qualified_name).columns


def test_describe_dataset_chunks_schema(spark, tmp_path):
    path = str(tmp_path / "t")
    _written(spark, path)
    spec = events_spec(path, database="cat_t3", table="events")
    publish(spark, spec, spark.read.schema(STORED_SCHEMA).parquet(path).schema)
    d = describe_dataset(spark, spec.qualified_name, threshold=50)
    kinds = {r.kind for r in d.collect()}
    assert kinds == {"column", "partition_column", "property", "schema_part"}
    parts = d.where("kind = 'schema_part'").orderBy("position").collect()
    assert len(parts) > 1
    assert json.loads("".join(p.value for p in parts))["type"] == "struct"
    props = {r.name: r.value for r in d.where("kind = 'property'").collect()}
    assert props["lakesync.record_key"] == "user_id" and props["lakesync.ordering"] == "ts"
    assert [r.name for r in d.where("kind = 'partition_column'").collect()] == ["event_date"]


def test_catalog_snapshot(spark, tmp_path):
    path = str(tmp_path / "t")
    _written(spark, path)
    spec = events_spec(path, database="cat_t4", table="events")
    publish(spark, spec, spark.read.schema(STORED_SCHEMA).parquet(path).schema)
    snap = catalog_snapshot(spark, ["cat_t4", "no_such_db"]).collect()
    assert [(r.database, r.table_name) for r in snap] == [("cat_t4", "events")]


def test_incremental_sync_per_value_and_listed_agree(spark, tmp_path, monkeypatch):
    import datetime as dt
    import importlib

    pub = importlib.import_module("lakesync.catalog.publish")

    results = {}
    for mode, limit in (("per_value", 64), ("listed", 0)):
        monkeypatch.setattr(pub, "PER_VALUE_LOOKUPS", limit)
        path = str(tmp_path / mode)
        _written(spark, path, F.col("ts") < "2024-01-10")
        spec = events_spec(path, database="cat_inc", table=f"events_{mode}")
        publish(spark, spec, spark.read.schema(STORED_SCHEMA).parquet(path).schema)
        sync_partitions(spark, spec)
        _written(spark, path, (F.col("ts") >= "2024-01-08") & (F.col("ts") < "2024-01-12"))
        touched = [dt.date(2024, 1, d) for d in (8, 9, 10, 11)]
        counts = sync_partitions(spark, spec, touched=touched)
        parts = sorted(r.partition for r in spark.sql(f"SHOW PARTITIONS {spec.qualified_name}").collect())
        results[mode] = (counts, parts, spark.table(spec.qualified_name).count())
    assert results["per_value"] == results["listed"]
    assert results["per_value"][0] == {"ADD": 2, "DROP": 0} and len(results["per_value"][1]) == 11
