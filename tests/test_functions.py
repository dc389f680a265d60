import datetime as dt

import pytest

from lakesync.functions import conform, parse_ts, parse_urn, partition_path, partition_value, record_key


def test_parse_ts_strict_and_lenient(spark):
    df = spark.createDataFrame([("2018-08-31 10:30:00",), ("bad",)], "s string")
    lenient = [r.t for r in df.select(parse_ts("s", strict=False).alias("t")).collect()]
    assert lenient == [dt.datetime(2018, 8, 31, 10, 30), None]
    with pytest.raises(Exception):
        df.select(parse_ts("s", strict=True)).collect()
    assert dict(df.select(parse_ts("s", strict=False).alias("t")).dtypes)["t"] == "timestamp_ntz"


def test_partition_value_forms(spark):
    df = spark.createDataFrame([("2018/08/31",), ("date=2018/08/31",), ("2018-08-31",), ("nope",), (None,)], "s string")
    out = [r.d for r in df.select(partition_value("s").alias("d")).collect()]
    assert out == [dt.date(2018, 8, 31)] * 3 + [None, None]


def test_partition_path_and_record_key(spark):
    df = spark.createDataFrame([(7, dt.date(2018, 8, 31), "x")], "a bigint, d date, b string")
    r = df.select(partition_path("d", "date").alias("p"), partition_path("d", "date", hive_style=False).alias("q"),
                  record_key("a").alias("k1"), record_key("a", "b").alias("k2")).first()
    assert (r.p, r.q, r.k1, r.k2) == ("date=2018-08-31", "2018-08-31", "7", "a:7,b:x")


def test_parse_urn(spark):
    df = spark.createDataFrame([("urn:li:dataset:(urn:li:dataPlatform:lake,db.t1,PROD)",), ("garbage",)], "e string")
    out = [(r.u.platform, r.u.dataset) for r in df.select(parse_urn("e").alias("u")).collect()]
    assert out == [("lake", "db.t1"), ("garbage", None)]


def test_conform_splits_bad_rows(spark):
    raw = spark.createDataFrame([("1", "10", "x"), ("x", "11", "y"), (None, "12", "z"), ("3", None, "w")],
                                "a string, b string, c string")
    good, rejected = conform(raw, "a bigint, b int", required=["a"])
    assert good.columns == ["a", "b"]
    assert sorted(tuple(r) for r in good.collect()) == [(1, 10), (3, None)]
    reasons = sorted(r._reject_reason for r in rejected.collect())
    assert reasons == ["bad value: a", "null required field: a"]


def test_conform_missing_column_is_an_error(spark):
    raw = spark.createDataFrame([("1",)], "a string")
    with pytest.raises(ValueError):
        conform(raw, "a bigint, b int")

