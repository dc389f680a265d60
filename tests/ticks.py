"""The stock_ticks fixture: schema and JSON-lines helpers."""

from __future__ import annotations

import json
import os

from pyspark.sql import types as T

from lakesync.functions.columns import partition_value
from lakesync.spec import TableSpec

TICKS_DDL = ("volume BIGINT, ts STRING, symbol STRING, year INT, month STRING, high DOUBLE, "
             "low DOUBLE, `key` STRING, `date` STRING, close DOUBLE, open DOUBLE, day STRING")
TICKS_SCHEMA = T.StructType([
    T.StructField("volume", T.LongType()), T.StructField("ts", T.StringType()),
    T.StructField("symbol", T.StringType()), T.StructField("year", T.IntegerType()),
    T.StructField("month", T.StringType()), T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()), T.StructField("key", T.StringType()),
    T.StructField("date", T.StringType()), T.StructField("close", T.DoubleType()),
    T.StructField("open", T.DoubleType()), T.StructField("day", T.StringType()),
])


def tick(symbol="A", date="2018/08/31", ts="2018-08-31 09:30:00", volume=100, **kw):
    y, m, d = date.split("/")
    row = {"volume": volume, "ts": ts, "symbol": symbol, "year": int(y), "month": m, "high": 10.5,
           "low": 9.5, "key": f"{symbol}_{date}", "date": date, "close": 10.0, "open": 10.1, "day": d}
    row.update(kw)
    return {k: v for k, v in row.items() if v is not _DROP}


_DROP = object()
DROP = _DROP


def write_lines(path: str, rows: list[dict], name: str = "part-0.json") -> str:
    os.makedirs(path, exist_ok=True)
    f = os.path.join(path, name)
    with open(f, "w") as fh:
        for r in rows:
            fh.write((r if isinstance(r, str) else json.dumps(r)) + "\n")
    return f


def ticks_spec(path: str, **kw) -> TableSpec:
    return TableSpec(path=path, keys=("symbol",), order="ts", partition="date",
                     partition_expr=lambda: partition_value("date"), **kw)
