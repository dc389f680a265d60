"""A hot key: one user holds a third of all events.

Keep-latest trims each map task to one row per identity before the shuffle
(partial ``WindowGroupLimit``), and the broadcast merge never shuffles the
stored rows, so the hot key never reaches one task whole.  Results are
checked against DuckDB on the same derivation.
"""

import contextlib
import io

import duckdb
from pyspark.sql import functions as F

from lakesync.operators.merge import latest_per_key
from lakesync.plans.suite import STORED_SCHEMA, events_spec, restamped
from lakesync.sinks.table import plan_upsert, upsert_to_path
from lakesync.sources import read_table

from conftest import SF001

HOT = "CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END"


def _skewed(spark):
    return spark.read.parquet(f"{SF001}/events.parquet").withColumn("user_id", F.expr(HOT))


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue().split("\n\n\n")[0]


def _duck(sql):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW ev AS SELECT * REPLACE ({HOT} AS user_id) FROM read_parquet('{SF001}/events.parquet')")
    return con.sql(sql).fetchall()


def test_hot_key_latest_is_trimmed_before_the_shuffle(spark):
    ev = _skewed(spark).withColumn("event_date", F.to_date("ts"))
    assert ev.where("user_id = 0").count() * 3 >= ev.count() - 3
    out = latest_per_key(ev, ["user_id", "event_date"], "ts", ["event_id"])
    tree = _plan(out)
    below_exchange = tree[tree.index("Exchange"):]
    assert "WindowGroupLimit" in below_exchange  # partial top-1 on the map side
    got = sorted((r.event_id, r.user_id) for r in out.select("event_id", "user_id").collect())
    want = sorted(_duck("SELECT event_id, user_id FROM ev QUALIFY row_number() OVER "
                        "(PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1"))
    assert got == want


def test_hot_key_upsert_both_strategies(spark, tmp_path):
    ev = _skewed(spark)
    want = sorted(_duck(
        "WITH u AS (SELECT event_id, ts, user_id, 0 AS src FROM ev UNION ALL "
        "SELECT event_id + 1000000, ts + to_hours(CAST(event_id % 3 AS INTEGER) - 1), user_id, 1 FROM ev) "
        "SELECT user_id, CAST(ts AS DATE), event_id FROM u QUALIFY row_number() OVER "
        "(PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, src DESC, event_id DESC) = 1"))
    for strategy in ("broadcast", "shuffle"):
        spec = events_spec(str(tmp_path / strategy))
        upsert_to_path(ev, spec)
        if strategy == "broadcast":
            merged, res = plan_upsert(restamped(ev), spec, strategy="broadcast")
            tree = _plan(merged).splitlines()
            anti = next(i for i, ln in enumerate(tree) if "LeftAnti" in ln)
            # stream side of the anti-join = the stored rows: its whole subtree
            # (up to the build side at the same depth) holds no exchange
            col = tree[anti + 1].index(":-")
            stream = [tree[anti + 1]]
            for ln in tree[anti + 2:]:
                if len(ln) > col and ln[col:col + 2] == "+-":
                    break
                stream.append(ln)
            assert any("Scan parquet" in ln for ln in stream)
            assert not any("Exchange" in ln for ln in stream)
        r = upsert_to_path(restamped(ev), spec, strategy=strategy)
        assert r.strategy == strategy
        t = read_table(spark, spec.path, STORED_SCHEMA)
        got = sorted((r.user_id, r.event_date, r.event_id) for r in t.select("user_id", "event_date", "event_id").collect())
        assert got == want
