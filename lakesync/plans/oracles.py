"""DuckDB SQL oracles for :mod:`lakesync.plans.suite`, one per query name.

Column names and order match the Spark results.  Queries with the same
expected table (an upsert done in memory, through a path, or as a stream) share
one oracle.
"""

LATEST = ("SELECT event_id, user_id, CAST(ts AS DATE) AS event_date, ts, event_type, value FROM events "
          "QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1")

UPSERT = ("WITH u AS (SELECT event_id, ts, user_id, value, 0 AS src FROM events UNION ALL "
          "SELECT event_id + 1000000, ts + to_hours(CAST(event_id % 3 AS INTEGER) - 1), user_id, value * 2, 1 FROM events) "
          "SELECT user_id, CAST(ts AS DATE) AS event_date, event_id, ts, value FROM u "
          "QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, src DESC, event_id DESC) = 1")

TAG = ("WITH b AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS event_date FROM events), "
       "i AS (SELECT event_id + 1000000 AS event_id, user_id, CAST(ts + INTERVAL 3 DAY AS DATE) AS event_date FROM events) "
       "SELECT i.event_id, i.user_id, i.event_date, CASE WHEN b.user_id IS NULL THEN 'I' ELSE 'U' END AS op "
       "FROM i LEFT JOIN b ON i.user_id = b.user_id AND i.event_date = b.event_date")

EVENTS_STORED = ("SELECT event_id, ts, user_id, event_type, value, props, CAST(ts AS DATE) AS event_date FROM events")

TABLE_AUDIT = ("SELECT 'sales.cust_' || e.c_custkey AS target, 'database_table' AS check_name, "
               "s.c_custkey IS NOT NULL AS success, "
               "CASE WHEN s.c_custkey IS NOT NULL THEN 'table sales.cust_' || e.c_custkey || ' is listed under sales' "
               "ELSE 'table sales.cust_' || e.c_custkey || ' is not listed under sales' END AS message, "
               "'spark_catalog' AS validation_type "
               "FROM customer e LEFT JOIN (SELECT DISTINCT c_custkey FROM customer WHERE c_acctbal > 0) s "
               "ON e.c_custkey = s.c_custkey")

DATABASE_AUDIT = ("WITH snap AS (SELECT DISTINCT 'db_' || lower(n.n_name) AS db FROM supplier s "
                  "JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE s.s_acctbal > 0) "
                  "SELECT 'db_' || lower(n_name) AS target, 'database' AS check_name, snap.db IS NOT NULL AS success, "
                  "CASE WHEN snap.db IS NOT NULL THEN 'database db_' || lower(n_name) || ' is in the catalog' "
                  "ELSE 'database db_' || lower(n_name) || ' is missing from the catalog' END AS message, "
                  "'spark_catalog' AS validation_type FROM nation LEFT JOIN snap ON 'db_' || lower(n_name) = snap.db")

# the stored side keeps every event; the batch's best row of an identity replaces all of them unless one is newer
DIRTY = ("WITH s AS (SELECT user_id, CAST(ts AS DATE) AS event_date, event_id, ts, value FROM events), "
         "b AS (SELECT user_id, CAST(t AS DATE) AS event_date, event_id + 1000000 AS event_id, t AS ts, value * 2 AS value "
         "FROM (SELECT *, ts + to_hours(CAST(event_id % 3 AS INTEGER) - 1) AS t FROM events) "
         "QUALIFY row_number() OVER (PARTITION BY user_id, CAST(t AS DATE) ORDER BY t DESC, event_id DESC) = 1), "
         "m AS (SELECT user_id, event_date, max(ts) AS top FROM s GROUP BY ALL) "
         "SELECT b.* FROM b LEFT JOIN m USING (user_id, event_date) WHERE m.top IS NULL OR b.ts >= m.top UNION ALL "
         "SELECT s.* FROM s JOIN m USING (user_id, event_date) LEFT JOIN b USING (user_id, event_date) WHERE b.ts IS NULL OR b.ts < m.top")

# days by arrival: before and from the 16th
CONDITIONAL = ("WITH c AS (SELECT count(DISTINCT CAST(ts AS DATE)) FILTER (ts < '2024-01-16') AS a, "
               "count(DISTINCT CAST(ts AS DATE)) FILTER (ts >= '2024-01-16') AS b FROM events) "
               "SELECT 1::BIGINT AS run, a AS added, 0::BIGINT AS dropped FROM c UNION ALL SELECT 2, b, 0 FROM c "
               "UNION ALL SELECT 3, 0, 0 UNION ALL SELECT 4, 0, 1")

# each half of the re-stamped events meets the stored ones with its own origin
EVOLVING = ("WITH u AS (SELECT event_id, ts, user_id, value, 0 AS src, NULL AS origin FROM events UNION ALL "
            "SELECT event_id + 1000000, t, user_id, value * 2, 1, CASE WHEN t >= '2024-01-16' THEN 'second' ELSE 'third' END "
            "FROM (SELECT *, ts + to_hours(CAST(event_id % 3 AS INTEGER) - 1) AS t FROM events)) "
            "SELECT user_id, CAST(ts AS DATE) AS event_date, event_id, ts, value, origin FROM u "
            "QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, src DESC, event_id DESC) = 1")

# days by arrival; the catalog knows those of the first
JOURNAL = ("WITH a AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) "
           "SELECT n.number, n.kind, a.day AS event_date, a.day < '2024-01-11' AS known FROM a JOIN (VALUES "
           "(1::BIGINT, 'overwrite', DATE '2000-01-01', DATE '2024-01-11'), (2, 'merge', DATE '2024-01-09', DATE '2024-01-21'), "
           "(3, 'merge', DATE '2024-01-19', DATE '2100-01-01')) n(number, kind, lo, hi) ON a.day >= n.lo AND a.day < n.hi")

# arrivals with broken rows: views have a user that is no number, clicks none
_ARRIVALS = ("WITH e AS (SELECT 0 AS batch, event_id, ts, user_id, value, event_type FROM events UNION ALL "
             "SELECT 1, event_id + 1000000, ts + to_hours(CAST(event_id % 3 AS INTEGER) - 1), user_id, value * 2, event_type FROM events), "
             "g AS (SELECT *, CAST(ts AS DATE) AS event_date FROM e WHERE event_type NOT IN ('view', 'click')), "
             "m AS (SELECT batch, user_id, event_date, max(ts) AS top, count(*) AS n FROM g GROUP BY ALL), "
             "f AS (SELECT n.*, o.top AS old FROM m n LEFT JOIN m o ON n.batch = 1 AND o.batch = 0 AND o.user_id = n.user_id AND o.event_date = n.event_date) ")

SUMMARY = _ARRIVALS + ("SELECT f.batch::BIGINT AS batch, any_value(a.n) AS rows_in, any_value(a.r) AS rejected, CAST(sum(f.n) - count(*) AS BIGINT) AS duplicates, "
                       "count(*) FILTER (f.top < f.old) AS stale, count(*) FILTER (f.old IS NULL) AS inserted, count(*) FILTER (f.top >= f.old) AS updated "
                       "FROM f JOIN (SELECT batch, count(*) AS n, count(*) FILTER (event_type IN ('view', 'click')) AS r FROM e GROUP BY 1) a ON a.batch = f.batch GROUP BY 1")

REJECTS = _ARRIVALS + ("SELECT batch::VARCHAR AS batch, CASE event_type WHEN 'view' THEN 'corrupt record' ELSE 'null required field: user_id' END AS reason, count(*) AS n "
                       "FROM e WHERE event_type IN ('view', 'click') GROUP BY 1, 2")

# corrected views meet the stored rows as a batch of their own, after both arrivals
REPLAYED = _ARRIVALS + (", s AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY user_id, event_date ORDER BY ts DESC, batch DESC, event_id DESC) = 1 "
                        "UNION ALL SELECT 2, event_id, ts, user_id, value, event_type, CAST(ts AS DATE) FROM e WHERE event_type = 'view') "
                        "SELECT user_id, event_date, event_id, ts, value FROM s "
                        "QUALIFY row_number() OVER (PARTITION BY user_id, event_date ORDER BY ts DESC, batch = 2 DESC, event_id DESC) = 1")

# columns, then the properties that the spec becomes, then the schema's JSON in parts of 100 characters
_COLUMNS = ("WITH c AS (SELECT row_number() OVER () AS i, column_name AS col_name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' "
            "WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'INTEGER' THEN 'int' END AS data_type, 'column' AS kind FROM (DESCRIBE events) "
            "UNION ALL SELECT 1000, 'event_date', 'date', 'partition_column'), "
            "j AS (SELECT '{\"fields\":[' || string_agg('{\"metadata\":{},\"name\":\"' || col_name || '\",\"nullable\":true,\"type\":\"' || "
            "CASE data_type WHEN 'bigint' THEN 'long' WHEN 'int' THEN 'integer' ELSE data_type END || '\"}', ',' ORDER BY i) || '],\"type\":\"struct\"}' AS s FROM c) ")
DESCRIBED = _COLUMNS + (
    "SELECT col_name, data_type, kind FROM c UNION ALL "
    "SELECT 'schema.part.' || i, substr(s, 100 * i + 1, 100), 'schema_part' FROM (SELECT s, CAST(unnest(range(0, (length(s) + 99) // 100)) AS BIGINT) AS i FROM j) UNION ALL "
    "SELECT k, v, 'property' FROM (VALUES ('lakesync.record_key', 'user_id'), ('lakesync.ordering', 'ts'), ('lakesync.partition', 'event_date'), "
    "('lakesync.tie', 'event_id'), ('lakesync.spec', '{\"keys\": [\"user_id\"], \"tie\": [\"event_id\"], \"partition_expr\": \"CAST(ts AS DATE)\", \"parallelism\": null, "
    "\"max_pruned_partitions\": 10000, \"broadcast_bytes\": null, \"order_format\": \"yyyy-MM-dd HH:mm:ss\", \"versioned\": false, \"key_buckets\": null}')) p(k, v)")

REGISTRY_WHERE = "o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"

ORACLES: dict[str, str] = {
    "latest_per_key": LATEST,
    "upsert": UPSERT,
    "tag": TAG,
    "tag_stored": TAG,
    "tag_stored_broadcast": TAG,
    "upsert_to_path": UPSERT,
    "upsert_broadcast_merge": UPSERT,
    "upsert_shuffle_merge": UPSERT,
    "upsert_parallel": UPSERT,
    "upsert_dirty_table": DIRTY,
    "upsert_versioned": UPSERT,
    "upsert_evolving_schema": EVOLVING,
    "overwrite_table": LATEST,
    "commit_journal": JOURNAL,
    "conditional_sync": CONDITIONAL,
    "stream_upsert": UPSERT,
    "read_json": "SELECT event_id, ts, user_id, event_type, value, props FROM events",
    "read_json_inferred": ("SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'x' || o_custkey ELSE o_custkey::VARCHAR END AS o_custkey, "
                           "o_totalprice::DOUBLE AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders"),
    "ingest_rejects": REJECTS,
    "ingest_summary": SUMMARY,
    "ingest_replayed": REPLAYED,
    "verdict_changes": ("SELECT 'cust_' || c_custkey AS target, CASE WHEN c_acctbal > 0 THEN 'newly failing' ELSE 'newly passing' END AS change, "
                        "CASE WHEN c_acctbal > 0 THEN 0::BIGINT ELSE 1 END AS failed_before, CASE WHEN c_acctbal > 0 THEN 1::BIGINT ELSE 0 END AS failed_after "
                        "FROM customer WHERE (c_acctbal > 0) <> (c_acctbal BETWEEN -500 AND 5000)"),
    "record_key_and_path": ("SELECT event_id, CAST(user_id AS VARCHAR) AS record_key, "
                            "'event_date=' || strftime(ts, '%Y-%m-%d') AS partition_path FROM events"),
    "partition_value": ("SELECT DISTINCT strftime(ts, '%Y/%m/%d') AS slash_path, CAST(ts AS DATE) AS event_date "
                        "FROM events"),
    "parse_ts": "SELECT event_id, date_trunc('second', ts) AS ts FROM events",
    "conform_accepted": ("SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders "
                         "WHERE o_orderpriority <> '5-LOW'"),
    "conform_rejected": ("SELECT 'bad value: o_custkey' AS reason, count(*) AS n FROM orders "
                         "WHERE o_orderpriority = '5-LOW'"),
    "parse_urn": "SELECT o_orderkey, 'lake' AS platform, 'sales.cust_' || o_custkey AS dataset FROM orders",
    "find_dataset": ("SELECT o_orderkey, 'urn:li:dataset:(urn:li:dataPlatform:lake,sales.cust_' || o_custkey || ',PROD)' "
                     "AS entity FROM orders WHERE o_custkey = 7"),
    "partition_drift": ("WITH s AS (SELECT DISTINCT CAST(ts AS DATE) AS p FROM events), "
                        "c AS (SELECT DISTINCT CAST(ts - INTERVAL 5 DAY AS DATE) AS p FROM events) "
                        "SELECT COALESCE(s.p, c.p) AS part, CASE WHEN c.p IS NULL THEN 'ADD' ELSE 'DROP' END AS action "
                        "FROM s FULL JOIN c ON s.p = c.p WHERE s.p IS NULL OR c.p IS NULL"),
    "read_partitions": EVENTS_STORED,
    "read_partition_glob": EVENTS_STORED + " WHERE strftime(ts, '%Y-%m-%d') LIKE '2024-01-1%'",
    "manifest_rows": "SELECT CAST(ts AS DATE) AS event_date, count(*) AS row_count FROM events GROUP BY 1",
    "table_audit": TABLE_AUDIT,
    "database_audit": DATABASE_AUDIT,
    "dataset_audit": (f"WITH reg AS (SELECT DISTINCT o_custkey FROM orders WHERE {REGISTRY_WHERE}) "
                      "SELECT 'sales.cust_' || c.c_custkey AS target, 'registry_dataset' AS check_name, "
                      "reg.o_custkey IS NOT NULL AS success, "
                      "CASE WHEN reg.o_custkey IS NOT NULL THEN 'registry lists sales.cust_' || c.c_custkey "
                      "ELSE 'registry lacks sales.cust_' || c.c_custkey END AS message, "
                      "'registry_dataset' AS validation_type FROM customer c LEFT JOIN reg ON c.c_custkey = reg.o_custkey"),
    "path_audit": ("WITH s AS (SELECT DISTINCT CAST(ts AS DATE) AS p FROM events), "
                   "e AS (SELECT DISTINCT CAST(ts + INTERVAL 5 DAY AS DATE) AS p FROM events) "
                   "SELECT 'event_date=' || strftime(e.p, '%Y-%m-%d') AS target, 'table_path' AS check_name, "
                   "s.p IS NOT NULL AS success, 'table_path' AS validation_type FROM e LEFT JOIN s ON e.p = s.p"),
    "check_rows": f"SELECT * FROM ({TABLE_AUDIT}) UNION ALL SELECT * FROM ({DATABASE_AUDIT})",
    "verdict_all": ("SELECT c_nationkey, bool_and(c_acctbal > 0) AS success, count(*) AS n_checks, "
                    "count(*) FILTER (WHERE NOT (c_acctbal > 0)) AS n_failed FROM customer GROUP BY 1"),
    "verdict_any": ("SELECT c_nationkey, bool_or(c_acctbal > 0) AS success, count(*) AS n_checks, "
                    "count(*) FILTER (WHERE NOT (c_acctbal > 0)) AS n_failed FROM customer GROUP BY 1"),
    "publish_table": EVENTS_STORED,
    "catalog_audit": ("SELECT table_name, table_name IN (SELECT event_type FROM events) AS success FROM "
                      "(SELECT DISTINCT event_type AS table_name FROM events "
                      "UNION SELECT DISTINCT 'order_' || lower(o_orderstatus) FROM orders)"),
    "ingest_inline": LATEST,
    "ingest_separate": LATEST,
    "validate_tables": ("SELECT event_type AS table_name, true AS success, 3 AS n_checks, 0 AS n_failed "
                        "FROM (SELECT DISTINCT event_type FROM events) UNION ALL "
                        "SELECT DISTINCT 'order_' || lower(o_orderstatus), false, 3, 2 FROM orders"),
    "describe_columns": DESCRIBED,
    "synced_partitions": ("SELECT DISTINCT 'event_date=' || strftime(ts, '%Y-%m-%d') AS partition FROM events"),
    "ingest_batch": ("SELECT event_id, user_id, CAST(ts AS DATE) AS event_date, date_trunc('second', ts) AS ts, "
                     "event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) "
                     "ORDER BY date_trunc('second', ts) DESC, event_id DESC) = 1"),
}
