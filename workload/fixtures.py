"""Two-sided inputs derived from the given tables by SQL both engines run unchanged.

Every row of every table is kept: drift between the sides is put into values and keys (some
moved out of the other side's range, some onto a neighbour, some to NULL), never by leaving
rows out. ``pos`` numbers the rows uniquely and gives them their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("nation", "region", "customer", "part", "orders", "lineitem", "events", "documents")

# The expansion mapping: three mapped segments, two left to the fallback.
SEGMENT_ROWS = (
    ("AUTOMOBILE", "AUTO", "A1"),
    ("AUTOMOBILE", "AUTO", "A2"),
    ("BUILDING", "BLD", "B1"),
    ("FURNITURE", "FRN", "F1"),
    ("FURNITURE", "FRN", "F2"),
)
SEGMENT_MAP = "SELECT * FROM (VALUES " + ", ".join(map(str, SEGMENT_ROWS)) + (
    ") AS t(left_val, rc_0, rc_1)"
)

ORDERS_LEFT = """
SELECT o_orderkey AS pos,
       CASE WHEN o_orderkey % 499 = 0 THEN NULL
            WHEN o_orderkey % 17 = 3 THEN -o_orderkey
            WHEN o_orderkey % 97 = 5 THEN o_orderkey + 1
            ELSE o_orderkey END AS o_orderkey,
       o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM orders"""

ORDERS_RIGHT = """
SELECT o_orderkey AS pos,
       CASE WHEN o_orderkey % 499 = 0 THEN NULL
            WHEN o_orderkey % 19 = 4 THEN o_orderkey + 1000000000
            WHEN o_orderkey % 101 = 7 THEN o_orderkey + 1
            ELSE o_orderkey END AS order_id,
       o_custkey AS customer_id,
       CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS status,
       CASE WHEN o_orderkey % 13 = 0 THEN 0.5 ELSE o_totalprice END AS total_price,
       o_orderdate AS order_date,
       CASE WHEN o_orderkey % 23 = 0 THEN NULL
            WHEN o_orderkey % 29 = 0 THEN ''
            WHEN o_orderkey % 7 = 0 THEN lower(o_orderpriority)
            WHEN o_orderkey % 5 = 0 THEN '  ' || o_orderpriority || ' '
            ELSE o_orderpriority END AS priority
FROM orders"""

LINE_LEFT = """
SELECT CASE WHEN (l_partkey + l_suppkey) % 31 = 0 THEN -1 - l_orderkey
            ELSE l_orderkey END AS l_orderkey,
       l_linenumber, l_quantity, l_returnflag, l_linestatus
FROM lineitem"""

LINE_RIGHT = """
SELECT CASE WHEN (l_partkey + l_suppkey) % 29 = 0 THEN l_orderkey + 1000000000
            ELSE l_orderkey END AS l_orderkey,
       l_linenumber, l_quantity,
       CASE WHEN l_partkey % 37 = 0 THEN 'Z' ELSE l_returnflag END AS l_returnflag,
       l_linestatus
FROM lineitem"""

CUST_LEFT = """
SELECT c_custkey AS pos,
       CASE WHEN c_custkey % 41 = 1 THEN -c_custkey ELSE c_custkey END AS c_custkey,
       c_name,
       CASE WHEN c_custkey % 53 = 9 THEN NULL ELSE c_mktsegment END AS c_mktsegment
FROM customer"""

CUST_RIGHT = """
SELECT c_custkey * 2 AS pos,
       CASE WHEN c_custkey % 43 = 2 THEN c_custkey + 1000000000 ELSE c_custkey END AS cust_id,
       CASE WHEN c_custkey % 7 = 3 THEN lower(c_name) ELSE c_name END AS cust_name,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'AUTO' WHEN 'BUILDING' THEN 'BLD'
                         WHEN 'FURNITURE' THEN 'FRN' ELSE c_mktsegment END AS seg,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'A1' WHEN 'BUILDING' THEN 'B1'
                         WHEN 'FURNITURE' THEN 'F1' ELSE NULL END AS sub
FROM customer
UNION ALL
SELECT c_custkey * 2 + 1,
       CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE c_custkey + 2000000000 END,
       c_name,
       CASE WHEN c_custkey % 3 = 0 THEN 'FRN' ELSE 'AUTO' END,
       CASE WHEN c_custkey % 3 = 0 THEN 'F2' ELSE 'A2' END
FROM customer"""

EVENTS_LEFT = "SELECT event_id, user_id, event_type FROM events"

EVENTS_RIGHT = """
SELECT event_id, user_id,
       CASE WHEN event_id % 50 = 0 THEN 'other' ELSE event_type END AS event_type
FROM events
UNION ALL
SELECT 1000000000 + n_nationkey, CAST(n_regionkey AS BIGINT), n_name FROM nation"""

# Written the way dates and numbers reach a text source: several spellings of each.
DATE_TEXTS = """
SELECT o_orderkey,
       CASE o_orderkey % 9
         WHEN 0 THEN substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10)
         WHEN 1 THEN replace(substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10), '-', '/')
         WHEN 2 THEN CAST(o_orderdate AS VARCHAR(30))
         WHEN 3 THEN '  ' || substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10) || ' '
         WHEN 4 THEN substr(CAST(o_orderdate AS VARCHAR(30)), 1, 4)
         WHEN 5 THEN replace(substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10), '-', '')
         WHEN 6 THEN substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10) || ' 25:00'
         WHEN 7 THEN substr(CAST(o_orderdate AS VARCHAR(30)), 3, 8)
         ELSE o_orderpriority END AS s
FROM orders"""

NUMBER_TEXTS = """
SELECT o_orderkey,
       CASE o_orderkey % 9
         WHEN 0 THEN CAST(o_totalprice AS VARCHAR(30))
         WHEN 1 THEN '+' || CAST(o_totalprice AS VARCHAR(30))
         WHEN 2 THEN CAST(o_totalprice AS VARCHAR(30)) || '5'
         WHEN 3 THEN '  ' || CAST(o_custkey AS VARCHAR(30)) || ' '
         WHEN 4 THEN CAST(o_custkey AS VARCHAR(30)) || 'd'
         WHEN 5 THEN CAST(o_custkey AS VARCHAR(30)) || '_000'
         WHEN 6 THEN '-0.' || CAST(o_custkey AS VARCHAR(30))
         WHEN 7 THEN CAST(o_custkey AS VARCHAR(30)) || 'e3'
         ELSE o_orderpriority END AS s
FROM orders"""

# One past run per user of the event stream.
RUNS = """
SELECT 'r' || CAST(10000000 + user_id AS VARCHAR(20)) AS id,
       'Run of user ' || CAST(user_id AS VARCHAR(20)) AS name,
       'file_vs_file' AS job_type,
       CASE WHEN user_id % 5 = 0 THEN 'failed' ELSE 'completed' END AS status,
       CASE WHEN user_id % 5 = 0 THEN NULL ELSE
         '{"total_rows": ' || CAST(count(*) AS VARCHAR(20)) ||
         ', "match": ' || CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS VARCHAR(20)) ||
         ', "mismatch": ' || CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS VARCHAR(20)) ||
         ', "missing_left": ' || CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS VARCHAR(20)) ||
         ', "missing_right": 0}' END AS result_summary,
       min(ts) AS created_at, max(ts) AS updated_at
FROM events GROUP BY user_id"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run fixture SQL over the tables of one directory, bound by name to that directory."""
    text = sql
    for name in TABLES:
        for word in ("FROM", "JOIN"):
            text = text.replace(f"{word} {name}", f"{word} parquet.`{sf_dir}/{name}.parquet`")
    return spark.sql(text)
