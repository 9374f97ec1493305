"""Derived views over the test tables. One SQL text each, read by Spark and by the oracle alike.

Table names stand in braces; Spark binds them to DataFrames, the oracle reads them as names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Declared, so that binding a table reads no footer and starts no job.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

NOW = 1789041600  # 2026-09-10T12:00:00Z
ANCHOR = (3, 4)
MARK = (8, 2504)

ORDERS_PLAIN = """
SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice, o_orderdate, o_orderpriority
FROM {orders}"""

LINEITEM_PLAIN = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS DECIMAL(18,2)) AS l_quantity,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS l_extendedprice, CAST(l_discount AS DECIMAL(18,2)) AS l_discount,
       CAST(l_tax AS DECIMAL(18,2)) AS l_tax, l_returnflag, l_linestatus, l_shipdate
FROM {lineitem}"""

ORDERS_COPY = """
SELECT o_orderkey, o_custkey,
       CASE WHEN o_orderkey % 1000 = 17 THEN CAST(NULL AS STRING) ELSE o_orderstatus END AS o_orderstatus,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) + CASE WHEN o_orderkey % 1000 = 11 THEN 0.01 ELSE 0.00 END AS DECIMAL(18,2)) AS o_totalprice,
       o_orderdate, o_orderpriority
FROM {orders} WHERE o_orderkey % 1000 <> 7
UNION ALL
SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)), o_orderdate, o_orderpriority
FROM {orders} WHERE o_orderkey % 1000 = 13"""

PAGES_COPY = """
SELECT page_id, CASE WHEN page_id = 3 THEN concat(url, 'x') ELSE url END AS url, html FROM {pages}"""

CONVERSATIONS_COPY = """
SELECT conv_id, turn, role, text FROM {conversations} WHERE NOT (conv_id = 0 AND turn = 0)
UNION ALL
SELECT conv_id, turn, role, text FROM {conversations} WHERE conv_id = 0 AND turn = 1"""

ARTEFACTS = """
SELECT id, db, CASE WHEN id % 200 = 9 THEN concat(db, '_manual-', CAST(id AS STRING), '.dump')
                    WHEN id % 50 = 1 THEN concat(db, '_', stamp, ext, '.part')
                    ELSE concat(db, '_', stamp, ext) END AS name,
       id % 10 <> 3 AS has_manifest,
       1000 + cust AS bytes, 1000 + cust - CASE WHEN id % 37 = 0 THEN 1 ELSE 0 END AS site_bytes,
       md5(concat(db, stamp, ext)) AS sha, md5(concat(db, stamp, ext, CASE WHEN id % 41 = 0 THEN 'rot' ELSE '' END)) AS site_sha,
       0 - id AS mtime_rank
FROM (SELECT o_orderkey AS id, o_custkey AS cust,
             CASE o_custkey % 3 WHEN 0 THEN 'app' WHEN 1 THEN 'app_prod' ELSE 'web' END AS db,
             CASE o_orderkey % 4 WHEN 0 THEN '.dump' WHEN 1 THEN '.sql' WHEN 2 THEN '.tar.gz' ELSE '.dump.age' END AS ext,
             concat('2026', lpad(CAST(CASE WHEN o_custkey % 3 = 2 THEN 1 ELSE 1 + o_orderkey % 8 END AS STRING), 2, '0'),
                    lpad(CAST(1 + o_orderkey % 28 AS STRING), 2, '0'), 'T',
                    lpad(CAST(o_orderkey % 24 AS STRING), 2, '0'), lpad(CAST(o_custkey % 60 AS STRING), 2, '0'),
                    lpad(CAST((o_orderkey * 7) % 60 AS STRING), 2, '0'), 'Z') AS stamp
      FROM {orders}) s"""

WAL_LISTING = """
SELECT printf('%08X%08X%08X', 1 + CAST(floor(o_orderkey / 5000) AS BIGINT), CAST(floor(o_orderkey / 256) AS BIGINT), o_orderkey % 256) AS name,
       CASE WHEN o_orderkey % 89 = 3 THEN 8388608 ELSE 16777216 END AS bytes
FROM {orders} WHERE o_orderkey % 97 <> 5"""

BINLOG_INVENTORY = """
SELECT 'binlog' AS series, doc_id + 1 AS idx, concat('binlog.', lpad(CAST(doc_id + 1 AS STRING), 6, '0')) AS name,
       n_chars AS bytes, md5(text) AS inventory_sha,
       CASE WHEN doc_id % 53 = 7 THEN CAST(NULL AS STRING) WHEN doc_id % 31 = 0 THEN md5(concat(text, 'rot')) ELSE md5(text) END AS site_sha
FROM {documents}"""

CHANGE_LOG = """
SELECT 1 + CAST(floor(event_id / 100) AS BIGINT) AS idx, 4 + (event_id % 100) * 100 AS pos, user_id AS k,
       CASE event_type WHEN 'error' THEN 'D' WHEN 'signup' THEN 'I' ELSE 'U' END AS op,
       CAST(value AS DECIMAL(18,2)) AS v, event_type AS gtid_uuid, event_id AS gtid_no
FROM {events}"""

COUNTERS = """
SELECT 'orders' AS tbl, max(o_orderkey) + 1 AS next_value FROM {orders}
UNION ALL SELECT 'customer', max(c_custkey) FROM {customer}
UNION ALL SELECT 'part', max(p_partkey) - 1 FROM {part}
UNION ALL SELECT 'supplier', CAST(NULL AS BIGINT)"""

KEYS = """
SELECT 'orders' AS tbl, o_orderkey AS id FROM {orders}
UNION ALL SELECT 'customer', c_custkey FROM {customer}
UNION ALL SELECT 'part', p_partkey FROM {part}
UNION ALL SELECT 'supplier', s_suppkey FROM {supplier}"""

OBJECTS = """
SELECT class, name, definition,
       class <> 'routines' AS in_copy,
       CASE WHEN class = 'indexes' AND id % 40 = 0 THEN concat(definition, ' DESC') ELSE definition END AS copy_definition
FROM (SELECT p_partkey AS id, concat('obj_', CAST(p_partkey AS STRING)) AS name, concat(p_type, ' on ', p_brand) AS definition,
             CASE p_partkey % 5 WHEN 0 THEN 'indexes' WHEN 1 THEN 'constraints' WHEN 2 THEN 'views' WHEN 3 THEN 'routines' ELSE 'triggers' END AS class
      FROM {part}) p"""

TXN_SETS = """
SELECT event_type AS uuid, event_id AS lo, event_id AS hi, event_id % 101 <> 0 AS applied
FROM {events}"""

RECOVERY_POINTS = """
SELECT CASE o_custkey % 3 WHEN 0 THEN 'app' WHEN 1 THEN 'app_prod' ELSE 'web' END AS db,
       CASE WHEN o_orderkey % 2 = 0 THEN 'base' ELSE 'mark' END AS kind,
       1 + o_custkey % 2 AS series, o_orderkey AS idx, 4 + o_custkey AS pos,
       concat('p_', lpad(CAST(o_orderkey AS STRING), 10, '0')) AS name
FROM {orders}"""

_TABLE = re.compile(r"\{([a-z]+)\}")  # letters only: regex counts such as {8} are left alone


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A fixture as a DataFrame; tables are bound by name, no global view is registered."""
    used = {name: load(spark, sf_dir, name) for name in set(_TABLE.findall(sql))}
    return spark.sql(sql, **used)


def oracle_text(sql: str) -> str:
    return _TABLE.sub(r"\1", sql)
