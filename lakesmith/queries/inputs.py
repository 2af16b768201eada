"""Operator inputs derived from the test tables.

Each input is one SELECT that Spark and the checking database both understand,
so that the two sides start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

INPUTS = {
    # Orders with a key that is missing for one priority.
    "keyed_orders": """
        SELECT CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderkey END AS k,
               o_custkey, o_orderstatus, o_totalprice, o_orderdate
        FROM {orders}""",
    # The next load: all orders again, keys moved on, prices changed.
    "order_batch": """
        SELECT k + 500 AS k, o_custkey, o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderdate
        FROM {keyed_orders}""",
    "customer_batch": """
        SELECT c_custkey + 100 AS c_custkey, c_name, c_nationkey, c_acctbal + 1 AS c_acctbal,
               CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'BUILDING' ELSE c_mktsegment END AS c_mktsegment
        FROM {customer}""",
    # Objects of three buckets: table logs and data, tables per run, temporary and loose files.
    "objects": """
        SELECT CASE l_returnflag WHEN 'A' THEN 'bronze' WHEN 'N' THEN 'prata' ELSE 'ouro' END AS bucket,
               CASE
                 WHEN l_linenumber = 1 THEN 'loads/tb_' || (l_suppkey % 20) || '/_delta_log/'
                      || lpad('' || l_orderkey, 20, '0') || '.json'
                 WHEN l_linenumber <= 4 THEN 'loads/tb_' || (l_suppkey % 30) || '/year='
                      || extract(year FROM l_shipdate) || '/f' || l_orderkey || '-' || l_partkey || '.parquet'
                 WHEN l_linenumber = 5 THEN 'loads/_TMP/o' || l_orderkey || '.parquet'
                 WHEN l_linenumber = 6 AND l_quantity < 25 THEN 'inv/_meta/ci/system=S' || (l_suppkey % 3)
                      || '/run_id=r' || (l_suppkey % 7) || '/_delta_log/' || l_orderkey || '.json'
                 WHEN l_linenumber = 6 THEN 'inv/_meta/ci/system=S' || (l_suppkey % 3)
                      || '/run_id=r' || (l_suppkey % 7) || '/f' || l_orderkey || '.parquet'
                 ELSE 'dump/d' || (l_partkey % 50) || '/x' || l_orderkey || '.csv'
               END AS key,
               CAST(l_quantity AS BIGINT) * 1000 + l_linenumber AS size,
               l_shipdate AS last_modified
        FROM {lineitem}""",
    # Buckets and folders below them, within each other, also inside tables and their logs.
    "usage_targets": """
        SELECT bucket, '' AS prefix FROM {objects}
        UNION SELECT bucket, split_part(key, '/', 1) FROM {objects}
        UNION SELECT bucket, split_part(key, '/', 1) || '/' || split_part(key, '/', 2) FROM {objects}
        UNION SELECT bucket, split_part(key, '/', 1) || '/' || split_part(key, '/', 2) || '/' || split_part(key, '/', 3)
        FROM {objects} WHERE key LIKE 'inv/%' OR key LIKE 'loads/tb_1%'
        UNION SELECT 'bronze', 'nothing/here' FROM {region}""",
    # Log actions of one table per supplier; a commit is an order and names a file once per kind.
    "file_actions": """
        SELECT 's3a://bronze/tb_' || l_suppkey AS tbl, l_orderkey AS version,
               CASE WHEN l_returnflag = 'R' THEN 'remove' ELSE 'add' END AS kind,
               'f' || (l_partkey % 500) || '.parquet' AS path,
               max(CAST(l_quantity AS BIGINT)) AS size, max(l_shipdate) AS ts
        FROM {lineitem} GROUP BY 1, 2, 3, 4""",
    "commit_actions": """
        SELECT DISTINCT tbl, version, 'commit' AS kind,
               CASE WHEN 1 = 0 THEN path END AS path, CASE WHEN 1 = 0 THEN size END AS size,
               CASE WHEN 1 = 0 THEN ts END AS ts
        FROM {file_actions}""",
    # Stored files of the same tables, referenced or not.
    "stored_files": """
        SELECT 's3a://bronze/tb_' || l_suppkey AS tbl, 'f' || (l_partkey % 700) || '.parquet' AS path,
               max(CAST(l_quantity AS BIGINT)) AS size, max(l_shipdate) AS ts
        FROM {lineitem} GROUP BY 1, 2""",
    # Commit and checkpoint files of one log per customer.
    "log_files": """
        SELECT 's3a://bronze/c_' || o_custkey AS tbl, o_orderkey AS version,
               CASE WHEN o_orderstatus = 'P' THEN 'checkpoint' ELSE 'commit' END AS kind, o_orderdate AS ts
        FROM {orders}""",
    # Closed runs of one table per user.
    "run_log": """
        SELECT event_id AS id, 'p' || (user_id % 5) AS project, 'tb_' || user_id AS table_name,
               CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
               CASE WHEN event_type = 'view' THEN NULL ELSE ts - INTERVAL '1' HOUR END AS watermark_to,
               ts + INTERVAL '1' MINUTE * (event_id % 90) AS finished_at
        FROM {events}""",
    # Configured tables: those of the log, and one per customer that never ran.
    "table_config": """
        SELECT DISTINCT 'p' || (user_id % 5) AS project, 'tb_' || user_id AS table_name,
               user_id % 7 <> 3 AS enabled,
               CASE WHEN user_id % 11 = 0 THEN '  ' ELSE 's3a://bronze/tb_' || user_id END AS delta_bronze_path
        FROM {events}
        UNION ALL
        SELECT 'p9', 'new_' || c_custkey, c_nationkey <> 4, NULL FROM {customer}""",
    "run_records": """
        SELECT 'dag_' || (user_id % 50) AS dag_id, 'run_' || event_id AS run_id,
               CASE event_type WHEN 'click' THEN 'scheduled' WHEN 'view' THEN ' Manual'
                    WHEN 'purchase' THEN 'backfill' WHEN 'signup' THEN '' ELSE 'custom' END AS run_type,
               CASE WHEN event_id % 3 = 0 THEN 'UI' WHEN event_id % 3 = 1 THEN 'timetable' ELSE NULL END
                    AS triggered_by,
               CASE WHEN value < 30 THEN 'failed' ELSE 'success' END AS state,
               ts AS start_date, ts + INTERVAL '5' MINUTE AS end_date
        FROM {events}""",
    # Metrics by nation (as buckets) and by supplier (as tables).
    "bucket_metrics": """
        SELECT 'n' || c_nationkey AS bucket, CASE WHEN c_nationkey % 2 = 0 THEN '' ELSE 'raw' END AS prefix,
               CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS total_bytes,
               count(*) AS object_count,
               CASE WHEN c_nationkey % 5 = 0 THEN NULL
                    ELSE CAST(count(*) AS DOUBLE) / (c_nationkey + 1) END AS growth_pct,
               CAST(sum(CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey ELSE 0 END) AS BIGINT) AS loose_bytes,
               CAST(sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END) AS DOUBLE) * 100.0 / count(*)
                    AS loose_pct,
               CAST(sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END) AS BIGINT) AS loose_objects,
               CAST(c_nationkey % 3 AS BIGINT) AS ephemeral_tables,
               CAST(max(c_custkey) AS BIGINT) AS ephemeral_bytes,
               CAST(c_nationkey % 4 AS BIGINT) AS temp_objects,
               CAST(min(c_custkey) AS BIGINT) AS temp_bytes
        FROM {customer} GROUP BY c_nationkey""",
    "table_metrics": """
        SELECT 's3a://bronze/tb_' || l_suppkey AS path, l_suppkey % 10 <> 7 AS is_delta,
               count(*) AS num_files, count(DISTINCT l_orderkey) AS history_len,
               CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS size_bytes,
               CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) AS avg_file_bytes,
               CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE CAST(l_suppkey AS DOUBLE) * 0.75 END AS growth_pct
        FROM {lineitem} GROUP BY l_suppkey""",
}

_NAME = re.compile(r"\{(\w+)\}")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table or a derived input as a frame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = {n: load(spark, sf_dir, n) for n in _NAME.findall(INPUTS[name])}
    return spark.sql(INPUTS[name], **used)


def sql(query: str) -> str:
    """A checking query with the inputs it names in braces as common table expressions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in INPUTS and name not in needed:
                visit(INPUTS[name])
                needed.append(name)

    visit(query)
    plain = lambda text: _NAME.sub(r"\1", text)
    parts = [f"{n} AS ({plain(INPUTS[n])})" for n in needed]
    body = plain(query).strip()
    if not parts:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {', '.join(parts)}, {body[5:]}"
    return f"WITH {', '.join(parts)} {body}"
