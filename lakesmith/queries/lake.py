"""Inventory, table logs, alerts and maintenance."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.dates import ntz_literal
from ..operators import commitlog, health, inventory, maintain, targets
from ..plans import health as plan
from ..sinks.files import materialize
from .inputs import load, sql

_NOW = dt.datetime(2001, 1, 1)


def table_roots(spark, sf):
    """Tables found in the inventory."""
    return inventory.table_roots(load(spark, sf, "objects"))


def _written_roots(objects):
    return materialize(inventory.table_roots(objects), "roots")


_ROOTS = """
    SELECT DISTINCT bucket, regexp_extract(key, '^(.*?)/_delta_log', 1) AS root,
           contains(key, 'run_id=') AS ephemeral
    FROM {objects} WHERE contains(key, '/_delta_log')"""
TABLE_ROOTS = f"SELECT bucket, 's3a://' || bucket || '/' || root AS uri, root, ephemeral FROM ({_ROOTS})"

_FLAGGED = f"""
    WITH r AS ({_ROOTS})
    SELECT o.bucket, o.key, o.size,
           EXISTS (SELECT 1 FROM r WHERE r.bucket = o.bucket AND starts_with(o.key, r.root || '/')) AS under_table,
           EXISTS (SELECT 1 FROM r WHERE r.bucket = o.bucket AND r.ephemeral AND starts_with(o.key, r.root || '/'))
             AS under_ephemeral,
           key LIKE '%/_TMP/%' AS temp
    FROM {{objects}} o"""


def object_classes(spark, sf):
    """Objects below tables, below tables per run, temporary."""
    objects = load(spark, sf, "objects")
    return inventory.classify_objects(objects, _written_roots(objects)).select(
        "bucket", "key", "size", "under_table", "under_ephemeral", "temp"
    )


def bucket_usage(spark, sf):
    """A7."""
    objects = load(spark, sf, "objects")
    return inventory.bucket_usage(objects, _written_roots(objects))


BUCKET_USAGE = f"""
    WITH f AS ({_FLAGGED}),
    u AS (SELECT bucket, count(*) AS object_count, sum(size) AS total_bytes,
                 coalesce(sum(size) FILTER (WHERE under_table), 0) AS delta_bytes,
                 coalesce(sum(size) FILTER (WHERE NOT under_table), 0) AS loose_bytes,
                 count(*) FILTER (WHERE NOT under_table) AS loose_objects,
                 coalesce(sum(size) FILTER (WHERE under_ephemeral), 0) AS ephemeral_bytes,
                 coalesce(sum(size) FILTER (WHERE temp), 0) AS temp_bytes,
                 count(*) FILTER (WHERE temp) AS temp_objects
          FROM f GROUP BY 1),
    t AS (SELECT bucket, count(*) AS delta_tables, count(*) FILTER (WHERE ephemeral) AS ephemeral_tables
          FROM ({_ROOTS}) GROUP BY 1)
    SELECT u.bucket, object_count, CAST(total_bytes AS BIGINT) AS total_bytes, CAST(delta_bytes AS BIGINT) AS delta_bytes,
           CAST(loose_bytes AS BIGINT) AS loose_bytes, loose_objects, CAST(ephemeral_bytes AS BIGINT) AS ephemeral_bytes,
           CAST(temp_bytes AS BIGINT) AS temp_bytes, temp_objects,
           CAST(loose_bytes AS DOUBLE) / CAST(total_bytes AS DOUBLE) * 100.0 AS loose_pct, delta_tables, ephemeral_tables
    FROM u JOIN t ON u.bucket = t.bucket"""


def prefix_usage(spark, sf):
    """A7 with prefixes: usage of buckets and of folders below them, an object counting for each that holds it."""
    return inventory.prefix_usage(load(spark, sf, "objects"), load(spark, sf, "usage_targets"))


PREFIX_USAGE = """
    WITH h AS (SELECT t.bucket, t.prefix, o.key, o.size FROM {objects} o JOIN {usage_targets} t
               ON o.bucket = t.bucket AND (t.prefix = '' OR starts_with(o.key, t.prefix || '/'))),
    r AS (SELECT DISTINCT bucket, prefix, regexp_extract(key, '^(.*?)/_delta_log', 1) AS root,
                 contains(key, 'run_id=') AS ephemeral
          FROM h WHERE contains(key, '/_delta_log')),
    f AS (SELECT h.*, key LIKE '%/_TMP/%' AS temp,
                 EXISTS (SELECT 1 FROM r WHERE r.bucket = h.bucket AND r.prefix = h.prefix
                           AND starts_with(h.key, r.root || '/')) AS under_table,
                 EXISTS (SELECT 1 FROM r WHERE r.bucket = h.bucket AND r.prefix = h.prefix AND r.ephemeral
                           AND starts_with(h.key, r.root || '/')) AS under_ephemeral FROM h),
    u AS (SELECT bucket, prefix, count(*) AS object_count, sum(size) AS total_bytes,
                 sum(size) FILTER (WHERE under_table) AS delta_bytes, sum(size) FILTER (WHERE NOT under_table) AS loose_bytes,
                 count(*) FILTER (WHERE NOT under_table) AS loose_objects,
                 sum(size) FILTER (WHERE under_ephemeral) AS ephemeral_bytes, sum(size) FILTER (WHERE temp) AS temp_bytes,
                 count(*) FILTER (WHERE temp) AS temp_objects FROM f GROUP BY 1, 2),
    c AS (SELECT bucket, prefix, count(*) AS delta_tables, count(*) FILTER (WHERE ephemeral) AS ephemeral_tables
          FROM r GROUP BY 1, 2)
    SELECT t.bucket, t.prefix, coalesce(object_count, 0) AS object_count,
           CAST(coalesce(total_bytes, 0) AS BIGINT) AS total_bytes, CAST(coalesce(delta_bytes, 0) AS BIGINT) AS delta_bytes,
           CAST(coalesce(loose_bytes, 0) AS BIGINT) AS loose_bytes, coalesce(loose_objects, 0) AS loose_objects,
           CAST(coalesce(ephemeral_bytes, 0) AS BIGINT) AS ephemeral_bytes,
           CAST(coalesce(temp_bytes, 0) AS BIGINT) AS temp_bytes, coalesce(temp_objects, 0) AS temp_objects,
           CASE WHEN total_bytes > 0 THEN CAST(coalesce(loose_bytes, 0) AS DOUBLE) / CAST(total_bytes AS DOUBLE) * 100.0
                ELSE 0.0 END AS loose_pct,
           coalesce(delta_tables, 0) AS delta_tables, coalesce(ephemeral_tables, 0) AS ephemeral_tables
    FROM {usage_targets} t LEFT JOIN u ON t.bucket = u.bucket AND t.prefix = u.prefix
    LEFT JOIN c ON t.bucket = c.bucket AND t.prefix = c.prefix"""


def loose_samples(spark, sf):
    """The first loose keys per bucket."""
    objects = load(spark, sf, "objects")
    return inventory.loose_samples(objects, _written_roots(objects))


LOOSE_SAMPLES = f"""
    WITH f AS ({_FLAGGED})
    SELECT bucket, CAST(row_number() OVER (PARTITION BY bucket ORDER BY key) AS INT) AS sample_no, key
    FROM f WHERE NOT under_table
    QUALIFY sample_no <= 8"""


def bucket_metrics(spark, sf):
    """Usage with samples and growth against the objects changed before 1999."""
    objects = load(spark, sf, "objects")
    before = (
        objects.filter("last_modified < timestamp_ntz'1999-01-01'")
        .groupBy(F.concat(F.lit("s3a://"), "bucket").alias("target"))
        .agg(F.sum("size").alias("total_bytes"))
    )
    metrics = plan.bucket_metrics(objects, before)
    return metrics.select(
        "target", "total_bytes", "loose_bytes", "delta_tables", "growth_pct",
        F.array_join("loose_samples", "|").alias("samples"),
    )


BUCKET_METRICS = f"""
    WITH f AS ({_FLAGGED}),
    s AS (SELECT bucket, key, row_number() OVER (PARTITION BY bucket ORDER BY key) AS n FROM f WHERE NOT under_table),
    j AS (SELECT bucket, string_agg(key, '|' ORDER BY n) AS samples FROM s WHERE n <= 8 GROUP BY 1),
    p AS (SELECT bucket, CAST(sum(size) AS DOUBLE) AS b FROM {{objects}}
          WHERE last_modified < TIMESTAMP '1999-01-01' GROUP BY 1),
    u AS (SELECT bucket, CAST(sum(size) AS BIGINT) AS total_bytes,
                 CAST(coalesce(sum(size) FILTER (WHERE NOT under_table), 0) AS BIGINT) AS loose_bytes FROM f GROUP BY 1),
    t AS (SELECT bucket, count(*) AS delta_tables FROM ({_ROOTS}) GROUP BY 1)
    SELECT 's3a://' || u.bucket AS target, total_bytes, loose_bytes, delta_tables,
           CASE WHEN b > 0 THEN (CAST(total_bytes AS DOUBLE) - b) / b * 100.0 END AS growth_pct, samples
    FROM u LEFT JOIN j ON u.bucket = j.bucket LEFT JOIN p ON u.bucket = p.bucket LEFT JOIN t ON u.bucket = t.bucket"""


def _actions(spark, sf):
    both = load(spark, sf, "file_actions").unionByName(load(spark, sf, "commit_actions"))
    return both.select(
        F.col("tbl").alias("table"), "version", "kind", "path", "size",
        F.col("ts").alias("modification_time"), F.col("ts").alias("deletion_time"),
    )


_LAST_ACTION = """
    SELECT tbl, path, version, kind = 'add' AS live, size, ts FROM {file_actions}
    QUALIFY row_number() OVER (PARTITION BY tbl, path ORDER BY version DESC, live DESC) = 1"""


def live_files(spark, sf):
    """Files whose last action is an add."""
    return commitlog.live_files(_actions(spark, sf))


LIVE_FILES = f"""
    SELECT tbl AS "table", path, version, size, ts AS modification_time FROM ({_LAST_ACTION}) WHERE live"""


def table_stats(spark, sf):
    """Statistics of every table, also of suppliers without a log."""
    named = load(spark, sf, "customer").select(F.concat(F.lit("s3a://bronze/tb_"), "c_custkey").alias("table"))
    return commitlog.table_stats(_actions(spark, sf), named)


TABLE_STATS = f"""
    WITH l AS ({_LAST_ACTION}),
    f AS (SELECT tbl, count(*) FILTER (WHERE live) AS num_files,
                 coalesce(sum(size) FILTER (WHERE live), 0) AS size_bytes FROM l GROUP BY 1),
    v AS (SELECT tbl, max(version) AS version, count(DISTINCT version) AS history_len
          FROM {{commit_actions}} GROUP BY 1),
    c AS (SELECT 's3a://bronze/tb_' || c_custkey AS tbl FROM customer)
    SELECT c.tbl AS "table", v.tbl IS NOT NULL AS is_delta, version, coalesce(num_files, 0) AS num_files,
           coalesce(history_len, 0) AS history_len, CAST(coalesce(size_bytes, 0) AS BIGINT) AS size_bytes,
           CASE WHEN num_files > 0 AND size_bytes > 0 THEN CAST(size_bytes AS DOUBLE) / num_files END AS avg_file_bytes
    FROM c LEFT JOIN v ON c.tbl = v.tbl LEFT JOIN f ON c.tbl = f.tbl"""

_LIMITS = {
    "bucket_growth_pct": 4, "table_growth_pct": 20, "max_num_files": 610, "max_history_len": 590, "history_cap": 605,
    "max_commits_per_day": 83.5, "min_avg_file_bytes": 26, "min_files_for_small_files": 60,
    "min_table_bytes_for_small_files": 14000, "max_loose_bytes_pct": 22, "max_loose_bytes": 30000,
    "max_ephemeral_delta_tables": 1,
}


def _alerts(spark, sf):
    buckets = load(spark, sf, "bucket_metrics").withColumn("loose_samples", F.array(F.lit("a"), F.lit("b")))
    roots = load(spark, sf, "customer").select(
        F.concat(F.lit("n"), "c_nationkey").alias("bucket"), F.concat(F.lit("s3a://x/run_id="), "c_name").alias("uri"),
        (F.col("c_mktsegment") == "MACHINERY").alias("ephemeral"),
    )
    errors = load(spark, sf, "supplier").select(
        F.when(F.col("s_nationkey") < 10, "bucket").otherwise("table").alias("kind"), F.col("s_name").alias("target"),
        F.repeat("s_name", 30).alias("error"),
    )
    return health.evaluate_health(buckets, load(spark, sf, "table_metrics"), _LIMITS, roots=roots, errors=errors)


def health_alerts(spark, sf):
    """The 13 rules, U2: alerts of buckets, tables and failed scans with low limits."""
    return _alerts(spark, sf)


_NONE = "CAST(NULL AS DOUBLE) AS observed, CAST(NULL AS DOUBLE) AS \"limit\""
HEALTH_ALERTS = f"""
    WITH b AS (SELECT *, rtrim('s3a://' || bucket || '/' || prefix, '/') AS target FROM {{bucket_metrics}}),
    t AS (SELECT *, CAST(history_len AS DOUBLE) / 7 AS per_day FROM {{table_metrics}})
    SELECT 1 AS rule_no, 'warn' AS severity, 'bucket_growth' AS code, target,
           'Bucket cresceu ' || printf('%.1f', growth_pct) || '% (limiar 4%; ' || total_bytes || ' bytes, '
             || object_count || ' objetos)' AS message, growth_pct AS observed, CAST(4 AS DOUBLE) AS "limit"
    FROM b WHERE growth_pct >= 4
    UNION ALL
    SELECT 2, 'warn', 'loose_load_volume', target,
           'Objetos fora de tabelas Delta: ' || loose_bytes || ' bytes (' || printf('%.1f', loose_pct) || '%, '
             || loose_objects || ' objs). Amostras: a, b', loose_pct, 22
    FROM b WHERE loose_bytes > 0 AND (loose_pct >= 22 OR loose_bytes >= 30000)
    UNION ALL
    SELECT 3, 'warn', 'ephemeral_delta_load', target,
           ephemeral_tables || ' tabela(s) Delta de carga efêmera, ' || ephemeral_bytes || ' bytes', ephemeral_tables, 1
    FROM b WHERE ephemeral_tables > 1
    UNION ALL
    SELECT 4, 'info', 'ephemeral_delta_table', 's3a://x/run_id=' || c_name,
           'Delta por execução ou meta aninhada; candidato a limpeza', {_NONE}
    FROM customer WHERE c_mktsegment = 'MACHINERY' AND 'n' || c_nationkey IN (SELECT bucket FROM b WHERE ephemeral_tables > 1)
    UNION ALL
    SELECT 5, 'warn', 'temp_load_volume', target,
           temp_objects || ' objeto(s) em path temporário, ' || temp_bytes || ' bytes', temp_objects, 0
    FROM b WHERE temp_objects > 0
    UNION ALL
    SELECT 6, 'warn', 'not_delta', path, 'URI configurada não é tabela Delta', {_NONE} FROM t WHERE NOT is_delta
    UNION ALL
    SELECT 7, 'warn', 'table_growth', path, 'Tabela cresceu ' || printf('%.1f', growth_pct) || '% (limiar 20%; '
             || size_bytes || ' bytes)', growth_pct, 20
    FROM t WHERE is_delta AND growth_pct >= 20
    UNION ALL
    SELECT 8, 'warn', 'too_many_files', path,
           num_files || ' arquivos de dados (limiar 610; possível fragmentação)', num_files, 610
    FROM t WHERE is_delta AND num_files >= 610
    UNION ALL
    SELECT 9, 'warn', 'stale_log', path,
           'Histórico no teto do inventário (' || history_len || '+ versões; cap 605)', history_len, 605
    FROM t WHERE is_delta AND history_len >= 605
    UNION ALL
    SELECT 10, 'info', 'high_commit_rate', path,
           'Histórico com ' || history_len || ' versões (~' || printf('%.0f', per_day)
             || '/dia em 7d; limiar 590 versões ou 83.5/dia)', history_len, 590
    FROM t WHERE is_delta AND history_len < 605 AND (history_len >= 590 OR per_day >= 83.5)
    UNION ALL
    SELECT 11, 'info', 'small_files', path,
           'Arquivo médio ' || CAST(floor(avg_file_bytes) AS BIGINT) || ' bytes (abaixo de 26; ' || num_files
             || ' arquivos, ' || size_bytes || ' bytes)', avg_file_bytes, 26
    FROM t WHERE is_delta AND num_files >= 60 AND size_bytes >= 14000 AND avg_file_bytes < 26
    UNION ALL
    SELECT CASE WHEN s_nationkey < 10 THEN 12 ELSE 13 END, 'warn',
           CASE WHEN s_nationkey < 10 THEN 'bucket_scan_error' ELSE 'table_scan_error' END, s_name,
           repeat(s_name, 30), {_NONE}
    FROM supplier"""


def alerts_by_code(spark, sf):
    """A8."""
    return health.alerts_by_code(_alerts(spark, sf))


ALERTS_BY_CODE = f"WITH a AS ({sql(HEALTH_ALERTS)}) SELECT code, count(*) AS alerts FROM a GROUP BY 1"


def top_alerts(spark, sf):
    """L3: the first alerts of the report."""
    return health.top_alerts(_alerts(spark, sf), 12).select("severity", "code", "target", "message")


TOP_ALERTS = f"""
    WITH a AS ({sql(HEALTH_ALERTS)})
    SELECT severity, code, target, message FROM a
    ORDER BY CASE WHEN rule_no >= 12 THEN 0 WHEN rule_no <= 5 THEN 1 ELSE 2 END, target, rule_no LIMIT 12"""


def resolve_targets(spark, sf):
    """Named URIs, then configured tables, then discovered ones."""
    uri = lambda key: F.concat(F.lit(" s3a://bronze/loads/tb_"), key)
    listed = load(spark, sf, "nation").select(uri("n_nationkey").alias("uri"), F.col("n_regionkey").alias("position"))
    project = load(spark, sf, "supplier").select(uri(F.col("s_nationkey") + 10).alias("uri"))
    found = inventory.table_roots(load(spark, sf, "objects")).select("uri")
    return targets.resolve_targets(listed, project, found, uri_prefix="s3a://bronze")


RESOLVE_TARGETS = f"""
    WITH u AS (
      SELECT 's3a://bronze/loads/tb_' || n_nationkey AS uri, 0 AS priority, CAST(n_regionkey AS BIGINT) AS position FROM nation
      UNION ALL SELECT 's3a://bronze/loads/tb_' || (s_nationkey + 10), 1, 0 FROM supplier
      UNION ALL SELECT 's3a://' || bucket || '/' || root, 2, 0 FROM ({_ROOTS}) WHERE bucket = 'bronze')
    SELECT uri, CAST(priority AS INT) AS priority, position FROM u
    QUALIFY row_number() OVER (PARTITION BY uri ORDER BY priority, position) = 1"""


def orphan_files(spark, sf):
    """Stored files without a live reference, past the retention."""
    actions = _actions(spark, sf)
    files = load(spark, sf, "stored_files").select(
        F.col("tbl").alias("table"), "path", "size", F.col("ts").alias("last_modified")
    )
    return maintain.orphan_files(files, commitlog.latest_actions(actions), ntz_literal(_NOW), include_untracked=True)


_CUTOFF = f"TIMESTAMP '{_NOW}' - INTERVAL '168' HOUR"
ORPHAN_FILES = f"""
    WITH l AS ({_LAST_ACTION})
    SELECT s.tbl AS "table", s.path, s.size, s.ts AS last_modified
    FROM {{stored_files}} s LEFT JOIN l ON s.tbl = l.tbl AND s.path = l.path
    WHERE s.ts < {_CUTOFF} AND (l.path IS NULL OR (NOT l.live AND l.ts < {_CUTOFF}))"""


def expired_commits(spark, sf):
    """M3: commits past the retention and below the last checkpoint."""
    files = load(spark, sf, "log_files").select(
        F.col("tbl").alias("table"), "version", "kind", F.col("ts").alias("last_modified")
    )
    return maintain.expired_commits(files, ntz_literal(_NOW), retention_days=30)


EXPIRED_COMMITS = f"""
    WITH c AS (SELECT tbl, max(version) AS cp FROM {{log_files}} WHERE kind = 'checkpoint' GROUP BY 1)
    SELECT f.tbl AS "table", f.version, f.kind, f.ts AS last_modified FROM {{log_files}} f JOIN c ON f.tbl = c.tbl
    WHERE kind = 'commit' AND version < cp AND ts < TIMESTAMP '{_NOW}' - INTERVAL '30' DAY"""


def maintenance_tally(spark, sf):
    """A11."""
    results = load(spark, sf, "orders").select(
        F.lit("u").alias("uri"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("removed"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).alias("error"),
    )
    return maintain.maintenance_tally(results)


MAINTENANCE_TALLY = """
    SELECT count(*) FILTER (WHERE o_orderstatus <> 'P') AS ok, count(*) FILTER (WHERE o_orderstatus = 'P') AS failures,
           CAST(sum(CASE WHEN o_orderstatus <> 'P' THEN o_custkey END) AS BIGINT) AS removed FROM orders"""

QUERIES = {
    "table_roots": (table_roots, sql(TABLE_ROOTS)),
    "object_classes": (object_classes, sql(_FLAGGED)),
    "bucket_usage": (bucket_usage, sql(BUCKET_USAGE)),
    "prefix_usage": (prefix_usage, sql(PREFIX_USAGE)),
    "loose_samples": (loose_samples, sql(LOOSE_SAMPLES)),
    "bucket_metrics": (bucket_metrics, sql(BUCKET_METRICS)),
    "live_files": (live_files, sql(LIVE_FILES)),
    "table_stats": (table_stats, sql(TABLE_STATS)),
    "health_alerts": (health_alerts, sql(HEALTH_ALERTS)),
    "alerts_by_code": (alerts_by_code, ALERTS_BY_CODE),
    "top_alerts": (top_alerts, TOP_ALERTS),
    "resolve_targets": (resolve_targets, sql(RESOLVE_TARGETS)),
    "orphan_files": (orphan_files, sql(ORPHAN_FILES)),
    "expired_commits": (expired_commits, sql(EXPIRED_COMMITS)),
    "maintenance_tally": (maintenance_tally, MAINTENANCE_TALLY),
}
