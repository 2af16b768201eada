"""Alignment, dedupe, upsert and table writes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import align
from ..operators.dedupe import dedupe, dedupe_counts, key_duplicates, latest_per_key
from ..operators.reconcile import count_reconcile
from ..operators.upsert import duplicate_keys, partition_values, replace_slice, upsert
from ..session import scratch_dir
from ..sinks import tables as sinks
from ..sources.tables import count_rows, open_table, read_columns
from ..streaming.upsert_stream import incremental_upsert_stream
from .inputs import load, sql

_ORDER_COLUMNS = ("k", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")


def merge_upsert(spark, sf):
    """All orders against the next load, with NULL keys on both sides."""
    return upsert(load(spark, sf, "keyed_orders"), load(spark, sf, "order_batch"), ["k"])


_FROM_SOURCE = ", ".join(f"CASE WHEN s.k IS NULL THEN t.{c} ELSE s.{c} END AS {c}" for c in _ORDER_COLUMNS)
MERGE_UPSERT = f"""
    SELECT {_FROM_SOURCE} FROM {{keyed_orders}} t LEFT JOIN {{order_batch}} s ON t.k = s.k
    UNION ALL
    SELECT {', '.join(_ORDER_COLUMNS)} FROM {{order_batch}} s
    WHERE NOT EXISTS (SELECT 1 FROM {{keyed_orders}} t WHERE t.k = s.k)"""


def merge_unique_target(spark, sf):
    """J1 when the target's keys are known to be unique: one anti join and a union."""
    return upsert(
        load(spark, sf, "keyed_orders"), load(spark, sf, "order_batch"), ["k"], target_keys_unique=True
    )


def merge_keep_columns(spark, sf):
    """J1 with target columns the source lacks."""
    source = load(spark, sf, "order_batch").select("k", "o_totalprice")
    return upsert(load(spark, sf, "keyed_orders"), source, ["k"])


MERGE_KEEP_COLUMNS = """
    SELECT t.k, t.o_custkey, t.o_orderstatus,
           CASE WHEN s.k IS NULL THEN t.o_totalprice ELSE s.o_totalprice END AS o_totalprice, t.o_orderdate
    FROM {keyed_orders} t LEFT JOIN {order_batch} s ON t.k = s.k
    UNION ALL
    SELECT s.k, NULL, NULL, s.o_totalprice, NULL FROM {order_batch} s
    WHERE NOT EXISTS (SELECT 1 FROM {keyed_orders} t WHERE t.k = s.k)"""


def merge_partition_scope(spark, sf):
    """J1 limited to the partitions the source mentions; the others keep equal keys."""
    return upsert(
        load(spark, sf, "customer"), load(spark, sf, "customer_batch"), ["c_custkey"], partition_col="c_mktsegment"
    )


_CUSTOMER = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
MERGE_PARTITION_SCOPE = f"""
    WITH v AS (SELECT DISTINCT c_mktsegment AS seg FROM {{customer_batch}}),
    t AS (SELECT c.*, seg IS NOT NULL AS inside FROM customer c LEFT JOIN v ON c.c_mktsegment = seg)
    SELECT {', '.join(f'coalesce(s.{c}, t.{c}) AS {c}' for c in _CUSTOMER)}
    FROM t LEFT JOIN {{customer_batch}} s ON t.inside AND t.c_custkey = s.c_custkey
    UNION ALL
    SELECT {', '.join(_CUSTOMER)} FROM {{customer_batch}} s
    WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.inside AND t.c_custkey = s.c_custkey)"""


def merge_many_partitions(spark, sf):
    """J1 with thousands of partitions, numbers in the target and padded text in the source."""
    target = load(spark, sf, "orders").selectExpr("o_orderkey AS k", "CAST(o_orderkey % 5000 AS INT) AS p", "o_totalprice AS price")
    source = target.where("k % 3 = 0").selectExpr("k", "lpad(CAST(p AS STRING), 6, '0') AS p", "price + 1 AS price")
    return upsert(target, source, ["k"], partition_col="p")


MERGE_MANY_PARTITIONS = """
    WITH t AS (SELECT o_orderkey AS k, CAST(o_orderkey % 5000 AS INTEGER) AS p, o_totalprice AS price FROM orders),
    s AS (SELECT k, p, price + 1 AS price FROM t WHERE k % 3 = 0), v AS (SELECT DISTINCT p FROM s),
    u AS (SELECT t.*, v.p IS NOT NULL AS inside FROM t LEFT JOIN v ON t.p = v.p)
    SELECT u.k, coalesce(s.p, u.p) AS p, coalesce(s.price, u.price) AS price FROM u LEFT JOIN s ON u.inside AND u.k = s.k
    UNION ALL
    SELECT k, p, price FROM s WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.inside AND u.k = s.k)"""


def source_partitions(spark, sf):
    """The partition values of a batch and whether they can be listed."""
    batch = load(spark, sf, "events").withColumn("part", F.expr("CASE user_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN event_type ELSE event_type || ' x' END"))
    return partition_values(batch, "PART")


SOURCE_PARTITIONS = """
    WITH p AS (SELECT DISTINCT CASE user_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN event_type
                               ELSE event_type || ' x' END AS value FROM events)
    SELECT value, trim(value) AS text, trim(value) = '' AS blank,
           regexp_full_match(trim(value), '[A-Za-z0-9_-]+') AS safe FROM p"""


def repeated_source_keys(spark, sf):
    """K4: keys a merge refuses because they occur more than once."""
    return duplicate_keys(load(spark, sf, "lineitem"), ["L_ORDERKEY", "l_partkey"])


REPEATED_SOURCE_KEYS = """
    SELECT l_orderkey, l_partkey, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"""


def replace_status_slice(spark, sf):
    """The slice of status F is loaded again; rows without a status stay."""
    target = load(spark, sf, "orders").withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'P')"))
    new = target.filter("o_orderstatus = 'F'").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return replace_slice(target, new, "o_orderstatus = 'F'")


REPLACE_STATUS_SLICE = """
    SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus,
           CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
           o_orderdate, o_orderpriority
    FROM orders"""


def append_aligned(spark, sf):
    """Suppliers with other spelling, order and columns appended to customers."""
    target = load(spark, sf, "customer")
    rows = load(spark, sf, "supplier").select(
        F.col("s_acctbal").alias("C_AcctBal"), F.col("s_nationkey").alias("C_NATIONKEY"),
        F.col("s_name").alias("c_name"), F.col("s_suppkey").alias("C_CUSTKEY"), F.lit(1).alias("extra"),
    )
    return target.unionByName(align.frame_for_write(rows, target.schema, fill_missing_columns=True))


APPEND_ALIGNED = """
    SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
    UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal, NULL FROM supplier"""

_TEXT_LINES = """
    SELECT l_orderkey, CASE WHEN l_linenumber = 3 THEN 'x' || l_partkey ELSE '' || l_partkey END AS l_partkey,
           CASE WHEN l_linenumber = 4 THEN 'n/d' ELSE '' || l_shipdate END AS l_shipdate,
           CASE WHEN l_returnflag = 'N' THEN NULL ELSE '' || l_linenumber END AS l_linenumber, l_returnflag AS extra
    FROM {lineitem}"""
_LINE_TYPES = "l_orderkey long, l_partkey long, l_suppkey long, l_shipdate timestamp_ntz, l_linenumber int"


def align_types(spark, sf):
    """Text columns fitted to the table's types; extras kept, untyped ones text."""
    df = spark.sql(_TEXT_LINES, lineitem=load(spark, sf, "lineitem")).withColumn("void", F.lit(None))
    return align.align_to_table(df, T._parse_datatype_string(_LINE_TYPES))


ALIGN_TYPES = f"""
    WITH x AS ({_TEXT_LINES})
    SELECT l_orderkey, try_cast(l_partkey AS BIGINT) AS l_partkey, CAST(NULL AS BIGINT) AS l_suppkey,
           try_cast(l_shipdate AS TIMESTAMP) AS l_shipdate, try_cast(l_linenumber AS INT) AS l_linenumber,
           extra, CAST(NULL AS VARCHAR) AS void FROM x"""


def alignment_losses(spark, sf):
    """Values the alignment turns to null, per column."""
    df = spark.sql(_TEXT_LINES, lineitem=load(spark, sf, "lineitem"))
    return align.cast_losses(df, T._parse_datatype_string(_LINE_TYPES))


ALIGNMENT_LOSSES = """
    SELECT column_name, CAST(lost AS BIGINT) AS lost FROM (
      SELECT 'l_orderkey' AS column_name, 0 AS lost
      UNION ALL SELECT 'l_partkey', count(*) FILTER (WHERE l_linenumber = 3) FROM lineitem
      UNION ALL SELECT 'l_shipdate', count(*) FILTER (WHERE l_linenumber = 4) FROM lineitem
      UNION ALL SELECT 'l_linenumber', 0)"""


def dedupe_latest(spark, sf):
    """The latest event per user and type."""
    return latest_per_key(load(spark, sf, "events"), ["user_id", "event_type"], "ts", ["event_id"])


DEDUPE_LATEST = """
    SELECT event_id, ts, user_id, event_type, value, props FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"""

_VERSIONED_LINES = """
    SELECT CASE WHEN l_suppkey % 10 = 3 THEN NULL ELSE l_suppkey END AS supplier, l_orderkey, l_partkey,
           l_linenumber, l_extendedprice, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_shipdate END AS version
    FROM {lineitem}"""


def dedupe_null_keys(spark, sf):
    """NULL keys are one group, NULL versions come last, remaining columns settle ties."""
    df = spark.sql(_VERSIONED_LINES, lineitem=load(spark, sf, "lineitem"))
    return latest_per_key(df, ["supplier", "l_linenumber"], "VERSION")


DEDUPE_NULL_KEYS = f"""
    WITH v AS ({_VERSIONED_LINES})
    SELECT supplier, l_orderkey, l_partkey, l_linenumber, l_extendedprice, version FROM v
    QUALIFY row_number() OVER (PARTITION BY supplier, l_linenumber
      ORDER BY version DESC NULLS LAST, l_orderkey, l_partkey, l_extendedprice) = 1"""


def dedupe_since(spark, sf):
    """Events before a day are dropped first."""
    return dedupe(load(spark, sf, "events"), ["user_id"], "value", "ts", "2024-01-15", ["event_id"])


DEDUPE_SINCE = """
    SELECT event_id, ts, user_id, event_type, value, props FROM events WHERE ts >= TIMESTAMP '2024-01-15'
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) = 1"""


def dedupe_counters(spark, sf):
    """A12."""
    return dedupe_counts(load(spark, sf, "events"), ["user_id", "event_type"], "ts", "2024-01-15")


DEDUPE_COUNTERS = """
    WITH n AS (SELECT count(*) AS before, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-15') AS purged_pre,
                      count(DISTINCT (user_id, event_type)) FILTER (WHERE ts >= TIMESTAMP '2024-01-15') AS after
               FROM events)
    SELECT before, after, before - after AS removed, purged_pre, before - purged_pre - after AS deduped FROM n"""


def duplicate_counts(spark, sf):
    """A1 with NULL keys."""
    return key_duplicates(load(spark, sf, "keyed_orders"), ["k", "o_orderstatus"])


DUPLICATE_COUNTS = """
    WITH d AS (SELECT k, o_orderstatus, count(*) AS n FROM {keyed_orders} GROUP BY 1, 2)
    SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS "unique", CAST(sum(n) - count(*) AS BIGINT) AS duplicates
    FROM d"""


def reconcile_counts(spark, sf):
    """R2: customers against suppliers per nation."""
    def per_nation(name, column):
        return load(spark, sf, name).groupBy(F.concat(F.lit("n"), column).alias("table_name")).agg(
            F.count(F.lit(1)).alias("rows")
        )

    return count_reconcile(per_nation("customer", "c_nationkey"), per_nation("supplier", "s_nationkey"), 3)


RECONCILE_COUNTS = """
    WITH c AS (SELECT 'n' || c_nationkey AS t, count(*) AS n FROM customer GROUP BY 1),
    s AS (SELECT 'n' || s_nationkey AS t, count(*) AS n FROM supplier GROUP BY 1)
    SELECT coalesce(c.t, s.t) AS table_name, coalesce(c.n, 0) AS source_rows, coalesce(s.n, 0) AS target_rows,
           coalesce(c.n, 0) - coalesce(s.n, 0) AS diff
    FROM c FULL JOIN s ON c.t = s.t WHERE abs(coalesce(c.n, 0) - coalesce(s.n, 0)) > 3"""


# -- writes, into tables below the scratch folder --------------------------------


def write_merge(spark, sf):
    """Customers created by segment, then merged with the next load."""
    path = scratch_dir(spark, "merge")
    sinks.merge(load(spark, sf, "customer"), path, merge_keys=["c_custkey"], partition_col="c_mktsegment")
    sinks.merge(load(spark, sf, "customer_batch"), path, merge_keys=["C_CUSTKEY"], partition_col="c_mktsegment")
    return open_table(spark, path).select(*_CUSTOMER)


def write_slice(spark, sf):
    """A full overwrite, then one slice."""
    path = scratch_dir(spark, "slice")
    orders = load(spark, sf, "orders").withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'P')"))
    sinks.overwrite(orders, path)
    new = orders.filter("o_orderstatus = 'F'").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    sinks.overwrite(new, path, predicate="o_orderstatus = 'F'")
    return open_table(spark, path)


def write_append(spark, sf):
    """S6."""
    path = scratch_dir(spark, "append")
    sinks.append(load(spark, sf, "customer"), path)
    rows = load(spark, sf, "supplier").select(
        F.col("s_acctbal").alias("C_AcctBal"), F.col("s_nationkey").alias("C_NATIONKEY"),
        F.col("s_name").alias("c_name"), F.col("s_suppkey").alias("C_CUSTKEY"), F.lit(1).alias("extra"),
    )
    sinks.append(rows, path, fill_missing_columns=True)
    return open_table(spark, path)


def write_dedupe(spark, sf):
    """S9."""
    path = scratch_dir(spark, "dedupe")
    sinks.overwrite(load(spark, sf, "events"), path)
    sinks.dedupe_table(spark, path, key_cols=["user_id", "event_type"], version_col="ts", since=None)
    return open_table(spark, path)


def table_counts(spark, sf):
    """Row counts from footers and a read of two columns."""
    path = f"{sf}/lineitem.parquet"
    pairs = read_columns(spark, path, ["L_RETURNFLAG", "l_linestatus"]).groupBy("l_returnflag", "l_linestatus")
    return pairs.agg(F.count(F.lit(1)).alias("rows")).withColumn("total", F.lit(count_rows(spark, path)).cast("long"))


TABLE_COUNTS = """
    SELECT l_returnflag, l_linestatus, count(*) AS rows, (SELECT count(*) FROM lineitem) AS total
    FROM lineitem GROUP BY 1, 2"""


def compact_table(spark, sf):
    """M1: many small files per status compacted; the rows stay the same."""
    path = scratch_dir(spark, "compact")
    load(spark, sf, "orders").repartition(16).write.partitionBy("o_orderstatus").parquet(path)
    sinks.compact(spark, path)
    return open_table(spark, path)


def upsert_stream(spark, sf):
    """The events as a stream of files in no order of time, merged batch by batch into a table."""
    path, checkpoint, files = (scratch_dir(spark, x) for x in ("stream", "stream-checkpoint", "stream-files"))
    events = load(spark, sf, "events")
    events.repartition(6, F.xxhash64("event_id")).write.parquet(files)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(files)
    query = incremental_upsert_stream(
        stream, path, keys=["user_id", "event_type"], version="ts", tie_cols=["event_id"], checkpoint=checkpoint
    )
    query.awaitTermination()
    return open_table(spark, path)


QUERIES = {
    "merge_upsert": (merge_upsert, sql(MERGE_UPSERT)),
    "merge_unique_target": (merge_unique_target, sql(MERGE_UPSERT)),
    "merge_keep_columns": (merge_keep_columns, sql(MERGE_KEEP_COLUMNS)),
    "merge_partition_scope": (merge_partition_scope, sql(MERGE_PARTITION_SCOPE)),
    "merge_many_partitions": (merge_many_partitions, MERGE_MANY_PARTITIONS),
    "source_partitions": (source_partitions, SOURCE_PARTITIONS),
    "repeated_source_keys": (repeated_source_keys, REPEATED_SOURCE_KEYS),
    "replace_slice": (replace_status_slice, REPLACE_STATUS_SLICE),
    "append_aligned": (append_aligned, APPEND_ALIGNED),
    "align_types": (align_types, sql(ALIGN_TYPES)),
    "alignment_losses": (alignment_losses, ALIGNMENT_LOSSES),
    "dedupe_latest": (dedupe_latest, DEDUPE_LATEST),
    "dedupe_null_keys": (dedupe_null_keys, sql(DEDUPE_NULL_KEYS)),
    "dedupe_since": (dedupe_since, DEDUPE_SINCE),
    "dedupe_counts": (dedupe_counters, DEDUPE_COUNTERS),
    "key_duplicates": (duplicate_counts, sql(DUPLICATE_COUNTS)),
    "count_reconcile": (reconcile_counts, RECONCILE_COUNTS),
    "write_merge": (write_merge, sql(MERGE_PARTITION_SCOPE)),
    "write_slice": (write_slice, REPLACE_STATUS_SLICE),
    "write_append": (write_append, APPEND_ALIGNED),
    "write_dedupe": (write_dedupe, DEDUPE_LATEST),
    "table_counts": (table_counts, TABLE_COUNTS),
    "compact": (compact_table, "SELECT * FROM orders"),
    "upsert_stream": (upsert_stream, DEDUPE_LATEST),
}
