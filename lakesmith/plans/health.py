"""Health scan: inventory, table statistics, growth and alerts in one job."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import health
from ..operators.commitlog import table_stats
from ..operators.inventory import bucket_usage, loose_samples, table_roots, with_samples
from ..operators.targets import resolve_targets
from ..sinks.files import materialize


@dataclass(frozen=True)
class HealthScan:
    buckets: DataFrame
    tables: DataFrame
    alerts: DataFrame


def bucket_metrics(
    objects: DataFrame, previous: DataFrame | None = None, roots: DataFrame | None = None
) -> DataFrame:
    """Bucket usage with samples, ``target`` and growth against ``(target, total_bytes)``."""
    if roots is None:
        roots = materialize(table_roots(objects), "roots")
    usage = with_samples(bucket_usage(objects, roots), loose_samples(objects, roots))
    usage = usage.withColumn("target", health.bucket_target(usage))
    if previous is None:
        return usage.withColumn("growth_pct", F.lit(None).cast("double"))
    return health.with_growth(usage, previous, "target", "total_bytes")


def table_metrics(
    actions: DataFrame, tables: DataFrame, previous: DataFrame | None = None
) -> DataFrame:
    """Statistics of the named tables with growth against ``(table, size_bytes)``."""
    stats = table_stats(actions, tables)
    if previous is None:
        return stats.withColumn("growth_pct", F.lit(None).cast("double"))
    return health.with_growth(stats, previous, "table", "size_bytes")


def health_scan(
    objects: DataFrame,
    actions: DataFrame,
    *,
    listed: DataFrame | None = None,
    project_tables: DataFrame | None = None,
    previous_buckets: DataFrame | None = None,
    previous_tables: DataFrame | None = None,
    errors: DataFrame | None = None,
    thresholds: Mapping[str, float] | None = None,
) -> HealthScan:
    """Metrics and alerts of all buckets and tables.

    The inventory and the actions are read several times: pass tables, not a
    listing (see ``materialize``).
    """
    roots = materialize(table_roots(objects), "roots")
    targets = resolve_targets(listed, project_tables, roots.select("uri"))
    buckets = bucket_metrics(objects, previous_buckets, roots)
    tables = table_metrics(actions, targets.select(F.col("uri").alias("table")), previous_tables)
    alerts = health.evaluate_health(buckets, tables, thresholds, roots=roots, errors=errors)
    return HealthScan(buckets, tables, alerts)
