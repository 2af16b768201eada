"""Growth and failure reports."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import report
from ..operators.health import top_alerts


@dataclass(frozen=True)
class Report:
    rows: DataFrame
    summary: DataFrame


def growth_report(buckets: DataFrame, alerts: DataFrame, growth_warn_pct: float = 40.0, shown: int | None = None) -> Report:
    """Bucket lines followed by all alerts or the first ``shown``, and the totals."""
    lines = report.growth_rows(buckets, growth_warn_pct).select("label", "detail")
    shown = top_alerts(alerts, shown).select(
        F.concat(F.lit("Health ["), "code", F.lit("] "), "target").alias("label"),
        F.col("message").alias("detail"),
    )
    return Report(lines.unionByName(shown), report.growth_summary(buckets, alerts, growth_warn_pct))


def failures_report(
    runs: DataFrame,
    now: dt.datetime,
    *,
    lookback_hours: int = report.DEFAULT_LOOKBACK_HOURS,
    exclude: Sequence[str] = (),
    max_rows: int = report.MAX_FAILURES,
) -> Report:
    """The newest failures, and the counts per trigger over all of them."""
    failed = report.failed_runs(runs, now, lookback_hours=lookback_hours, exclude=exclude)
    return Report(report.failure_rows(failed, max_rows), report.failures_by_trigger(failed))
