"""Row-count comparison of two sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_reconcile(
    source_counts: DataFrame, target_counts: DataFrame, limit: int = 0, key: str = "table_name"
) -> DataFrame:
    """Tables whose row counts differ by more than ``limit``.

    Inputs hold ``(key, rows)``; a table missing on one side counts 0 there.
    """
    left = source_counts.select(key, F.col("rows").alias("source_rows"))
    right = target_counts.select(key, F.col("rows").alias("target_rows"))
    zero = F.lit(0).cast("long")
    both = left.join(right, key, "full_outer").select(
        key,
        F.coalesce("source_rows", zero).alias("source_rows"),
        F.coalesce("target_rows", zero).alias("target_rows"),
    )
    return both.withColumn("diff", F.col("source_rows") - F.col("target_rows")).filter(
        F.abs("diff") > limit
    )
