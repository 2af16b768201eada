"""Which tables a maintenance job works on."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

# Buckets of the three layers, scanned when none are named.
DEFAULT_BUCKETS = ("bronze", "prata", "ouro")


def resolve_buckets(buckets: Iterable[str] | None = None) -> list[str]:
    named = [str(b).strip().strip("/") for b in (buckets or []) if str(b).strip()]
    return named or list(DEFAULT_BUCKETS)


def listed_uris(spark: SparkSession, uris: Iterable[str]) -> DataFrame:
    """``(uri, position)`` of URIs named in a configuration."""
    return spark.createDataFrame([(str(u), i) for i, u in enumerate(uris)], "uri string, position long")


def resolve_targets(
    listed: DataFrame | None = None,
    project_tables: DataFrame | None = None,
    discovered: DataFrame | None = None,
    *,
    uri_prefix: str = "",
) -> DataFrame:
    """``(uri, priority, position)``: named URIs, then project tables, then discovered ones.

    Each input holds ``uri`` and may hold ``position``; the first occurrence of a
    URI counts, blank ones are dropped, ``uri_prefix`` filters the result.
    """
    union = None
    for priority, part in enumerate((listed, project_tables, discovered)):
        if part is None:
            continue
        position = F.col("position") if "position" in part.columns else F.lit(0)
        rows = part.select(
            strip("uri").alias("uri"), F.lit(priority).alias("priority"), position.cast("long").alias("position")
        ).filter(F.col("uri") != "")
        union = rows if union is None else union.unionByName(rows)
    if union is None:
        raise ValueError("no targets given")
    if uri_prefix:
        union = union.filter(F.col("uri").startswith(uri_prefix))
    return (
        union.groupBy("uri")
        .agg(F.min(F.struct("priority", "position")).alias("first"))
        .select("uri", "first.priority", "first.position")
    )
