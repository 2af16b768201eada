"""Upsert of a stream into a table, micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.align import quoted
from ..operators.dedupe import latest_per_key
from ..sinks.tables import merge


def drop_overlap(stream: DataFrame, keys: Sequence[str], event_time: str, delay: str) -> DataFrame:
    """Drop rows read again by overlapping windows, with state bounded by the delay.

    A watermark needs a zoned timestamp, so one without a zone is cast first.
    """
    if isinstance(stream.schema[event_time].dataType, T.TimestampNTZType):
        stream = stream.withColumn(event_time, quoted(event_time).cast(T.TimestampType()))
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def _apply(
    batch: DataFrame,
    batch_id: int,
    *,
    path: str,
    keys: Sequence[str],
    version: str | None,
    tie_cols: Sequence[str],
    partition_col: str | None,
    fmt: str,
) -> None:
    """Latest row per key of the batch, merged where it is not older; repeating a batch changes nothing."""
    latest = latest_per_key(batch, keys, version, tie_cols)
    versions = [version, *tie_cols] if version else None
    merge(latest, path, merge_keys=keys, partition_col=partition_col, version_col=versions, fmt=fmt)


def incremental_upsert_stream(
    source: DataFrame,
    path: str,
    *,
    keys: Sequence[str],
    version: str | None,
    checkpoint: str,
    tie_cols: Sequence[str] = (),
    partition_col: str | None = None,
    fmt: str = "parquet",
) -> StreamingQuery:
    """Process all available input in micro-batches and stop.

    The checkpoint takes the place of the run log's cursor. Within a batch the
    highest version per key wins, and across batches as well: a batch never replaces
    a row of a higher version. Without ``version`` a later batch overwrites an earlier one.
    A Parquet table without ``partition_col`` is rewritten by every batch; name a
    partition column, or use a table format, when the table is large.
    """
    work = partial(
        _apply, path=path, keys=list(keys), version=version, tie_cols=list(tie_cols),
        partition_col=partition_col, fmt=fmt,
    )
    return (
        source.writeStream.foreachBatch(lambda df, batch_id: work(df, batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

