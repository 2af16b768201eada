"""Table writes: overwrite, replace a slice, append, merge, dedupe, compact.

Parquet tables are written to a new folder that then takes the table's place;
when a Parquet table is partitioned and only some partitions change, just those
are replaced. With ``fmt="delta"`` the calls go to the Delta connector, which
must be on the classpath.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import align
from ..operators.align import quoted, resolve_columns
from ..operators.dedupe import dedupe, dedupe_counts
from ..operators.upsert import Scope, partition_predicate, partition_values, replace_slice, upsert
from ..sources.storage import partition_columns, put_back, staged_copy, staging_path, swap
from ..sources.tables import open_table, settings


def _target(spark: SparkSession, path: str, fmt: str) -> DataFrame | None:
    """The table that a write changes; one whose last replacement broke off is put back first."""
    if fmt == "parquet":
        put_back(spark, path)
    return open_table(spark, path, fmt)


def _ready(df: DataFrame) -> DataFrame:
    return align.coerce_void_fields(align.business_timestamps_to_ntz(df))


def _counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def _balanced(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Rows of a partition brought together, so that not every task writes a file to each.

    AQE splits a large partition over several tasks and joins small ones.
    """
    return df.hint("rebalance", *partition_by) if partition_by else df


def _write_staged(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    staged = staging_path(path)
    _balanced(df, partition_by).write.partitionBy(*partition_by).parquet(staged)
    swap(df.sparkSession, staged, path)


def _write_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace exactly the partitions that occur in the frame."""
    rows = _balanced(df, partition_by)
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition_by).parquet(path)
    df.sparkSession.catalog.refreshByPath(path)


def _write_all(df: DataFrame, path: str, fmt: str, partition_by: Sequence[str]) -> None:
    if fmt == "parquet":
        _write_staged(df, path, partition_by)
    else:
        writer = df.write.format(fmt).mode("overwrite").option("overwriteSchema", "true")
        writer.partitionBy(*partition_by).save(path)


def _equalities(values: Mapping[str, object]) -> Column:
    return reduce(
        lambda a, b: a & b,
        [quoted(c).isNull() if v is None else quoted(c) == F.lit(v) for c, v in values.items()],
    )


def overwrite(
    df: DataFrame,
    path: str,
    *,
    predicate: str | Column | Mapping[str, object] | None = None,
    partition_by: Sequence[str] = (),
    fmt: str = "parquet",
) -> int:
    """Replace a table, or the slice that matches ``predicate``; returns the frame's rows.

    An empty frame without a predicate changes nothing; with one it deletes the
    slice. A mapping such as ``{"origem": "a"}`` names one partition: when the
    table is partitioned by exactly these columns, only that partition is
    written. Any other predicate rewrites a Parquet table.
    """
    spark = df.sparkSession
    empty = df.isEmpty()
    if empty and predicate is None:
        return 0
    rows, seen = _counted(_ready(df))
    target = _target(spark, path, fmt)

    if predicate is None or target is None:
        _write_all(rows, path, fmt, partition_by)
        return 0 if empty else seen.get["rows"]

    # Untyped columns become text before the slice is replaced; other slices stay.
    healed = align.coerce_void_fields(target)
    named = isinstance(predicate, Mapping)
    condition = _equalities(predicate) if named else predicate
    if fmt != "parquet":
        if not isinstance(predicate, str):
            raise TypeError("a Delta slice needs a predicate as text")
        aligned = align.align_to_table(rows, healed.schema)
        aligned.write.format(fmt).mode("overwrite").option("replaceWhere", predicate).save(path)
        return 0 if empty else seen.get["rows"]

    parts = partition_columns(spark, path)
    if named and not empty and parts and sorted(parts) == sorted(predicate) and target.schema == healed.schema:
        one_partition = replace_slice(target.filter(F.lit(False)), rows, condition)
        _write_partitions(one_partition.select(*target.columns), path, parts)
    else:
        _write_staged(replace_slice(healed, rows, condition), path, parts)
    return 0 if empty else seen.get["rows"]


def append(
    df: DataFrame, path: str, *, fill_missing_columns: bool = False, fmt: str = "parquet"
) -> int:
    """Append with the table's columns; extras are dropped, missing ones an error or null."""
    spark = df.sparkSession
    if df.isEmpty():
        return 0
    target = _target(spark, path, fmt)
    if target is None:
        return overwrite(df, path, fmt=fmt)
    void = align.void_columns(target.schema)
    if void:
        raise RuntimeError(f"columns without a type in {path}: {void}; rewrite the table with a full load")
    rows = align.frame_for_write(_ready(df), target.schema, fill_missing_columns=fill_missing_columns)
    rows, seen = _counted(rows)
    parts = partition_columns(spark, path) if fmt == "parquet" else []
    writer = rows.write.format(fmt).mode("append")
    (writer.partitionBy(*parts) if parts else writer).save(path)
    spark.catalog.refreshByPath(path)
    return seen.get["rows"]


def _checked_source(source: DataFrame, keys: Sequence[str]) -> int:
    """Rows of a source whose keys without NULLs are unique, else an error; one pass."""
    names = resolve_columns(source.columns, keys)
    whole = reduce(lambda a, b: a & b, [quoted(k).isNotNull() for k in names])
    per_key = (
        source.groupBy(*[quoted(k) for k in names]).agg(F.count(F.lit(1)).alias("n"))
        .select("n", whole.alias("whole"))
    )
    found = per_key.agg(
        F.sum("n").alias("rows"), F.count_if(F.col("whole") & (F.col("n") > 1)).alias("repeated")
    ).first()
    if found["repeated"]:
        raise ValueError(
            f"{found['repeated']} merge keys occur more than once in the source; keep the latest row per key first"
        )
    return found["rows"]


def merge(
    df: DataFrame,
    path: str,
    *,
    merge_keys: Sequence[str],
    partition_col: str | None = None,
    void_strategy: str = "skip",
    target_keys_unique: bool = False,
    stage_source: bool = True,
    version_col: str | Sequence[str] | None = None,
    fmt: str = "parquet",
) -> int:
    """Idempotent upsert into a table; returns the source's rows.

    An absent table is created from the frame as it is (repeated keys included),
    partitioned by ``partition_col``. In a table partitioned by that column only
    the partitions the source mentions are read and written. With ``version_col``
    older source rows leave newer target rows as they are. The frame is read
    several times and therefore written next to the table first; pass
    ``stage_source=False`` for one that is cheap and always yields the same rows.
    """
    spark = df.sparkSession
    if df.isEmpty():
        return 0
    source = _ready(df)
    target = _target(spark, path, fmt)
    if target is None:
        parts = resolve_columns(source.columns, [partition_col]) if partition_col else []
        rows, seen = _counted(source)
        _write_all(rows, path, fmt, parts)
        return seen.get["rows"]

    with staged_copy(source, path, stage_source) as source:
        source = align.align_column_case(source, target.columns)
        required = [*merge_keys, *([partition_col] if partition_col else [])]
        source = align.drop_void_columns(
            source, align.void_columns(target.schema), required=required, strategy=void_strategy
        )
        target = align.coerce_void_fields(target)
        count = _checked_source(source, merge_keys)
        scope = partition_predicate(source, partition_col) if partition_col else Scope(None, None)
        if fmt != "parquet":
            _merge_delta(spark, source, path, merge_keys, scope, version_col)
            return count

        parts = partition_columns(spark, path)
        how = {"target_keys_unique": target_keys_unique, "version_col": version_col}
        if _only_mentioned_partitions(source, scope, parts):
            result = upsert(scope.touched(target), source, merge_keys, **how)
            _write_partitions(result, path, parts)
        else:
            result = upsert(target, source, merge_keys, scope=scope, **how)
            _write_staged(result, path, parts)
    return count


def _only_mentioned_partitions(source: DataFrame, scope: Scope, parts: Sequence[str]) -> bool:
    """Whether a merge stays inside the partitions that the source mentions.

    Each of them then receives at least one source row, so none is left
    behind empty. A blank or untrimmed value goes elsewhere and forbids it.
    """
    if scope.everything or len(parts) != 1 or parts[0].lower() != scope.column.lower():
        return False
    values = partition_values(source, scope.column)
    other = F.col("blank") | (F.col("value").cast("string") != F.col("text"))
    return values.filter(other).isEmpty()


def _merge_delta(
    spark: SparkSession, source: DataFrame, path: str, keys: Sequence[str], scope: Scope, version_col: str | Sequence[str] | None
) -> None:
    from delta.tables import DeltaTable

    names = resolve_columns(source.columns, keys)
    terms = [f"target.`{k}` = source.`{k}`" for k in names]
    inside = scope.sql()
    if inside:
        terms.append(inside)
    merging = DeltaTable.forPath(spark, path).alias("target").merge(source.alias("source"), " AND ".join(terms))
    newer = None
    if version_col is not None:
        names = [version_col] if isinstance(version_col, str) else version_col
        versions = resolve_columns(source.columns, names)
        side = lambda x: f"struct({', '.join(f'{x}.`{v}`' for v in versions)})"
        newer = f"{side('source')} >= {side('target')}"
    merging.whenMatchedUpdateAll(newer).whenNotMatchedInsertAll().execute()


def dedupe_table(
    spark: SparkSession,
    path: str,
    *,
    key_cols: Sequence[str],
    version_col: str = "_extracted_at",
    date_col: str = "dt_atualz",
    since: dt.datetime | dt.date | str | None = "2023-01-01",
    dry_run: bool = False,
    fmt: str = "parquet",
) -> dict[str, int]:
    """Rewrite a table with the latest row per key; returns the counters.

    Note the default of ``since`` (see :func:`lakesmith.operators.dedupe.dedupe`).
    Nothing is written when nothing would be removed.
    """
    table = _target(spark, path, fmt)
    if table is None:
        raise RuntimeError(f"table not found: {path}")
    counts = dedupe_counts(table, key_cols, date_col, since).first().asDict()
    if counts["removed"] and not dry_run:
        parts = partition_columns(spark, path) if fmt == "parquet" else []
        _write_all(dedupe(table, key_cols, version_col, date_col, since), path, fmt, parts)
    return counts


def compact(spark: SparkSession, path: str, *, target_size: int = 128 * 1024 * 1024, fmt: str = "parquet") -> dict[str, int]:
    """Rewrite a table with fewer, larger files; returns the file counts.

    Without partitions the scan itself packs small files into one task up to the
    target size, so nothing is shuffled. With partitions the rows are rebalanced
    by partition: AQE splits large partitions and joins small ones by size.
    """
    if fmt != "parquet":
        spark.sql(f"OPTIMIZE {fmt}.`{path}`")
        return {}
    table = open_table(spark, path)
    if table is None:
        return {}
    before = table.select("_metadata.file_path").distinct().count()
    parts = partition_columns(spark, path)
    packing = {
        "spark__sql__files__maxPartitionBytes": str(target_size),
        "spark__sql__files__openCostInBytes": "0",
        "spark__sql__files__minPartitionNum": "1",
        "spark__sql__adaptive__advisoryPartitionSizeInBytes": str(target_size),
    }
    if parts:
        packing = {"spark__sql__adaptive__advisoryPartitionSizeInBytes": str(target_size)}
    with settings(spark, **packing):
        _write_staged(table, path, parts)
    after = open_table(spark, path).select("_metadata.file_path").distinct().count()
    return {"files_before": before, "files_after": after}
