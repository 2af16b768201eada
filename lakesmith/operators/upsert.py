"""Upsert of a source frame into a target frame, and slice replacement."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from .align import align_column_case, align_to_table, quoted, resolve_columns

def partition_values(source: DataFrame, partition_col: str) -> DataFrame:
    """Distinct partition values of a source: ``(value, text, blank, safe)``.

    ``text`` is the trimmed form. A value is safe when its text holds letters,
    digits, ``-`` and ``_`` only.
    """
    column = resolve_columns(source.columns, [partition_col])[0]
    text = strip(F.col("value").cast("string"))
    return (
        source.select(quoted(column).alias("value"))
        .distinct()
        .select(
            "value",
            text.alias("text"),
            F.coalesce(text == "", F.lit(True)).alias("blank"),
            F.coalesce(text.rlike(r"^[\p{L}\p{N}_-]+\z"), F.lit(False)).alias("safe"),
        )
    )


def partition_predicate(source: DataFrame, partition_col: str) -> Scope:
    """Which target rows an upsert with a partition column may match.

    Only rows of the partitions the source mentions can match; with an unsafe
    value, or none at all, every row can. The values are compared in the type of
    the target's column, however many there are.
    """
    if partition_col.lower() not in {c.lower() for c in source.columns}:
        return Scope(None, None)
    values = partition_values(source, partition_col).filter(~F.col("blank"))
    found = values.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("safe")).alias("unsafe")
    ).first()
    if not found["n"] or found["unsafe"]:
        return Scope(partition_col, None)
    return Scope(partition_col, values.select("text").distinct())


class Scope:
    """The part of the target an upsert may match: all, or the rows of some partitions."""

    #: Values that a predicate as text can hold.
    MOST_LISTED = 1000

    def __init__(self, column: str | None, frame: DataFrame | None):
        self.column, self.frame = column, frame

    @property
    def everything(self) -> bool:
        return self.frame is None

    def sql(self) -> str | None:
        """The predicate on the target as text, for table formats that take one.

        ``None`` when every row is in scope; an error when the values are too many
        to be written out, since a shorter predicate would match other rows.
        """
        if self.everything:
            return None
        listed = sorted(r["text"] for r in self.frame.limit(self.MOST_LISTED + 1).collect())
        if len(listed) > self.MOST_LISTED:
            raise ValueError(f"the source mentions more than {self.MOST_LISTED} partitions; merge it in parts")
        column = f"target.`{self.column}`"
        if len(listed) == 1:
            return f"{column} = '{listed[0]}'"
        return f"{column} IN ({', '.join(repr(v) for v in listed)})"

    def values(self, target: DataFrame, name: str) -> DataFrame:
        """The distinct values in scope, in the type of the target's column."""
        column = resolve_columns(target.columns, [self.column])[0]
        typed = F.col("text").try_cast(target.schema[column].dataType).alias(name)
        return self.frame.select(typed).where(F.col(name).isNotNull()).distinct()

    def touched(self, target: DataFrame) -> DataFrame:
        """The target's rows in scope."""
        column = resolve_columns(target.columns, [self.column])[0]
        return target.join(self.values(target, column), column, "left_semi").select(*[quoted(c) for c in target.columns])

    def mark(self, target: DataFrame, flag: str) -> DataFrame:
        """The target with a boolean column telling the rows in scope."""
        if self.everything:
            return target.withColumn(flag, F.lit(True))
        column = resolve_columns(target.columns, [self.column])[0]
        known = self.values(target, "__scope_value").withColumn(flag, F.lit(True))
        return (
            target.join(known, quoted(column) == F.col("__scope_value"), "left")
            .drop("__scope_value")
            .withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
        )


def _spread_key(df: DataFrame, can_match: Column) -> Column:
    """0 for rows that can match; others get a hash of the row, which has no partner.

    Without it all rows with a NULL key would meet in one task of the join. The
    hash depends on the row alone, so a task that runs again deals alike.
    """
    hashable = [
        quoted(f.name)
        for f in df.schema
        if not isinstance(f.dataType, (T.MapType, T.VariantType))
    ]
    return F.when(can_match, F.lit(0).cast("long")).otherwise(F.xxhash64(*hashable).bitwiseOR(F.lit(1)))


def _spread_zero(keys: Sequence[str]) -> Column:
    """0 on the side whose rows all can match.

    A literal would turn the equality into a plain condition, and the rows would
    be dealt by key alone.
    """
    return F.pmod(F.xxhash64(*[quoted(k) for k in keys]), F.lit(1).cast("long"))


def duplicate_keys(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys without NULLs that occur more than once in the source."""
    names = resolve_columns(source.columns, keys)
    return (
        source.select(*[quoted(k) for k in names])
        .dropna()
        .groupBy(*[quoted(k) for k in names])
        .agg(F.count(F.lit(1)).alias("rows"))
        .filter("rows > 1")
    )


def upsert(
    target: DataFrame,
    source: DataFrame,
    merge_keys: Sequence[str],
    *,
    partition_col: str | None = None,
    scope: Scope | None = None,
    target_keys_unique: bool = False,
    version_col: str | Sequence[str] | None = None,
) -> DataFrame:
    """The target after updating matched rows and inserting the others.

    A NULL key matches nothing and is inserted every time. Each target row with
    a matching key takes the source's values; a target column the source lacks
    keeps its value on a match and is null on an insert. Source keys must be
    unique (see :func:`duplicate_keys`); a source column the target lacks is an
    error.

    With ``version_col`` a matched row is only updated by a source row whose version
    is not lower (no version is the lowest), so late data cannot undo newer rows.
    Several columns are compared one after the other.

    With ``partition_col`` the match is limited to the partitions the source
    mentions, so the same key may also live in another partition.

    Plan: the target meets the source in a left join (broadcast by Catalyst when
    the source is small, so the target is not shuffled), and the inserts are an
    anti join against the matching target keys only. ``target_keys_unique``
    states that no key occurs twice in the target; then one anti join and a union
    do, and the target is read once.
    """
    keys = resolve_columns(target.columns, merge_keys)
    source = align_column_case(source, target.columns)
    unknown = [c for c in source.columns if c not in target.columns]
    if unknown:
        raise ValueError(f"source columns missing in the target: {unknown}")
    resolve_columns(source.columns, keys)
    if scope is None:
        scope = partition_predicate(source, partition_col) if partition_col else Scope(None, None)

    shared = [f for f in target.schema if f.name in source.columns]
    source = source.select(*[quoted(f.name).cast(f.dataType).alias(f.name) for f in shared])
    aliases = {f"__key{i}": quoted(k) for i, k in enumerate(keys)}
    has_key = reduce(lambda a, b: a & b, [quoted(k).isNotNull() for k in keys])
    on = [*aliases, "__spread"]

    old = scope.mark(target, "__in_scope")
    can_match = has_key & F.col("__in_scope")
    old_rows = old.withColumns({**aliases, "__spread": _spread_key(target, can_match)})
    new_rows = source.withColumns({**aliases, "__spread": _spread_key(source, has_key)})
    # Only columns of the keys are read for these two.
    old_keys = old.filter(can_match).select(*[c.alias(n) for n, c in aliases.items()])
    new_keys = source.filter(has_key).select(*[c.alias(n) for n, c in aliases.items()])
    wide = len(shared) < len(target.columns)

    if target_keys_unique and not wide and version_col is None:
        kept = old_rows.join(new_keys.withColumn("__spread", _spread_zero(aliases)), on, "left_anti")
        return kept.select(*[quoted(c) for c in target.columns]).unionByName(source)

    fresh = source.filter(has_key).select(
        *[c.alias(n) for n, c in aliases.items()],
        _spread_zero(keys).alias("__spread"),
        F.struct(*[quoted(f.name) for f in shared]).alias("__new"),
    )
    in_source = {f.name for f in shared}
    stays = F.col("__new").isNull()
    if version_col is not None:
        names = [version_col] if isinstance(version_col, str) else list(version_col)
        versions = resolve_columns([f.name for f in shared], names)
        # Structs order their fields one after the other, nulls first.
        given = F.struct(*[F.col("__new").getField(v).alias(v) for v in versions])
        stays = stays | (given < F.struct(*[quoted(v) for v in versions]))
    updated = old_rows.join(fresh, on, "left").select(
        *[
            F.when(stays, quoted(f.name))
            .otherwise(F.col("__new").getField(f.name))
            .alias(f.name)
            if f.name in in_source
            else quoted(f.name)
            for f in target.schema
        ]
    )
    taken = old_keys.join(new_keys, list(aliases), "left_semi").distinct()
    inserted = new_rows.join(taken.withColumn("__spread", _spread_zero(aliases)), on, "left_anti")
    return updated.unionByName(
        inserted.select(*[quoted(c) for c in source.columns]), allowMissingColumns=True
    )


def replace_slice(
    target: DataFrame, new: DataFrame, predicate: Column | str, *, check: bool = True
) -> DataFrame:
    """The target with the rows matching the predicate replaced by ``new``.

    Rows for which the predicate is NULL are outside the slice and stay. The new
    rows are fitted to the target's types; with ``check`` a new row outside the
    slice stops the job, since a repeated load would add it again.
    """
    condition = F.expr(predicate) if isinstance(predicate, str) else predicate
    inside = F.coalesce(condition, F.lit(False))
    rows = align_to_table(new, target.schema)
    if check:
        message = F.lit("a new row lies outside the slice that is replaced")
        rows = rows.filter(F.when(inside, True).otherwise(F.raise_error(message).cast("boolean")))
    return target.filter(~inside).unionByName(rows, allowMissingColumns=True)
