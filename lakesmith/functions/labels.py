"""Numbers and texts of the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._column import ColumnOrName, as_column, let
from .text import strip

# Unit names, each 1024 times the one before.
BYTE_UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB")

# Run type and its label.
TRIGGER_LABELS = {
    "scheduled": "agendado",
    "manual": "manual",
    "backfill": "backfill",
    "dataset_triggered": "dataset",
    "asset_triggered": "asset",
}

# Origins that count as manual when the run type says nothing.
MANUAL_ORIGINS = ("ui", "rest_api", "cli", "operator")

def growth_pct(current: ColumnOrName, previous: ColumnOrName) -> Column:
    """Percent change; null when not comparable, 100 when growing from nothing."""
    now = as_column(current).cast("double")
    before = as_column(previous).cast("double")
    return (
        F.when(now.isNull() | before.isNull(), None)
        .when(before <= 0, F.when(now > 0, 100.0))
        .otherwise((now - before) / before * 100.0)
    )


def _tenths(size: Column) -> Column:
    """A number of at least 0 as whole tenths: exact binary value, ties to even.

    The fraction after the last whole number is exact, so it can be compared with
    the double nearest to .05, .15, .. A fraction equal to that double rounds up
    where the double lies above the decimal, and for .75, the odd one of the two
    real ties.
    """
    whole = F.floor(size)
    fraction = size - whole.cast("double")
    digit = F.least(F.floor(fraction * 10.0), F.lit(9))
    middle = (digit * 2 + 1).cast("double") / 20.0
    up = (fraction > middle) | ((fraction == middle) & digit.isin(0, 4, 5, 6, 7))
    return whole * 10 + digit + up.cast("long")


def _decimal_text(tenths: Column) -> Column:
    whole = F.floor(tenths.cast("double") / 10.0).cast("string")
    return F.concat(whole, F.lit("."), (tenths % 10).cast("string"))


def one_decimal(value: ColumnOrName) -> Column:
    """``%.1f`` that rounds the exact binary value, ties to even.

    ``format_string`` and ``round`` round the shortest decimal text instead,
    which differs for values such as 2.25 and 0.15.
    """
    def text(number: Column) -> Column:
        sign = F.when(number < 0, "-").otherwise("")
        return F.concat(sign, let(_tenths(F.abs(number)), _decimal_text))

    return let(as_column(value).cast("double"), text)


def format_bytes(count: ColumnOrName) -> Column:
    """Size in the largest unit that keeps it at 1 or more; bytes without a decimal."""

    def text(size: Column) -> Column:
        power = F.lit(0)
        for step in range(1, len(BYTE_UNITS)):
            power = power + (size >= float(1024**step)).cast("int")
        return let(power, lambda p: in_unit(size, p))

    def in_unit(size: Column, power: Column) -> Column:
        unit = F.element_at(F.array(*[F.lit(" " + u) for u in BYTE_UNITS]), power + 1)
        number = let(_tenths(size / F.pow(F.lit(1024.0), power)), _decimal_text)
        return F.concat(F.when(power == 0, F.floor(size).cast("string")).otherwise(number), unit)

    size = F.greatest(as_column(count).cast("double"), F.lit(0.0))
    return F.when(as_column(count).isNull(), "?").otherwise(let(size, text))


def format_growth_pct(growth: ColumnOrName) -> Column:
    growth = as_column(growth)
    sign = F.when(growth > 0, "+").otherwise("")
    return F.coalesce(F.concat(sign, one_decimal(growth), F.lit("%")), F.lit("sem base anterior"))


def classify_trigger(
    run_type: ColumnOrName,
    external_trigger: ColumnOrName | None = None,
    triggered_by: ColumnOrName | None = None,
) -> Column:
    """Label of what started a run; an unknown type is its own label."""

    def name_of(value: ColumnOrName | None) -> Column:
        text = F.lit("") if value is None else as_column(value).cast("string")
        return F.lower(strip(F.coalesce(text, F.lit(""))))

    kind, origin = name_of(run_type), name_of(triggered_by)
    external = F.lit(False)
    if external_trigger is not None:
        external = F.coalesce(as_column(external_trigger), F.lit(False))
    label = F.when(F.lit(False), "")
    for name, text in TRIGGER_LABELS.items():
        label = label.when(kind == name, text)
    return (
        label.when(external | origin.isin(*MANUAL_ORIGINS), "manual")
        .when(kind == "", "outro")
        .otherwise(kind)
    )
