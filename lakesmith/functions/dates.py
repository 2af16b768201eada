"""Dates and timestamps in the business zone.

Business timestamps are wall clock in America/Sao_Paulo without a zone
(``TIMESTAMP_NTZ``). Zoned timestamps (``TIMESTAMP``) are instants and are
converted. No result depends on the session zone.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._column import ColumnOrName, as_column
from .text import strip

# Fixed value: the business zone.
BUSINESS_ZONE = "America/Sao_Paulo"

# The pieces of the accepted formats, which are, in this order,
#   d/m/Y  Y-m-d  d-m-Y  Ymd  d/m/y
#   d/m/Y H:M:S  Y-m-d H:M:S  Y-m-dTH:M:S  d/m/Y H:M  Y-m-d H:M
# Day, month and hour may have one digit; a day may be blank plus one digit.
_DAY = r"(?: (?=[1-9](?!\d)))?(3[01]|[12]\d|0[1-9]|[1-9])"
_MONTH = r"(1[0-2]|0[1-9]|[1-9])"
_YEAR = r"((?!0000)\d{4})"
_SHORT_YEAR = r"(\d{2})"
_TIME = r"(2[0-3]|[01]\d|\d):([0-5]\d|\d)"
_SECOND = r"(?:[0-5]\d|\d)"

_SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]+"

# Each pattern is rewritten to year-month-day in one pass. The leading mark
# tells a rewritten value from one that did not match.
_MARK = "\u0001"
_DATE_PATTERN = (
    rf"^(?:{_DAY}/{_MONTH}/{_YEAR}|{_YEAR}-{_MONTH}-{_DAY}"
    rf"|{_DAY}-{_MONTH}-{_YEAR}|{_YEAR}{_MONTH}{_DAY})\z"
)
_DATE_REWRITE = _MARK + "$3$4$9$10-$2$5$8$11-$1$6$7$12"
_SHORT_PATTERN = rf"^{_DAY}/{_MONTH}/{_SHORT_YEAR}\z"
_SHORT_REWRITE = _MARK + "$3-$2-$1"
_STAMP_PATTERN = (
    rf"^(?:{_DAY}/{_MONTH}/{_YEAR}{_SPACE}{_TIME}(:{_SECOND})?"
    rf"|{_YEAR}-{_MONTH}-{_DAY}{_SPACE}{_TIME}(:{_SECOND})?"
    rf"|{_YEAR}-{_MONTH}-{_DAY}[Tt]{_TIME}(:{_SECOND}))\z"
)
_STAMP_REWRITE = _MARK + "$3$7$13-$2$8$14-$1$9$15 $4$10$16:$5$11$17$6$12$18"


def _rewritten(text: Column, pattern: str, rewrite: str) -> Column:
    changed = F.regexp_replace(text, pattern, rewrite)
    return F.when(changed.startswith(_MARK), F.substring(changed, 2, 40))


def parse_date_br(value: ColumnOrName) -> Column:
    """Date of a text in one of the five date formats, else null.

    Two-digit years 69-99 are 19xx, 00-68 are 20xx.
    """
    text = strip(value)
    four_digits = _rewritten(text, _DATE_PATTERN, _DATE_REWRITE)
    short = _rewritten(text, _SHORT_PATTERN, _SHORT_REWRITE)
    century = F.when(F.substring(short, 1, 2) >= "69", "19").otherwise("20")
    two_digits = F.concat(century, short)
    return F.coalesce(four_digits, two_digits).try_cast(T.DateType())


def parse_timestamp_br(value: ColumnOrName) -> Column:
    """Wall-clock timestamp of a text in one of the timestamp or date formats, else null."""
    stamp = _rewritten(strip(value), _STAMP_PATTERN, _STAMP_REWRITE)
    return F.coalesce(
        stamp.try_cast(T.TimestampNTZType()), parse_date_br(value).cast(T.TimestampNTZType())
    )


def as_sp(ts: ColumnOrName, zoned: bool = False) -> Column:
    """Business wall clock: ``zoned`` instants are converted, others already are."""
    ts = as_column(ts)
    if not zoned:
        return ts.cast(T.TimestampNTZType())
    epoch = F.lit("1970-01-01").cast(T.TimestampNTZType())
    utc_clock = F.timestamp_add("MICROSECOND", F.unix_micros(ts), epoch)
    return F.convert_timezone(F.lit("UTC"), F.lit(BUSINESS_ZONE), utc_clock)


def sp_to_lake_ntz(ts: ColumnOrName, zoned: bool = True) -> Column:
    """The wall clock a table stores; the same as :func:`as_sp` since both carry no zone."""
    return as_sp(ts, zoned)


def sp_to_utc(ts: ColumnOrName) -> Column:
    """Business wall clock to the UTC clock, both without a zone."""
    return F.convert_timezone(F.lit(BUSINESS_ZONE), F.lit("UTC"), as_column(ts))


def utc_instant(ts: ColumnOrName) -> Column:
    """Business wall clock to a zoned timestamp, whatever the session zone is."""
    return F.concat(sp_to_utc(ts).cast("string"), F.lit(" UTC")).cast(T.TimestampType())


def now_sp() -> Column:
    return as_sp(F.current_timestamp(), zoned=True)


def day_window(reference: ColumnOrName | None = None, *, days: int = 1) -> tuple[Column, Column]:
    """Start and end of the half-open window of ``days`` days that ends at the reference."""
    end = now_sp() if reference is None else as_column(reference).cast(T.TimestampNTZType())
    return end - F.make_interval(days=F.lit(days)), end


def wall_clock(column: ColumnOrName, data_type: T.DataType) -> Column:
    """Business wall clock of a column of any type; each value is read on its own."""
    col = as_column(column)
    if isinstance(data_type, T.TimestampType):
        return as_sp(col, zoned=True)
    if isinstance(data_type, (T.TimestampNTZType, T.DateType)):
        return col.cast(T.TimestampNTZType())
    if isinstance(data_type, T.StringType):
        return F.coalesce(strip(col).try_cast(T.TimestampNTZType()), parse_timestamp_br(col))
    raise TypeError(f"no timestamps in a column of type {data_type.simpleString()}")


def business_time(value: dt.datetime | dt.date | str) -> dt.datetime:
    """Wall clock of a driver-side value; an aware one is converted."""
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    if not isinstance(value, dt.datetime):
        return dt.datetime.combine(value, dt.time())
    if value.tzinfo is not None:
        value = value.astimezone(ZoneInfo(BUSINESS_ZONE)).replace(tzinfo=None)
    return value


def ntz_literal(value: dt.datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast(T.TimestampNTZType())


def business_range(
    column: ColumnOrName,
    data_type: T.DataType,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
) -> Column:
    """Holds for business times in the closed range; null when unreadable.

    A column without a zone is compared as it is, so the bounds reach the file
    scan. For instants two wider bounds do: the business zone lies at most four
    hours west of UTC, so an instant is never before its own wall clock read as
    UTC, nor more than four hours after it.
    """
    col = as_column(column)
    clock = wall_clock(col, data_type)
    instants = isinstance(data_type, T.TimestampType)
    terms = []
    if start is not None:
        if instants:
            terms.append(col >= _utc_literal(start))
        terms.append(clock >= ntz_literal(start))
    if end is not None:
        if instants:
            terms.append(col <= _utc_literal(end + dt.timedelta(hours=4)))
        terms.append(clock <= ntz_literal(end))
    return reduce(lambda a, b: a & b, terms)


def _utc_literal(value: dt.datetime) -> Column:
    return F.lit(value.replace(tzinfo=dt.timezone.utc))
