"""Tax and health identifiers.

The checks are plain arithmetic on the character codes of the digits, without
branches or casts that could fail, and on text that is never null. That keeps
the generated code small and lets it evaluate the cleaned text once per row. The
code of a missing digit is 0, which the length test rules out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._column import ColumnOrName, as_column
from .text import digits_only

_ZERO = ord("0")


def _digit_text(value: ColumnOrName) -> Column:
    return F.regexp_replace(F.coalesce(as_column(value), F.lit("")), "[^0-9]+", "")


def _code(digits: Column, position: int) -> Column:
    # A double: its arithmetic needs no overflow check in the generated code.
    return F.ascii(F.substring(digits, position, 1)).cast("double")


def _weighted_sum(digits: Column, weights: Sequence[int]) -> Column:
    total = F.lit(float(-_ZERO * sum(weights)))
    for position, weight in enumerate(weights, start=1):
        total = total + _code(digits, position) * float(weight)
    return total


def validate_cpf(value: ColumnOrName) -> Column:
    """11 digits, not all the same, last two are modulo-11 check digits."""
    digits = _digit_text(value)

    def check(size: int) -> Column:
        total = _weighted_sum(digits, range(size + 1, 1, -1))
        return total * 10.0 % 11.0 % 10.0 == _code(digits, size + 1) - float(_ZERO)

    repeated = digits == F.repeat(F.substring(digits, 1, 1), 11)
    return (F.length(digits) == 11) & ~repeated & check(9) & check(10)


def normalize_cpf(value: ColumnOrName) -> Column:
    return F.when(validate_cpf(value), digits_only(value))


def validate_cns(value: ColumnOrName) -> Column:
    """15 digits; first digit 7, 8, 9: weighted sum; 1, 2: tail computed from 11 digits.

    With ``r`` the weighted sum of the first 11 digits modulo 11, the last four
    digits are ``0018`` for r = 1, else ``000`` followed by ``(11 - r) mod 11``.
    """
    digits = _digit_text(value)
    first = F.substring(digits, 1, 1)
    head = _weighted_sum(digits, range(15, 4, -1))
    rest = head % 11.0
    whole = head + sum(
        ((_code(digits, p) - float(_ZERO)) * float(16 - p) for p in range(12, 16)), F.lit(0.0)
    )
    last = (F.lit(11.0) - rest) % 11.0
    tail = F.substring(digits, 12, 3)
    ending = _code(digits, 15) - float(_ZERO)
    provisional = first.isin("7", "8", "9") & (whole % 11.0 == 0.0)
    definitive = first.isin("1", "2") & (
        ((rest == 1.0) & (tail == "001") & (ending == 8.0))
        | ((rest != 1.0) & (tail == "000") & (ending == last))
    )
    return (F.length(digits) == 15) & (provisional | definitive)


def normalize_cns(value: ColumnOrName) -> Column:
    return F.when(validate_cns(value), digits_only(value))


def validate_cnes(value: ColumnOrName) -> Column:
    return F.coalesce(F.length(digits_only(value)) == 7, F.lit(False))


def normalize_cnes(value: ColumnOrName) -> Column:
    """Left-padded to 7 digits; null when there are more (``lpad`` would cut them)."""
    digits = digits_only(value)
    return F.when(F.length(digits) <= 7, F.lpad(digits, 7, "0"))


def normalize_cid10(value: ColumnOrName) -> Column:
    code = F.upper(F.regexp_replace(as_column(value), "[^A-Za-z0-9]+", ""))
    return F.when(code.rlike(r"^[A-Z][0-9]{2}[0-9]?\z"), code)
