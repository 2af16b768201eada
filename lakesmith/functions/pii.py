"""Salted hashes of direct identifiers.

The salt is an argument read once by the caller. It is part of the plan, so
keep ``spark.sql.redaction.string.regex`` set where plans are logged.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._column import ColumnOrName, as_column
from .text import strip

_log = logging.getLogger(__name__)


def salt_configured(salt: str | None) -> bool:
    return bool((salt or "").strip())


def hash_value(value: ColumnOrName, salt: str | None) -> Column:
    """Lower-case hex SHA-256 of salt plus trimmed text; null for null or blank.

    One expression per row inside code generation: hashing the distinct values
    first would cost a shuffle.
    """
    if not salt:
        _log.warning("hashing without a salt: the values can be found by trying all inputs")
    text = strip(as_column(value).cast("string"))
    return F.when(text != "", F.sha2(F.concat(F.lit(salt or ""), text), 256))


hash_series = hash_value
