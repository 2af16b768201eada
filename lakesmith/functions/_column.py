from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def as_column(value: ColumnOrName) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row.

    A column used many times inside an expression is repeated in the generated
    code; for report texts that outgrows the size of a method.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
