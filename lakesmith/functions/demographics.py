"""Standard age bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._column import ColumnOrName, as_column
from .text import strip

# Code and label of each age band.
AGE_BANDS = {
    0: "Neonatal precoce",
    1: "Neonatal tardio",
    2: "Pós-neonatal",
    3: "1 a 2 anos",
    4: "3 a 5 anos",
    5: "6 a 9 anos",
    6: "10 a 19 anos",
    7: "20 a 29 anos",
    8: "30 a 39 anos",
    9: "40 a 49 anos",
    10: "50 a 59 anos",
    11: "60 a 69 anos",
    12: "70 a 79 anos",
    13: "80 anos e mais",
    14: "Ignorado",
}
UNKNOWN_BAND = 14

# Last age in years of bands 3 to 12.
_LAST_YEAR = {3: 2, 4: 5, 5: 9, 6: 19, 7: 29, 8: 39, 9: 49, 10: 59, 11: 69, 12: 79}


def age_band(quantity: ColumnOrName, unit: ColumnOrName) -> Column:
    """Band code 0-14 of an age given as quantity and unit.

    A text quantity must hold a whole number ("3.7" is unknown); a fractional
    number is cut (3.7 is 3).
    """
    amount = as_column(quantity).try_cast(T.LongType())
    name = F.lower(strip(as_column(unit).cast("string")))

    newborn = F.when(amount <= 6, 0).when(amount <= 27, 1).otherwise(2)
    years = F.when(amount < 1, 2)
    for code, last in _LAST_YEAR.items():
        years = years.when(amount <= last, code)
    years = years.otherwise(13)

    return (
        F.when(amount.isNull(), UNKNOWN_BAND)
        .when(name.isin("minuto", "hora", "dia"), newborn)
        .when(name == "mes", 2)
        .when(name == "ano", years)
        .otherwise(UNKNOWN_BAND)
    )


def age_band_label(code: ColumnOrName) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in AGE_BANDS.items() for x in pair])
    number = as_column(code).try_cast(T.IntegerType())
    return F.coalesce(F.element_at(labels, number), F.lit(AGE_BANDS[UNKNOWN_BAND]))
