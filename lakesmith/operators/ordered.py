"""Ordered lookup: for each row the last event at or before its place.

Rows and events are sorted by one text, the place, in ranges of about equal size:
each range is one sort and one pass. Ranges are cut at places of a sample of the
rows, so a folder of any size spreads over as many ranges as it has rows for. An
event at each cut carries on what was open there; events must hold it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range.
RANGE_ROWS = 100_000
#: Ranges, at most, and sampled places for each; together they bound what the driver sees.
MOST_RANGES = 4096
_SAMPLED = 32


def cut_points(rows: DataFrame, place: str, range_rows: int | None = None) -> list[str]:
    """Places that cut the rows into ranges, rising; none for few rows."""
    rows = rows.select(place).filter(F.col(place).isNotNull())
    n = rows.count()
    ranges = min(MOST_RANGES, math.ceil(n / (range_rows or RANGE_ROWS)))
    if ranges < 2:
        return []
    wanted = ranges * _SAMPLED
    share = min(1.0, 1.2 * wanted / n)
    sample = sorted(r[0] for r in rows.sample(share, seed=17).collect())
    step = max(1, len(sample) // ranges)
    return sorted(set(sample[step::step]))


def _range_of(place: Column, cuts: Sequence[str]) -> Column:
    """How many cuts are at or before the place: first among every so many cuts, then between two of these."""
    if not cuts:
        return F.lit(0)
    width = math.isqrt(len(cuts)) + 1
    groups = [list(cuts[i : i + width]) for i in range(0, len(cuts), width)]
    reached = lambda found: F.size(F.filter(found, lambda c: c <= place))
    group = F.greatest(reached(F.lit([g[0] for g in groups])) - 1, F.lit(0))
    inside = F.get(F.array(*[F.lit(g) for g in groups]), group)
    return group * width + reached(inside)


def as_of(rows: DataFrame, events: DataFrame, cuts: Sequence[str], place: str, state: str) -> DataFrame:
    """``rows`` with the ``state`` of the last event at or before their ``place``; null before the first.

    ``events`` has ``place``, unique, and ``state``, also at each of the cuts. Rows without a place have no state.
    """
    columns = [F.col(f"`{c}`") for c in rows.columns]
    both = rows.select(*columns, F.lit(None).cast(events.schema[state].dataType).alias(state), F.lit(1).alias("__row"))
    both = both.unionByName(events.select(place, state, F.lit(0).alias("__row")), allowMissingColumns=True)
    ranged = both.withColumn("__range", _range_of(F.col(place), cuts))
    order = Window.partitionBy("__range").orderBy(place, "__row").rowsBetween(Window.unboundedPreceding, 0)
    seen = ranged.withColumn(state, F.last(state, ignorenulls=True).over(order))
    return seen.filter("__row = 1").select(*columns, state)
