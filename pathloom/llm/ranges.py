"""Ranges of keys: a global order by key without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: So many ranges at most: what the driver and each plan hold of a key's order.
MOST_RANGES = 65_536
_STEP = 128


def range_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most parts - 1 ascending keys that cut the rows into ranges of about equal size; part p begins at bound p."""
    parts = min(parts, MOST_RANGES)
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    cuts = df.agg(F.percentile_approx(key, at, max(10_000, 4 * parts))).first()[0]
    return sorted({int(x) for x in cuts}) if cuts else []


def range_of(key: Column, bounds: list[int]) -> Column:
    """The number of the range that a key lies in, 0 to len(bounds); null keys come first."""
    if not bounds:
        return F.lit(0)

    def reached(cuts: Column) -> Column:
        return F.size(F.filter(cuts, lambda b: b <= key))

    def literal(xs: list[int]) -> Column:
        return F.array(*(F.lit(x).cast("long") for x in xs))

    if len(bounds) <= _STEP:
        return F.when(key.isNull(), F.lit(0)).otherwise(reached(literal(bounds)))
    # Bounds ascend: the block of _STEP bounds is found first, then the place in it.
    block = F.greatest(reached(literal(bounds[::_STEP])) - 1, F.lit(0))
    return F.when(key.isNull(), F.lit(0)).otherwise(block * _STEP + reached(F.slice(literal(bounds), block * _STEP + 1, F.lit(_STEP))))
