"""Column expressions that give equal values in every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_round(c: Column, digits: int) -> Column:
    """Half-up rounding by floor: unlike round(), it does not depend on the engine."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def truncate(c: Column) -> Column:
    """Towards zero, as an integer."""
    return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("long")


def clamp(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def bin_of(c: Column, low: float, width: float, bins: int) -> Column:
    """Histogram bin, the right edge included in the last one; out of range: null."""
    b = F.least(F.floor((c - low) / width), F.lit(bins - 1))
    return F.when((c >= low) & (c <= low + width * bins), b).cast("long")


def exact_sum(c: Column, digits: int = 6) -> Column:
    """A sum that does not depend on the order of the rows."""
    return F.sum(c.cast(f"decimal(18,{digits})")).cast("double")


def at_rest(rows, places=(("score", 4), ("area_frac", 5))):
    """Detections as they are stored: rounded half to even, before any threshold is applied to them."""
    return rows.withColumns({c: F.bround(F.col(c), n) for c, n in places})
