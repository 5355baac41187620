"""Exact percentiles of whole tables in bounded memory.

Spark's `percentile` keeps a map of all distinct values in one reducer. Here each pass counts the
values in at most `BINS` bins between two bounds, with each bin's least and greatest value, and the
bounds close in on the bin that holds the rank that is asked for. A pass is one aggregation for all
percentiles together, and what reaches the driver is its bins; n values take about
log(n) / log(BINS) passes, whatever their distribution, as equal values end a search at once.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 512


class _Search:
    """One percentile: the two ranks it lies between, and the bounds that still hold them."""

    def __init__(self, low: float, high: float, n: int, p: float):
        self.low, self.high, self.below = low, high, 0
        at = p * (n - 1)
        self.first, self.last, self.share = math.floor(at), math.ceil(at), at - math.floor(at)
        self.values: tuple[float, float] | None = (low, high) if low == high else None

    def narrow(self, bins: list[tuple[int, float, float]]) -> None:
        """bins: count, least and greatest value of each, in order."""
        found, below = [], self.below
        for rank in (self.first, self.last):
            start = below
            for n, low, high in bins:
                if rank < start + n:
                    found.append((start, n, low, high))
                    break
                start += n
        (s0, n0, lo0, hi0), (s1, _, lo1, hi1) = found
        if s0 != s1:  # the last value of one bin and the first of the next
            self.values = (hi0, lo1)
        elif lo0 == hi0:
            self.values = (lo0, hi0)
        else:
            self.low, self.high, self.below = lo0, hi0, s0

    def value(self) -> float:
        a, b = self.values
        # the same interpolation as Spark's percentile
        return a if self.first == self.last or a == b else (1 - self.share) * a + self.share * b


def exact_percentiles(rows: DataFrame, wanted: Mapping[str, tuple[Column, float]], bins: int = BINS) -> dict[str, float | None]:
    """The interpolated percentile of each (value, share from 0 to 1) in `wanted`; None where there is no value. Nulls are left out."""
    names = list(wanted)
    value = {k: wanted[k][0].cast("double") for k in names}
    if not names:
        return {}
    ends = rows.agg(*(f(value[k]).alias(f"{c}{i}") for i, k in enumerate(names) for c, f in (("lo", F.min), ("hi", F.max), ("n", F.count)))).first()
    odd = [k for i, k in enumerate(names) if ends[f"n{i}"] and not (math.isfinite(ends[f"lo{i}"]) and math.isfinite(ends[f"hi{i}"]))]
    if odd:
        raise ValueError(f"percentiles need finite values: {', '.join(odd)}")
    search = {k: _Search(ends[f"lo{i}"], ends[f"hi{i}"], ends[f"n{i}"], wanted[k][1]) for i, k in enumerate(names) if ends[f"n{i}"]}
    while open_ := {k: s for k, s in search.items() if s.values is None}:
        # bounds are literals: values outside them never leave the map side
        one = [F.when(value[k].between(s.low, s.high), F.struct(F.lit(k).alias("k"), value[k].alias("v"), F.least(F.floor((value[k] - s.low) / ((s.high - s.low) / bins)), F.lit(bins - 1)).cast("int").alias("bin"))) for k, s in open_.items()]
        held = rows.select(F.explode(F.filter(F.array(*one), lambda x: x.isNotNull())).alias("x")).select("x.*")
        found = held.groupBy("k", "bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        for k, s in open_.items():
            s.narrow([(r.n, r.lo, r.hi) for r in sorted((r for r in found if r.k == k), key=lambda r: r.bin)])
    return {k: search[k].value() if k in search else None for k in names}
