"""Exact percentiles of a column without its values in one task: ranks are narrowed down by counts of equal bins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a count; values that are sorted on the driver at the end.
BINS, FEW = 4096, 20_000


class Ranks:
    """Values of a column by rank; what one rank's search counted or read serves the others."""

    def __init__(self, df: DataFrame, column: str):
        self.df = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
        self.n, self.lo, self.hi = self.df.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
        self.bins: dict = {}
        self.read: dict = {}

    def _bins(self, lo: float, hi: float) -> list:
        if (lo, hi) not in self.bins:
            width = (hi - lo) / BINS
            place = F.least(F.floor((F.col("v") - lo) / width), F.lit(BINS - 1)) if width > 0 else F.lit(0)
            counts = self.df.where(F.col("v").between(lo, hi)).groupBy(place.cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            self.bins[lo, hi] = sorted(tuple(r) for r in counts.collect())  # BINS rows at most
        return self.bins[lo, hi]

    def at(self, rank: int) -> float:
        """The value of a rank, counted from 0."""
        if rank in (0, self.n - 1):
            return self.lo if rank == 0 else self.hi
        lo, hi, below = self.lo, self.hi, 0  # how many are under lo
        while lo < hi:
            for _, n, a, b in self._bins(lo, hi):
                if below + n > rank:
                    break
                below += n
            lo, hi = a, b
            if n <= FEW:
                if (lo, hi) not in self.read:
                    self.read[lo, hi] = sorted(r.v for r in self.df.where(F.col("v").between(lo, hi)).collect())
                return self.read[lo, hi][rank - below]
        return lo


def percentiles(df: DataFrame, column: str, shares: list[float]) -> list[float] | None:
    """Values at shares, linear between neighbours; None where there is no value. Nulls and NaN are not counted."""
    ranks = Ranks(df, column)
    if not ranks.n:
        return None
    out = []
    for p in shares:
        place = p * (ranks.n - 1)
        below = math.floor(place)
        low = ranks.at(below)
        out.append(low if place == below else low + (place - below) * (ranks.at(below + 1) - low))
    return out
