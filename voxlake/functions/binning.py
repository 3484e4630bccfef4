"""Histograms with the edges of a closed last bin, dense over empty bins, and rules on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bin_of(x: Column, lo: Column, hi: Column, n) -> Column:
    """Index of x among n equal bins of [lo, hi], the last one closed."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.least(F.floor((x - lo) / (hi - lo) * n), n - 1).cast("int")


def dense(counts: DataFrame, n: int) -> DataFrame:
    """counts(bin, n) with zeros for absent bins."""
    return counts.sparkSession.range(n).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def local_maxima(bins: DataFrame, least: Column | float, *keys: str) -> DataFrame:
    """Strict interior peaks of bins(bin, n) with n at or above least; the bins of one histogram are few."""
    w = Window.partitionBy(*keys).orderBy("bin")
    b = bins.withColumn("_l", F.lag("n").over(w)).withColumn("_r", F.lead("n").over(w))
    return b.where((F.col("n") > F.col("_l")) & (F.col("n") > F.col("_r")) & (F.col("n") >= least)).drop("_l", "_r")


def smoothed(values, sigma: float):
    """Values under a Gaussian of sigma bins, cut at four sigma, mirrored at the ends."""
    import numpy as np

    reach = int(4 * sigma + 0.5)
    at = np.arange(-reach, reach + 1)
    kernel = np.exp(-0.5 * (at / sigma) ** 2)
    return np.convolve(np.pad(np.asarray(values, float), reach, "symmetric"), kernel / kernel.sum(), "valid")


def peaks(values, least: float = 0.0, distance: int = 1) -> list[int]:
    """Places of interior maxima of at least `least`, plateaus by their middle; of two nearer than distance the higher one
    stays, the later on a tie."""
    import numpy as np

    v = np.asarray(values, float)
    if len(v) < 3:
        return []
    new = np.flatnonzero(np.diff(v, prepend=np.inf) != 0)  # where runs of equal values begin
    end = np.append(new[1:], len(v))
    run = v[new]
    top = np.flatnonzero((run[1:-1] > run[:-2]) & (run[1:-1] > run[2:])) + 1
    found = [((new[k] + end[k] - 1) // 2, run[k]) for k in top if run[k] >= least]
    out: list[int] = []
    for at, _ in sorted(found, key=lambda x: (-x[1], -x[0])):
        if all(abs(at - o) >= distance for o in out):
            out.append(int(at))
    return sorted(out)


def top_peaks(values, at: list[int], k: int = 2) -> list[int]:
    """The k highest of the peaks, in order of place; the later of equal ones."""
    return sorted(sorted(at, key=lambda i: (-values[i], -i))[:k])
