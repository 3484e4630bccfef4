"""Rasters as sparse cell tables: density, Otsu threshold, morphology, components, slices."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .quantile import percentiles


def density(points: DataFrame, resolution: float, cap: float = 0.9) -> DataFrame:
    """ix, iy, n, v: counts per cell, capped at a percentile of the filled cells, scaled to 0..255 and truncated."""
    cells = points.groupBy(F.floor(F.col("x") / resolution).alias("ix"), F.floor(F.col("y") / resolution).alias("iy")).agg(F.count(F.lit(1)).alias("n"))
    cells = stored(cells)
    top = (percentiles(cells, "n", [cap]) or [1.0])[0]
    return cells.select("ix", "iy", "n", (F.least(F.col("n"), F.lit(top)) / top * 255).cast("int").alias("v"))


def otsu(cells: DataFrame) -> DataFrame:
    """One row: the value v that splits cells(v in 0..255) with the largest variance between both parts. A column n, if
    there is one, tells how many cells a row stands for."""
    h = cells.groupBy("v").agg((F.sum("n") if "n" in cells.columns and "ix" not in cells.columns else F.count(F.lit(1))).alias("n"))
    w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)  # 256 rows at most
    c = h.select("v", F.sum("n").over(w).alias("n0"), F.sum(F.col("n") * F.col("v")).over(w).alias("s0"))
    t = h.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("s"))
    j = c.join(F.broadcast(t)).where("n0 < n")
    gap = F.col("s0") / F.col("n0") - (F.col("s") - F.col("s0")) / (F.col("n") - F.col("n0"))
    var = F.col("n0") * (F.col("n") - F.col("n0")) * gap * gap
    return j.agg(F.max_by("v", F.struct(F.round(var, 6), -F.col("v"))).alias("threshold"))


def _moved(cells: DataFrame, reach: int) -> DataFrame:
    span = F.sequence(F.lit(-reach), F.lit(reach))
    return cells.select("ix", "iy").withColumn("dx", F.explode(span)).withColumn("dy", F.explode(span)).select((F.col("ix") + F.col("dx")).alias("ix"), (F.col("iy") + F.col("dy")).alias("iy"))


def dilate(cells: DataFrame, reach: int = 1) -> DataFrame:
    return _moved(cells, reach).distinct()


def erode(cells: DataFrame, reach: int = 1) -> DataFrame:
    return _moved(cells, reach).groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == (2 * reach + 1) ** 2).select("ix", "iy")


def close(cells: DataFrame, reach: int) -> DataFrame:
    return erode(dilate(cells, reach), reach)


def open_(cells: DataFrame, reach: int) -> DataFrame:
    return dilate(erode(cells, reach), reach)


#: Cells along each side of a tile that one kernel labels.
TILE = 512


def largest_component(cells: DataFrame) -> DataFrame:
    """Cells of the largest 8-connected component, the one with the least cell (by ix, then iy) on a tie. Tiles are
    labelled by themselves, labels that meet at their borders are joined, so no task holds the raster."""
    own = stored(cells.select(F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy")).distinct())

    def run(pdf):
        import numpy as np
        import pandas as pd

        at = {p: i for i, p in enumerate(zip(pdf.ix.tolist(), pdf.iy.tolist()))}
        root = list(range(len(at)))

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for (x, y), i in at.items():
            for p in ((x + 1, y - 1), (x + 1, y), (x + 1, y + 1), (x, y + 1)):
                if (j := at.get(p)) is not None:
                    a, b = find(i), find(j)
                    if a != b:
                        root[max(a, b)] = min(a, b)
        label = np.array([find(i) for i in range(len(root))])
        return pd.DataFrame({"ix": pdf.ix, "iy": pdf.iy, "lx": pdf.ix.to_numpy()[label], "ly": pdf.iy.to_numpy()[label]})

    tiles = own.groupBy(F.expr(f"floor(ix / {TILE})"), F.expr(f"floor(iy / {TILE})")).applyInPandas(run, "ix long, iy long, lx long, ly long")
    labelled = stored(tiles.withColumn("label", F.struct("lx", "ly")).select("ix", "iy", "label"))
    border = labelled.where(f"pmod(ix, {TILE}) IN (0, {TILE - 1}) OR pmod(iy, {TILE}) IN (0, {TILE - 1})")
    moved = border.select("label", F.explode(F.array(*[F.struct((F.col("ix") + a).alias("ix"), (F.col("iy") + b).alias("iy")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("p")).select(F.col("label").alias("a"), "p.ix", "p.iy")
    links = moved.join(border.withColumnRenamed("label", "b"), ["ix", "iy"]).where("a <> b").select("a", "b").distinct()
    name = stored(labelled.select("label").distinct().withColumn("to", F.col("label")))
    if not links.isEmpty():
        links = stored(links)  # both ways, as cells are neighbours both ways
        while True:  # the least label travels over the links, twice as far each round by looking up its own label
            least = links.join(name, F.col("b") == F.col("label")).groupBy("a").agg(F.min("to").alias("near"))
            step = name.join(least, F.col("label") == F.col("a"), "left").select("label", F.least("to", F.coalesce("near", "to")).alias("to"))
            jump = step.join(step.select(F.col("label").alias("l2"), F.col("to").alias("t2")), F.col("to") == F.col("l2")).select("label", F.least("to", "t2").alias("to"))
            after = stored(jump)
            if after.join(name.withColumnRenamed("to", "was"), "label").where("to <> was").isEmpty():
                break
            name = after
    sized = labelled.join(name, "label").groupBy("to").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ix", "iy")).alias("first"))
    best = sized.orderBy(F.col("n").desc(), "first").limit(1).select(F.col("to").alias("best"))
    return labelled.join(name, "label").join(F.broadcast(best), F.col("to") == F.col("best"), "left_semi").select("ix", "iy")  # one row


#: Pixels of a picture's side.
MAX_SIDE = 4000


def slice_size(points: DataFrame, resolution: float, least: int = 16) -> tuple[int, int, float]:
    """(width, height, resolution) of a picture of the points, coarser where a side would pass MAX_SIDE."""
    lo = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    extent = (lo[2] - lo[0], lo[3] - lo[1])
    side = lambda r: [max(least, math.ceil(e / r)) for e in extent]
    if max(side(resolution)) > MAX_SIDE:
        resolution *= max(side(resolution)) / MAX_SIDE
    return *side(resolution), resolution


def slice_image(points: DataFrame, z: float, thickness: float, resolution: float) -> DataFrame:
    """px, py, r, g, b of a horizontal slice; the last point of a pixel, by point_id, shows."""
    near = points.where(F.abs(F.col("z") - z) < thickness / 2)
    lo = near.agg(F.min("x").alias("_x"), F.min("y").alias("_y"))
    px = [F.floor((F.col(c) - F.col(f"_{c}")) / resolution).alias(f"p{c}") for c in "xy"]
    return near.join(F.broadcast(lo)).groupBy(*px).agg(F.max_by(F.struct("r", "g", "b"), "point_id").alias("c")).select("px", "py", "c.r", "c.g", "c.b")  # one row
