"""The floor plan of a levelled cloud: heights, ceiling mask, outline, variants of the room's ring, cropping to it.

The cloud stays distributed; what comes to the driver is a raster of the ceiling (MAX_CELLS at most) and rings.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.binning import peaks, smoothed, top_peaks
from ..functions.polygon import buffered, cells_to_metres, corners, dilated, eroded, filled, largest_loop, largest_part, outline, perimeter, signed_area
from ..operators import planes, raster, walls
from ..operators.floorplan import MAX_EDGES, ceiling_slice, in_polygon, line_corners, simplify_ring, snap_angles
from ..operators.grid import statistical_outliers, voxel_downsample
from ..operators.quantile import percentiles
from ..storage import stored

#: Cells of a mask on the driver: a hall of 60 m by 60 m at 3 cm.
MAX_CELLS = 4_000_000
#: Variants by preference.
PREFERRED = ("D_refined", "C_snapped", "B_corners", "A_natural")


def floor_and_ceiling(points: DataFrame, bin_width: float = 0.02, seed: int = 0):
    """(floor, ceiling, ceiling's plane or None). By planes; with a floor alone the ceiling is a high percentile; else the
    two highest peaks of the smoothed histogram of heights, or percentiles."""
    room = planes.detect_room(points, seed=seed)
    if room["floor"] and room["ceiling"]:
        ceiling, floor, swapped = planes.pick_ceiling(points, room)
        z = (floor[2][2], ceiling[2][2])
        return (-z[0], -z[1], ceiling) if swapped else (*z, ceiling)
    if room["floor"]:
        floor = room["floor"][2][2]
        above = points.where(F.col("z") > floor + 1.0)
        if above.limit(50).count() == 50:
            return floor, percentiles(above, "z", [0.98])[0], None
        if points.limit(50).count() == 50 and (top := percentiles(points, "z", [0.99])[0]) - floor > 0.5:
            return floor, top, None
    ends = percentiles(points, "z", [0.0, 0.05, 0.95, 1.0])
    if ends is None:
        raise ValueError("an empty cloud")
    lo, low, high, hi = ends
    n = max(1, int(np.ceil((hi - lo) / bin_width)))
    found = points.groupBy(F.least(F.floor((F.col("z") - lo) / bin_width), F.lit(n - 1)).cast("int").alias("bin")).count().collect()  # a row a bin
    h = np.zeros(n)
    for r in found:
        h[r.bin] = r["count"]
    h = smoothed(h, 3)
    two = top_peaks(h, peaks(h, 0.1 * h.max(), 10))
    return (lo + (two[0] + 0.5) * bin_width, lo + (two[1] + 0.5) * bin_width, None) if len(two) == 2 else (low, high, None)


def ceiling_points(points: DataFrame, ceiling_z: float, plane=None, band: float = 0.12) -> DataFrame:
    """The ceiling: from below its first peak of heights over 1.5 m; with under 100 points there, near its plane or height."""
    if points.where("z >= 1.5").limit(100).count() == 100:
        return ceiling_slice(points)
    off = planes.plane_distance(plane[0], plane[1]) if plane else F.col("z") - ceiling_z
    return points.where(F.abs(off) < band)


def room_mask(points: DataFrame, resolution: float = 0.03, margin: float = 0.5, close: int = 11, open_: int = 5):
    """(mask, x and y of its first cell's corner, components removed): the dense cells of a ceiling, closed, its holes
    filled, opened, the largest part alone, its edge smoothed."""
    lo = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if lo[0] is None:
        return np.zeros((0, 0), bool), 0.0, 0.0, 0
    x0, y0 = lo[0] - margin, lo[1] - margin
    shape = int((lo[2] + margin - x0) / resolution), int((lo[3] + margin - y0) / resolution)
    if shape[0] * shape[1] > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells")
    at = points.select((F.col("x") - x0).alias("x"), (F.col("y") - y0).alias("y"))
    cells = stored(raster.density(at, resolution))
    # the threshold is over all cells, empty ones too
    n_filled = cells.count()
    empty = cells.sparkSession.createDataFrame([(0,)], "v int").withColumn("n", F.lit(shape[0] * shape[1] - n_filled))
    threshold = raster.otsu(cells.select("v", F.lit(1).alias("n")).unionByName(empty)).first().threshold or 0
    mask = np.zeros(shape, bool)
    for r in cells.where(F.col("v") > threshold).select("ix", "iy").collect():  # MAX_CELLS at most
        mask[min(r.ix, shape[0] - 1), min(r.iy, shape[1] - 1)] = True
    mask = filled(eroded(dilated(mask, close), close))
    mask, removed = largest_part(dilated(eroded(mask, open_), open_))
    return dilated(eroded(mask, 3), 3), x0, y0, removed


def natural_ring(mask: np.ndarray, x0: float, y0: float, resolution: float = 0.03, epsilon: float = 0.012) -> np.ndarray:
    """The mask's outline in metres, through the middles of its border cells, simplified by a part of its length."""
    ring = outline(mask)
    if len(ring) < 3:
        return np.zeros((0, 2))
    ring = simplify_ring(ring.astype(float), epsilon * perimeter(ring.astype(float)))
    return largest_loop(cells_to_metres(ring, x0, y0, resolution))


def snapped_ring(spark, ring: np.ndarray, step: float = 45.0) -> np.ndarray:
    """The ring with edges of 0.1 m and more turned about their middles to multiples of step degrees."""
    rows = [(0, k, *(np.array(e[:2]) + np.array(e[2:])).tolist(), float(np.degrees(np.arctan2(e[3] - e[1], e[2] - e[0])) % 180)) for k, e in enumerate(walls.edges(ring, 0.1))]
    if len(rows) < 3:
        return ring
    lines = snap_angles(spark.createDataFrame([(p, i, x / 2, y / 2, a) for p, i, x, y, a in rows], "poly int, i int, px double, py double, angle double"), step)
    turn = F.radians("snapped")
    corners = line_corners(lines.select("poly", "i", "px", "py", F.cos(turn).alias("dx"), F.sin(turn).alias("dy"))).orderBy("i").collect()
    return largest_loop(np.array([(r.x, r.y) for r in corners]))


def floor_plan(points: DataFrame, resolution: float = 0.03, voxel: float = 0.03, neighbours: int = 20, ratio: float = 2.0, seed: int = 0) -> dict:
    """points(point_id, x, y, z) -> floor_z, ceiling_z, variants (name -> ring), walls of the refined one, the ceiling's
    mask, and counts. B_corners joins the mask's corners; it is the natural ring where fewer than 3 are found."""
    spark = points.sparkSession
    floor_z, ceiling_z, plane = floor_and_ceiling(points, seed=seed)
    if ceiling_z <= floor_z:
        raise ValueError(f"a height that is not positive: {floor_z:.3f} to {ceiling_z:.3f}")
    cloud = stored(points.select("point_id", "x", "y", "z"))
    n_raw = cloud.count()
    kept = cloud.join(statistical_outliers(cloud, 2 * voxel, neighbours, ratio).select("point_id"), "point_id", "left_semi")
    thin = stored(voxel_downsample(kept, voxel).select("x", "y", "z"))
    mask, x0, y0, removed = room_mask(ceiling_points(thin, ceiling_z, plane), resolution)
    natural = natural_ring(mask, x0, y0, resolution)
    refined = walls.refine(thin, natural, floor_z, ceiling_z) if len(natural) >= 3 else []
    found = corners(mask, 0.5 / resolution) if mask.size else None
    cornered = largest_loop(cells_to_metres(found, x0, y0, resolution)) if found is not None else natural
    rings = {"A_natural": natural, "B_corners": cornered, "C_snapped": snapped_ring(spark, natural)}
    rings["D_refined"] = largest_loop(np.array([w.start for w in refined])) if len(refined) >= 3 else natural
    return {"floor_z": floor_z, "ceiling_z": ceiling_z, "variants": rings, "walls": refined, "n_points_raw": n_raw, "n_points_processed": thin.count(), "n_outlier_clusters_removed": removed, "n_corners_detected": 0 if found is None else len(found), "mask": mask}


def usable_ring(variants: dict, least_area: float = 1.0) -> tuple[str, np.ndarray]:
    """The first variant by preference whose area is above least_area."""
    for name in PREFERRED:
        ring = variants.get(name)
        if ring is not None and len(ring) > 2 and abs(signed_area(ring)) > least_area:
            return name, ring
    raise ValueError("no usable ring")


def plan_metadata(plan: dict) -> str:
    """The plan's numbers as a JSON document."""
    out = {k: round(plan[k], 3) for k in ("floor_z", "ceiling_z")} | {"room_height": round(plan["ceiling_z"] - plan["floor_z"], 3)}
    out |= {k: plan[k] for k in ("n_points_raw", "n_points_processed", "n_outlier_clusters_removed", "n_corners_detected")} | {"variants": {}}
    for name, ring in plan["variants"].items():
        rows = [{"length_m": round(float(np.hypot(c - a, d - b)), 3), "angle_deg": round(float(np.degrees(np.arctan2(d - b, c - a)) % 180), 1)} for a, b, c, d in walls.edges(ring)]
        if name == "D_refined":
            for row, w in zip(rows, plan["walls"]):
                row |= {"snapped_to": w.snapped_to, "residual_m": round(w.residual, 4), "confidence": round(w.confidence, 3), "length_m_data_extent": round(w.high - w.low, 3)}
        out["variants"][name] = {"area_m2": round(abs(signed_area(ring)), 2) if len(ring) > 2 else 0.0, "n_walls": len(rows), "walls": rows}
    return json.dumps(out, indent=2)


def crop_to_room(points: DataFrame, ring, floor_z: float, ceiling_z: float, margin: float = 0.10, share: float = 0.015, least: float = 0.08, most: float = 0.15) -> tuple[DataFrame, dict]:
    """Points inside the ring, widened by a share of its shorter side within bounds, and between the heights with a
    margin; and what was decided, with counts before and after."""
    ring = np.asarray(ring, float)
    width = min(most, max(least, float(np.ptp(ring, axis=0).min()) * share))
    wide = buffered(ring, width)
    if len(wide) > MAX_EDGES:
        raise ValueError(f"more than {MAX_EDGES} edges")
    inside = F.col("z").between(floor_z - margin, ceiling_z + margin) & in_polygon(F.col("x"), F.col("y"), [tuple(map(float, p)) for p in wide])
    n_in, n_out = points.agg(F.count(F.lit(1)), F.count_if(inside)).first()
    info = {"room_area_m2": round(abs(signed_area(wide)), 2), "floor_z": round(floor_z, 3), "ceiling_z": round(ceiling_z, 3), "z_margin_m": margin, "buffer_m": round(width, 3), "n_in": n_in, "n_out": n_out}
    return points.where(inside), info
