"""Refined walls of one room: a ring of robust lines, joined, turned, met at corners and held to their points.

A wall stands for its points by their number, mean, moments and ends, so walls merge and are clamped without the points.
Rings have tens of walls and live on the driver; the points stay distributed (see wall_band and fit_walls).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.polygon import is_simple, meeting, signed_area
from .floorplan import dominant_directions, fit_walls, tiered_snap, wall_band
from .quantile import percentiles


@dataclass(frozen=True)
class Wall:
    start: np.ndarray
    end: np.ndarray
    mean: np.ndarray  # of the points, on the line fitted to them
    direction: np.ndarray  # of that line, towards end
    low: float = 0.0  # where the points end along it
    high: float = 0.0
    n: int = 0
    moments: np.ndarray | None = None  # about the mean
    residual: float = 0.0
    confidence: float = 0.0
    fallback: bool = False
    snapped_to: str = "free"

    @property
    def length(self) -> float:
        return float(np.linalg.norm(self.end - self.start))

    @property
    def angle(self) -> float:
        d = self.end - self.start
        return math.degrees(math.atan2(d[1], d[0])) % 180


def edges(ring: np.ndarray, least: float = 0.15) -> list[tuple[float, float, float, float]]:
    """(x1, y1, x2, y2) of the ring's edges longer than least."""
    out = []
    for p, q in zip(ring, np.roll(ring, -1, axis=0)):
        if np.linalg.norm(q - p) > least:
            out.append((*map(float, p), *map(float, q)))
    return out


def band_between(points: DataFrame, floor_z: float, ceiling_z: float, margin: float = 0.3) -> DataFrame:
    """Points of the walls' middle heights: margin away from floor and ceiling, less in a low room; the cloud's own
    extent (2nd to 98th percentile) where it hardly meets the given heights; all points of a cloud of under 100."""
    found = percentiles(points, "z", [0.02, 0.98])
    if found is None or points.limit(100).count() < 100:
        return points
    lo, hi = sorted((floor_z, ceiling_z))
    if min(hi, found[1]) - max(lo, found[0]) < 0.5:
        lo, hi = found
    if hi - lo < 2 * margin + 0.2:
        margin = max(0.10, (hi - lo) / 4)
    return points.where((F.col("z") > lo + margin) & (F.col("z") < hi - margin))


def fitted(points: DataFrame, segments: list[tuple[float, float, float, float]], band: float = 0.25, least: int = 20) -> list[Wall]:
    """A wall per segment, fitted to the points near it; the segment itself where there are too few."""
    lengths = {k: math.hypot(s[2] - s[0], s[3] - s[1]) for k, s in enumerate(segments)}
    rows = {r.wall: r for r in fit_walls(wall_band(points, segments, band).select("wall", "x", "y"), lengths, least).collect()}  # a row a segment
    out = []
    for k, s in enumerate(segments):
        a, b = np.array(s[:2]), np.array(s[2:])
        along, r = (b - a) / lengths[k], rows.get(k)
        if r is None or r.fallback:
            out.append(Wall(a, b, (a + b) / 2, along, fallback=True))
            continue
        mean, d = np.array([r.px, r.py]), np.array([r.dx, r.dy])
        t = sorted(float((np.array(e) - mean) @ d) for e in ((r.x1, r.y1), (r.x2, r.y2)))
        if d @ along < 0:
            d, t = -d, [-t[1], -t[0]]
        out.append(Wall(mean + t[0] * d, mean + t[1] * d, mean, d, t[0], t[1], r.inliers, np.array([[r.vxx, r.vxy], [r.vxy, r.vyy]]), r.residual, r.confidence))
    return out


def turned(walls: list[Wall], spark) -> list[Wall]:
    """Walls turned about their mean to the direction they snap to, by the ring's own directions and then fixed angles."""
    table = spark.createDataFrame([(k, w.angle, w.length, w.fallback) for k, w in enumerate(walls)], "wall int, angle double, length double, fallback boolean")
    own = []
    for middle in dominant_directions(table):  # a bin's number; its walls tell the direction more closely
        near = [w for w in walls if not w.fallback and min((w.angle - middle - 0.5) % 180, (middle + 0.5 - w.angle) % 180) <= 2]
        s, c = (sum(w.length * f(math.radians(2 * w.angle)) for w in near) for f in (math.sin, math.cos))
        own.append(math.degrees(math.atan2(s, c)) / 2 % 180 if near else middle)
    found = {r.wall: r.snapped for r in tiered_snap(table, own).collect()}
    out = []
    for k, w in enumerate(walls):
        if w.fallback or found.get(k) is None:
            out.append(w)
            continue
        d = np.array([math.cos(math.radians(found[k])), math.sin(math.radians(found[k]))])
        d = d if d @ w.direction >= 0 else -d
        name = "dominant" if found[k] in own else "fixed"
        out.append(replace(w, start=w.mean + w.low * d, end=w.mean + w.high * d, direction=d, snapped_to=name))
    return out


def _joined(a: Wall, b: Wall) -> Wall:
    """One wall of the points of both, by their moments."""
    n = a.n + b.n
    mean = (a.n * a.mean + b.n * b.mean) / n
    moments = sum(w.moments + w.n * np.outer(w.mean - mean, w.mean - mean) for w in (a, b))
    d = np.linalg.eigh(moments)[1][:, 1]
    d = d if d @ a.direction >= 0 else -d
    t = [float((e - mean) @ d) for w in (a, b) for e in (w.mean + w.low * w.direction, w.mean + w.high * w.direction)]
    spread = np.array([-d[1], d[0]])
    # the mean distance of points spread evenly about their line is 0.8 of their root mean square
    residual = math.sqrt(max(0.0, float(spread @ moments @ spread)) / n) * math.sqrt(2 / math.pi)
    return Wall(mean + min(t) * d, mean + max(t) * d, mean, d, min(t), max(t), n, moments, residual, min(1.0, a.confidence + b.confidence), False, a.snapped_to)


def continues(a: Wall, b: Wall, angle: float = 3.0, gap: float = 1.2) -> bool:
    """Whether b goes on where a ends: alike in direction, off a's line by its noise at most, and not far along it."""
    if a.fallback or b.fallback:
        return False
    turn = abs(a.angle - b.angle)
    off = (b.start + b.end) / 2 - a.mean
    along = a.direction
    return min(turn, 180 - turn) <= angle and abs(off[0] * along[1] - off[1] * along[0]) <= max(3 * max(a.residual, 0.02), 0.10) and float((b.start - a.end) @ along) <= gap


def joined(walls: list[Wall]) -> list[Wall]:
    """The ring with walls that continue one another made one, across its seam too."""
    out: list[Wall] = []
    for w in walls:
        if out and continues(out[-1], w):
            out[-1] = _joined(out[-1], w)
        else:
            out.append(w)
    while len(out) > 3 and continues(out[-1], out[0]):
        out = [_joined(out[-1], out[0]), *out[1:-1]]
    return out


def cornered(walls: list[Wall]) -> list[Wall]:
    """Every wall from where its line meets the one before to where it meets the next; near parallel ones meet in the
    middle of the gap between them."""
    n = len(walls)
    if n < 3:
        return walls
    corner = []
    for k, w in enumerate(walls):
        nxt = walls[(k + 1) % n]
        m = meeting(w.mean, w.direction, nxt.mean, nxt.direction) if abs(w.direction[0] * nxt.direction[1] - w.direction[1] * nxt.direction[0]) >= 1e-6 else None
        corner.append(w.mean + m[0] * w.direction if m else (w.end + nxt.start) / 2)
    made = [replace(w, start=corner[k - 1], end=corner[k]) for k, w in enumerate(walls)]
    return [w for w in made if w.length >= 1e-6]


def held(walls: list[Wall], slack: float = 0.30, least: float = 0.10) -> tuple[list[Wall], int]:
    """The ring with corners that lie beyond both walls' points, by more than a slack that is small for short walls, drawn
    to where the points end; and how many moved. A move that would leave a wall under `least`, or turn it around, is not
    made; if the ring would cross itself, none is."""
    out, moved, n = list(walls), 0, len(walls)
    if n < 3:
        return out, 0
    for k in range(n):
        a, b = out[k], out[(k + 1) % n]
        if a.fallback or b.fallback or min(a.n, b.n) < 10:
            continue
        room = min(slack, max(0.05, 0.10 * max(a.length, b.length)))
        at = [(float((a.end - w.mean) @ w.direction), w) for w in (a, b)]
        near = [min(max(t, w.low - room), w.high + room) for t, w in at]
        if all(abs(t - c) < 1e-6 for (t, _), c in zip(at, near)):
            continue
        corner = sum(w.mean + c * w.direction for (_, w), c in zip(at, near)) / 2
        short, after = replace(a, end=corner), replace(b, start=corner)
        if min(short.length, after.length) < least or (corner - a.start) @ a.direction <= 0 or (b.end - corner) @ b.direction <= 0:
            continue
        out[k], out[(k + 1) % n], moved = short, after, moved + 1
    ring = np.array([w.start for w in out])
    return (out, moved) if moved == 0 or (is_simple(ring) and abs(signed_area(ring)) >= 1e-3) else (list(walls), 0)


def refine(points: DataFrame, ring: np.ndarray, floor_z: float, ceiling_z: float, least: float = 0.10) -> list[Wall]:
    """The ring's walls fitted to the cloud, turned, joined, met and held; empty where the cloud has no points for it."""
    band = band_between(points, floor_z, ceiling_z)
    segments = edges(ring)
    if len(segments) < 3 or band.limit(100).count() < 100:
        return []
    walls = cornered(joined(turned(fitted(band, segments), points.sparkSession)))
    return [w for w in held(walls)[0] if w.length >= least]
