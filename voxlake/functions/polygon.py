"""Plane geometry of rings and small masks in memory: rings have tens of corners, masks are rooms at a few centimetres."""

from __future__ import annotations

import math

import numpy as np


def signed_area(ring: np.ndarray) -> float:
    x, y = np.asarray(ring, float).T
    return float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2


def meeting(p, d, q, e) -> tuple[float, float] | None:
    """Parameters at which the lines p + s d and q + t e meet, None if they are near parallel."""
    den = d[0] * e[1] - d[1] * e[0]
    if abs(den) < 1e-9 * max(1e-12, math.hypot(*d) * math.hypot(*e)):
        return None
    g = (q[0] - p[0], q[1] - p[1])
    return (g[0] * e[1] - g[1] * e[0]) / den, (g[0] * d[1] - g[1] * d[0]) / den


def is_simple(ring: np.ndarray) -> bool:
    """Whether no two edges meet but neighbours at their corner."""
    n, ring = len(ring), np.asarray(ring, float)
    if n < 3 or abs(signed_area(ring)) < 1e-12:
        return False
    for i in range(n):
        for j in range(i + 2, n):
            if i == 0 and j == n - 1:
                continue
            a, b, c, d = ring[i], ring[(i + 1) % n], ring[j], ring[(j + 1) % n]
            m = meeting(a, b - a, c, d - c)
            if m and -1e-12 <= m[0] <= 1 + 1e-12 and -1e-12 <= m[1] <= 1 + 1e-12:
                return False
    return True


def largest_loop(ring: np.ndarray) -> np.ndarray:
    """A ring as it is if it is simple, else the loop of largest area into which its crossings cut it."""
    ring = np.asarray(ring, float)
    if len(ring) < 3 or is_simple(ring):
        return ring
    walk: list[tuple[float, float]] = []
    n = len(ring)
    for i in range(n):
        a, b = ring[i], ring[(i + 1) % n]
        on = [0.0]
        for j in range(n):
            if j != i and (m := meeting(a, b - a, ring[j], ring[(j + 1) % n] - ring[j])) and 1e-12 < m[0] < 1 - 1e-12 and -1e-12 <= m[1] <= 1 + 1e-12:
                on.append(m[0])
        walk += [tuple(np.round(a + s * (b - a), 9).tolist()) for s in sorted(set(on))]
    best, held, place = ring[:0], [], {}
    for p in [*walk, walk[0]]:
        if p in place:  # back where the walk was: what lies between is a loop
            loop = held[place[p] :]
            if len(loop) > 2 and (not len(best) or abs(signed_area(np.array(loop))) > abs(signed_area(best))):
                best = np.array(loop)
            for q in held[place[p] + 1 :]:
                del place[q]
            held = held[: place[p] + 1]
        else:
            place[p] = len(held)
            held.append(p)
    return best


def buffered(ring, width: float, limit: float = 5.0) -> np.ndarray:
    """The ring with every edge moved outwards by width; corners are prolonged, those beyond limit widths cut square."""
    ring = np.asarray(ring, float)
    ring = ring[np.linalg.norm(ring - np.roll(ring, 1, axis=0), axis=1) > 1e-12]
    if signed_area(ring) < 0:
        ring = ring[::-1]
    along = np.roll(ring, -1, axis=0) - ring
    along /= np.linalg.norm(along, axis=1, keepdims=True)
    out_ = np.stack([along[:, 1], -along[:, 0]], 1) * width  # to the right of a ring that turns left
    made = []
    for i in range(len(ring)):
        d, e, p, q = along[i - 1], along[i], ring[i] + out_[i - 1], ring[i] + out_[i]
        half = out_[i - 1] + out_[i]
        size = float(half @ half)
        if size < 1e-12 * width * width:  # the edge turns back
            made += [p + d * width, q - e * width]
            continue
        tip = ring[i] + half * (2 * width * width / size)
        if np.linalg.norm(tip - ring[i]) <= limit * width:
            made.append(tip)
        else:
            cut = ring[i] + half / math.sqrt(size) * limit * width
            side = np.array([-half[1], half[0]])
            for a, b in ((p, d), (q, e)):
                m = meeting(a, b, cut, side)
                made.append(a + m[0] * b if m else a)
    return largest_loop(np.array(made))


def ellipse(size: int) -> list[tuple[int, int]]:
    """Offsets of a round structuring element of an odd size."""
    c = size // 2
    return [(x, y) for y in range(-c, c + 1) for x in range(-c, c + 1) if abs(x) <= round(c * math.sqrt(max(0.0, 1 - (y / c) ** 2)) if c else 0)]


def _shifted(mask: np.ndarray, reach: int, offsets, fill: bool, join) -> np.ndarray:
    wide = np.pad(mask, reach, constant_values=fill)
    out = None
    for x, y in offsets:
        part = wide[reach + x : reach + x + mask.shape[0], reach + y : reach + y + mask.shape[1]]
        out = part.copy() if out is None else join(out, part, out=out)
    return out


def dilated(mask: np.ndarray, size: int) -> np.ndarray:
    return _shifted(mask, size // 2, ellipse(size), False, np.logical_or)


def eroded(mask: np.ndarray, size: int) -> np.ndarray:
    return _shifted(mask, size // 2, ellipse(size), True, np.logical_and)


def labels(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Numbers of the mask's components, from 1 on in the order of their first cell; 0 outside."""
    number = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    edges = []
    for x, y in steps:
        a = number[: mask.shape[0] - x, max(0, -y) : mask.shape[1] - max(0, y)]
        b = number[x:, max(0, y) : mask.shape[1] - max(0, -y)]
        both = (a > 0) & (b > 0)
        edges.append(np.stack([a[both], b[both]], 1))
    pairs = np.concatenate(edges)
    root = np.arange(mask.size + 1)
    while len(pairs):  # hook larger roots under smaller ones, then shorten all paths
        a, b = root[pairs[:, 0]], root[pairs[:, 1]]
        apart = a != b
        pairs, a, b = pairs[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(shorter := root[root], root):
            root = shorter
    flat = root[number.ravel()]
    kept = np.unique(flat[flat > 0])
    return np.where(flat > 0, np.searchsorted(kept, flat) + 1, 0).reshape(mask.shape)


def filled(mask: np.ndarray) -> np.ndarray:
    """The mask with its holes, background that does not reach the border."""
    wide = np.pad(~mask, 1, constant_values=True)
    found = labels(wide, diagonal=False)
    return ~(found == found[0, 0])[1:-1, 1:-1]


def largest_part(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """The largest component, and how many others there were."""
    found = labels(mask)
    n = int(found.max())
    if not n:
        return mask, 0
    return found == np.bincount(found.ravel())[1:].argmax() + 1, n - 1


_AROUND = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def outline(mask: np.ndarray) -> np.ndarray:
    """Cells of the outer border of the mask's first component, in order around it."""
    cells = np.argwhere(mask)
    if not len(cells):
        return cells
    wide = np.pad(mask, 1)
    start = tuple(cells[0] + 1)
    out, at, came = [start], start, 4  # nothing lies before the first cell of its row
    while True:
        for k in range(1, 9):
            turn = (came + k) % 8
            to = (at[0] + _AROUND[turn][0], at[1] + _AROUND[turn][1])
            if wide[to]:
                break
        else:
            break  # one cell alone
        if at == start and len(out) > 1 and to == out[1]:
            out.pop()
            break
        out.append(to)
        # the next search begins behind the last empty cell looked at
        empty = (at[0] + _AROUND[(turn - 1) % 8][0], at[1] + _AROUND[(turn - 1) % 8][1])
        came = _AROUND.index((empty[0] - to[0], empty[1] - to[1]))
        at = to
    return np.array(out) - 1


def perimeter(ring: np.ndarray) -> float:
    return float(np.linalg.norm(np.roll(ring, -1, axis=0) - ring, axis=1).sum())


def cells_to_metres(cells: np.ndarray, x_min: float, y_min: float, resolution: float) -> np.ndarray:
    """Corners (ix, iy) of a raster in metres."""
    return np.array([x_min, y_min]) + np.asarray(cells, float) * resolution


def contains(ring: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether points are inside, by the parity of crossings to the right."""
    inside = np.zeros(len(x), bool)
    for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, axis=0)):
        if ay != by:
            inside ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return inside


def _summed(a: np.ndarray, size: int) -> np.ndarray:
    """Sums over windows of an odd size, zero beyond the border."""
    r = size // 2
    total = np.pad(a, ((r + 1, r), (r + 1, r))).cumsum(0).cumsum(1)
    return total[size:, size:] - total[:-size, size:] - total[size:, :-size] + total[:-size, :-size]


def corners(mask: np.ndarray, apart: float, most: int = 20, quality: float = 0.02, window: int = 7, reach: float = 8.0) -> np.ndarray | None:
    """Cells at corners of the mask's outline, in the order of their angle about their middle; None for under 3. A corner
    is where the picture of the outline changes in all directions: the lesser eigenvalue of the gradients' moments over a
    window, at least `quality` of the greatest one; the strongest first, none nearer than apart to one taken; those
    farther than reach from the outline are left out."""
    if not mask.any():
        return None
    line = dilated(mask & ~eroded(mask, 3), 3) | (mask & ~eroded(mask, 3))
    wide = np.pad(line.astype(float), 1)
    gx = wide[2:, :-2] + 2 * wide[2:, 1:-1] + wide[2:, 2:] - wide[:-2, :-2] - 2 * wide[:-2, 1:-1] - wide[:-2, 2:]
    gy = wide[:-2, 2:] + 2 * wide[1:-1, 2:] + wide[2:, 2:] - wide[:-2, :-2] - 2 * wide[1:-1, :-2] - wide[2:, :-2]
    xx, xy, yy = (_summed(g, window) for g in (gx * gx, gx * gy, gy * gy))
    strength = (xx + yy) / 2 - np.sqrt(((xx - yy) / 2) ** 2 + xy * xy)
    cells = np.argwhere(strength >= max(quality * strength.max(), 1e-9))
    cells = cells[np.argsort(-strength[tuple(cells.T)], kind="stable")]
    taken: list[np.ndarray] = []
    while len(cells) and len(taken) < most:
        taken.append(cells[0])
        cells = cells[np.linalg.norm(cells - cells[0], axis=1) >= apart]
    border = outline(mask)
    near = np.array([c for c in taken if np.linalg.norm(border - c, axis=1).min() < reach])
    if len(near) < 3:
        return None
    off = near - near.mean(0)
    return near[np.argsort(np.arctan2(off[:, 1], off[:, 0]), kind="stable")]
