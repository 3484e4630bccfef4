"""Layout text of detected objects: parse, filter by confidence, merge over layouts, write, draw as points."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The line grammar.
_NUM = r"[-0-9.,eE+]+"
_LINE = {
    "wall": rf"^wall_(\d+)=Wall\(()({_NUM})\)$",
    "door": rf"^door_(\d+)=Door\((wall_\d+),({_NUM})\)$",
    "window": rf"^window_(\d+)=Window\((wall_\d+),({_NUM})\)$",
    "bbox": rf"^bbox_(\d+)=Bbox\(([A-Za-z_ ]+),({_NUM})\)$",
}


def parse(lines: DataFrame) -> DataFrame:
    """lines(layout_id, line_idx, line) -> layout_id, line_idx, kind, idx, cls, v; other lines are skipped."""
    text = F.trim("line")
    kind = F.regexp_extract(text, r"^([a-z]+)_\d+=", 1)
    pick = lambda g: F.coalesce(*[F.when(F.col("kind") == k, F.regexp_extract(text, p, g)) for k, p in _LINE.items()])
    p = lines.withColumn("kind", kind).where(F.col("kind").isin(*_LINE)).withColumns({"idx": pick(1), "cls": pick(2), "_v": pick(3)}).where("idx <> ''")
    return p.select("layout_id", "line_idx", "kind", F.col("idx").cast("int").alias("idx"), F.nullif("cls", F.lit("")).alias("cls"), F.transform(F.split("_v", ","), lambda x: x.cast("double")).alias("v"))


def write(items: DataFrame, places: int | None = None) -> DataFrame:
    """items(layout_id, line_idx, kind, cls, v) -> lines with ids counted up within each kind; numbers as short as they
    read back, or with fixed places."""
    order = F.expr("array_position(array('wall', 'door', 'window', 'bbox'), kind)")
    w = Window.partitionBy("layout_id", "kind").orderBy("line_idx")
    n = items.withColumn("n", F.row_number().over(w) - 1)
    name = F.initcap("kind")
    first = F.when(F.col("kind").isin("door", "window"), F.lit("wall_0,")).when(F.col("kind") == "bbox", F.concat("cls", F.lit(","))).otherwise("")
    line = F.concat("kind", F.lit("_"), F.col("n").cast("string"), F.lit("="), name, F.lit("("), first, F.array_join(F.transform("v", lambda x: x.cast("string") if places is None else F.format_string(f"%.{places}f", x)), ","), F.lit(")"))
    return n.select("layout_id", F.row_number().over(Window.partitionBy("layout_id").orderBy(order, "n")).alias("line_idx"), line.alias("line"))


def confidences(sidecars: DataFrame) -> DataFrame:
    """sidecars(layout_id, json) -> layout_id, kind, idx, logprob; bare numbers are boxes."""
    m = sidecars.select("layout_id", F.explode(F.from_json("json", "map<string,double>")).alias("k", "logprob"))
    kind = F.regexp_extract("k", r"^([a-z]+)_\d+$", 1)
    return m.select("layout_id", F.when(F.col("k").rlike(r"^\d+$"), "bbox").otherwise(kind).alias("kind"), F.regexp_extract("k", r"(\d+)$", 1).cast("int").alias("idx"), "logprob")


def confidence_filter(items: DataFrame, conf: DataFrame, least: float) -> DataFrame:
    """Items whose confidence is absent or at least `least`."""
    return items.join(conf, ["layout_id", "kind", "idx"], "left").where(F.col("logprob").isNull() | (F.col("logprob") >= least)).drop("logprob")


def with_alias(items: DataFrame, aliases: DataFrame) -> DataFrame:
    """items(cls) with the group and rank of aliases(cls, grp, rank); classes without one are their own group."""
    return items.join(aliases, "cls", "left").withColumn("grp", F.coalesce("grp", "cls")).withColumn("rank", F.coalesce("rank", F.lit(0)))


def greedy_dedup(items: DataFrame, *keys: str, order: str = "line_idx", r: float = 0.20) -> DataFrame:
    """Per keys, in order: an item is kept if none kept before is nearer than r. An item list is one scene's."""
    item = F.struct(F.col(order).alias("o"), F.col("x"), F.col("y"), F.col("z"))
    lists = items.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("a"))
    d2 = lambda p, q: (p["x"] - q["x"]) ** 2 + (p["y"] - q["y"]) ** 2 + (p["z"] - q["z"]) ** 2
    kind = lists.schema["a"].dataType.simpleString()
    kept = F.aggregate("a", F.expr(f"cast(array() as {kind})"), lambda acc, p: F.when(F.exists(acc, lambda q: d2(p, q) < r * r), acc).otherwise(F.array_append(acc, p)))
    return lists.select(*keys, F.inline(kept)).withColumnRenamed("o", order)


def vote_median(items: DataFrame, cluster: str, layout: str, votes: int, *values: str) -> DataFrame:
    """Clusters seen in at least `votes` layouts, with the median of each value."""
    g = items.groupBy(cluster).agg(F.count_distinct(layout).alias("votes"), *[F.median(v).alias(v) for v in values])
    return g.where(F.col("votes") >= votes)


def _consensus_kernel(rows: list[dict], near, votes: int) -> list[dict]:
    """Greedy clusters in order of (layout, line): an item joins the nearest cluster that has none of its layout."""
    clusters: list[dict] = []
    for r in sorted(rows, key=lambda r: (r["layout_id"], r["line_idx"])):
        best, least = None, math.inf
        for c in clusters:
            if r["layout_id"] not in c["layouts"] and (d := near(c, r)) is not None and d < least:
                best, least = c, d
        if best is None:
            clusters.append({"layouts": {r["layout_id"]}, "rows": [r]})
        else:
            best["layouts"].add(r["layout_id"])
            best["rows"].append(r)
    return [c for c in clusters if len(c["layouts"]) >= votes]


def consensus_boxes(items: DataFrame, aliases: DataFrame, r: float = 0.30, votes: int = 2) -> DataFrame:
    """items(scan_id, layout_id, line_idx, cls, v = x, y, z, yaw, sx, sy, sz) -> scan_id, cls, votes, v: nearest
    cluster by running mean centre within r, of one alias group; medians; the most specific name."""

    def near(c, row):
        d = float(np.linalg.norm(np.mean([q["v"][:3] for q in c["rows"]], axis=0) - np.array(row["v"][:3])))
        return d if d < r else None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for c in _consensus_kernel(pdf.to_dict("records"), near, votes):
            name = min(c["rows"], key=lambda q: q["rank"])["cls"]
            out.append([pdf.scan_id.iloc[0], name, len(c["layouts"]), np.median([q["v"] for q in c["rows"]], axis=0).tolist()])
        return pd.DataFrame(out, columns=["scan_id", "cls", "votes", "v"])

    return with_alias(items, aliases).groupBy("scan_id", "grp").applyInPandas(run, "scan_id long, cls string, votes long, v array<double>")


def consensus_walls(items: DataFrame, tolerance: float = 0.40, votes: int = 2) -> DataFrame:
    """items(scan_id, layout_id, line_idx, v = ax, ay, az, bx, by, bz, height, thickness): endpoints rounded to 3
    places and ordered; nearest cluster by the founder's endpoints, the better of both pairings."""

    def ends(v):
        return sorted([tuple(round(x, 3) for x in v[:3]), tuple(round(x, 3) for x in v[3:6])])

    def near(c, row):
        p, q = ends(c["rows"][0]["v"]), ends(row["v"])
        d = min(max(math.dist(p[0], q[0]), math.dist(p[1], q[1])), max(math.dist(p[0], q[1]), math.dist(p[1], q[0])))
        return d if d < tolerance else None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for c in _consensus_kernel(pdf.to_dict("records"), near, votes):
            p = ends(c["rows"][0]["v"])
            same = []
            for q in c["rows"]:
                e = ends(q["v"])
                if max(math.dist(p[0], e[1]), math.dist(p[1], e[0])) < max(math.dist(p[0], e[0]), math.dist(p[1], e[1])):
                    e = e[::-1]
                same.append([*e[0], *e[1], *q["v"][6:]])
            out.append([pdf.scan_id.iloc[0], len(c["layouts"]), np.median(same, axis=0).tolist()])
        return pd.DataFrame(out, columns=["scan_id", "votes", "v"])

    return items.groupBy("scan_id").applyInPandas(run, "scan_id long, votes long, v array<double>")


def consensus_openings(items: DataFrame, tolerance: float = 0.35, votes: int = 2) -> DataFrame:
    """items(scan_id, layout_id, line_idx, kind, v = x, y, z, width, height): by running mean centre."""

    def near(c, row):
        d = float(np.linalg.norm(np.mean([q["v"][:3] for q in c["rows"]], axis=0) - np.array(row["v"][:3])))
        return d if d < tolerance else None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [[pdf.scan_id.iloc[0], pdf.kind.iloc[0], len(c["layouts"]), np.median([q["v"] for q in c["rows"]], axis=0).tolist()] for c in _consensus_kernel(pdf.to_dict("records"), near, votes)]
        return pd.DataFrame(out, columns=["scan_id", "kind", "votes", "v"])

    return items.groupBy("scan_id", "kind").applyInPandas(run, "scan_id long, kind string, votes long, v array<double>")


def footprint(v) -> np.ndarray:
    x, y, yaw, sx, sy = v[0], v[1], v[3], v[4], v[5]
    c, s = math.cos(yaw), math.sin(yaw)
    return np.array([(x + c * a * sx / 2 - s * b * sy / 2, y + s * a * sx / 2 + c * b * sy / 2) for a, b in ((1, 1), (-1, 1), (-1, -1), (1, -1))])


def _area(p: np.ndarray) -> float:
    return 0.5 * abs(float(np.dot(p[:, 0], np.roll(p[:, 1], -1)) - np.dot(p[:, 1], np.roll(p[:, 0], -1)))) if len(p) > 2 else 0.0


def footprint_iou(a, b) -> float:
    """Intersection over union of two rotated rectangles, one clipped by the other's edges."""
    p, q = list(map(tuple, footprint(a))), footprint(b)
    for (x1, y1), (x2, y2) in zip(q, np.roll(q, -1, axis=0)):
        side = [(x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) for x, y in p]
        clipped = []
        for (u, du), (w, dw) in zip(zip(p, side), zip(p[1:] + p[:1], side[1:] + side[:1])):
            if du >= 0:
                clipped.append(u)
            if du * dw < 0:
                t = du / (du - dw)
                clipped.append((u[0] + t * (w[0] - u[0]), u[1] + t * (w[1] - u[1])))
        p = clipped
        if not p:
            return 0.0
    inner = _area(np.array(p))
    return inner / (_area(footprint(a)) + _area(q) - inner)


def merge_overlaps(items: DataFrame, iou: float = 0.15, yaw: float = 15.0, ratio: float = 2.5) -> DataFrame:
    """Boxes of one class that overlap, with like yaw and sizes, merged: median centre and size, axial mean yaw."""

    def alike(a, b):
        d = abs(a[3] - b[3]) % math.pi
        if min(d, math.pi - d) > math.radians(yaw) or any(max(a[k], b[k]) > ratio * max(min(a[k], b[k]), 1e-9) for k in (4, 5)):
            return False
        return footprint_iou(a, b) >= iou

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("line_idx")
        v = [list(x) for x in rows.v]
        root = list(range(len(v)))

        def find(i):
            while root[i] != i:
                i = root[i] = root[root[i]]
            return i

        for i in range(len(v)):
            for j in range(i + 1, len(v)):
                if alike(v[i], v[j]):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
        out = []
        for r in sorted({find(i) for i in range(len(v))}):
            own = np.array([v[i] for i in range(len(v)) if find(i) == r])
            m = np.median(own, axis=0)
            if len(own) > 1:
                m[3] = 0.5 * math.atan2(np.sin(2 * own[:, 3]).mean(), np.cos(2 * own[:, 3]).mean())
            out.append([pdf.scan_id.iloc[0], pdf.cls.iloc[0], len(own), m.tolist()])
        return pd.DataFrame(out, columns=["scan_id", "cls", "merged", "v"])

    return items.groupBy("scan_id", "cls").applyInPandas(run, "scan_id long, cls string, merged long, v array<double>")


def axial_mean(yaw: Column) -> Column:
    return F.atan2(F.avg(F.sin(2 * yaw)), F.avg(F.cos(2 * yaw))) / 2


def box_edges(boxes: DataFrame) -> DataFrame:
    """boxes(box_id, x, y, z, yaw, sx, sy, sz) -> the 12 edges: box_id, edge, a, b (structs x, y, z)."""
    signs = [(a, b, c) for c in (-1, 1) for b in (-1, 1) for a in (-1, 1)]
    pairs = [(i, j) for i in range(8) for j in range(i + 1, 8) if bin(i ^ j).count("1") == 1]
    c, s = F.cos("yaw"), F.sin("yaw")
    corner = []
    for a, b, d in signs:
        dx, dy = F.col("sx") * (a / 2), F.col("sy") * (b / 2)
        corner.append(F.struct((F.col("x") + c * dx - s * dy).alias("x"), (F.col("y") + s * dx + c * dy).alias("y"), (F.col("z") + F.col("sz") * (d / 2)).alias("z")))
    edges = F.array(*[F.struct(F.lit(k).alias("edge"), corner[i].alias("a"), corner[j].alias("b")) for k, (i, j) in enumerate(pairs)])
    return boxes.select("box_id", F.inline(edges))


def densify(segments: DataFrame, spacing: float, *keys: str) -> DataFrame:
    """segments(a, b) -> evenly spaced points, both ends included."""
    d = F.sqrt(sum(((F.col(f"b.{c}") - F.col(f"a.{c}")) ** 2 for c in "yz"), (F.col("b.x") - F.col("a.x")) ** 2))
    n = F.greatest(F.lit(2), F.ceil(d / spacing) + 1)
    s = segments.withColumn("_n", n).select(*keys, "a", "b", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("k"))
    t = F.col("k") / (F.col("_n") - 1)
    return s.select(*keys, "k", *[(F.col(f"a.{c}") * (1 - t) + F.col(f"b.{c}") * t).alias(c) for c in "xyz"])


def crosses(points: DataFrame, half: float, spacing: float) -> DataFrame:
    """Three axis-parallel segments around each of points(mark_id, x, y, z), as points."""
    p = lambda k, s: F.struct(*[(F.col(c) + (s * half if i == k else 0.0)).alias(c) for i, c in enumerate("xyz")])
    arms = points.select("mark_id", F.inline(F.array(*[F.struct(F.lit(k).alias("axis"), p(k, -1).alias("a"), p(k, 1).alias("b")) for k in range(3)])))
    return densify(arms, spacing, "mark_id", "axis")
