"""Layouts of several passes over scenes made one, written as lines or drawn into a cloud.

items: scan_id, layout_id, line_idx, kind, idx, cls, v, the rows of layout.parse with the scene they are of.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import layout

# Colours of drawn classes, of 255, and of what has none.
CLASS_COLORS = {
    "sofa": (255, 140, 0), "chair": (0, 200, 0), "dining_chair": (0, 255, 0), "dining_table": (184, 134, 11), "coffee_table": (139, 69, 19), "side_table": (160, 82, 45), "desk": (210, 105, 30),
    "bed": (218, 165, 32), "tv": (186, 85, 211), "tv_cabinet": (20, 20, 20), "curtain": (0, 255, 255), "mirror": (255, 255, 255), "painting": (255, 192, 203), "plants": (34, 139, 34),
    "floor-standing_lamp": (255, 255, 0), "chandelier": (255, 255, 100), "wall_decoration": (255, 105, 180), "cupboard": (0, 128, 255), "shelf": (139, 0, 139), "bar": (255, 215, 0), "carpet": (128, 128, 128),
}
KIND_COLORS = {"wall": (0, 0, 0), "door": (255, 0, 0), "window": (0, 0, 255)}
OTHER_COLOR = (255, 0, 255)


def distinct_boxes(items: DataFrame, radius: float) -> DataFrame:
    """The boxes of items, of each scene, layout and class the first within radius of one another."""
    boxes = items.where("kind = 'bbox'").withColumns({"x": F.col("v")[0], "y": F.col("v")[1], "z": F.col("v")[2]})
    keys = ["scan_id", "layout_id", "cls"]
    kept = layout.greedy_dedup(boxes, *keys, order="line_idx", r=radius).select(*keys, "line_idx")
    return boxes.join(kept, [*keys, "line_idx"]).select(*items.columns)


def sure(items: DataFrame, conf: DataFrame | None, least: dict[str, float] | None) -> DataFrame:
    """Items of the kinds in least whose confidence in conf(scan_id, layout_id, kind, idx, logprob) is absent or at least
    that; all of other kinds."""
    if conf is None or not least:
        return items
    wanted = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])
    return items.join(conf, ["scan_id", "layout_id", "kind", "idx"], "left").where(F.col("logprob").isNull() | wanted[F.col("kind")].isNull() | (F.col("logprob") >= wanted[F.col("kind")])).select(*items.columns)


def _written(parts: list[DataFrame]) -> DataFrame:
    """scan_id, line_idx, line of the parts (scan_id, line_idx, kind, cls, v), one layout a scene."""
    whole = reduce(DataFrame.unionByName, parts)
    return layout.write(whole.withColumnRenamed("scan_id", "layout_id")).withColumnRenamed("layout_id", "scan_id")


_COLUMNS = ("scan_id", "line_idx", "kind", "cls", "v")


def _numbered(found: DataFrame, kind: str | None = None) -> DataFrame:
    """Voted elements in an order of their own: by class and place, as they have no line any more."""
    rows = found.withColumns({c: e for c, e in (("kind", F.lit(kind)), ("cls", F.lit(None).cast("string"))) if c not in found.columns})
    return rows.withColumn("line_idx", F.struct(F.coalesce("cls", F.lit("")), "v")).select(*_COLUMNS)


def _placed(parts: list[DataFrame]) -> list[DataFrame]:
    """Parts with one type of line_idx, an order within their kind."""
    from pyspark.sql import Window

    w = Window.partitionBy("scan_id", "kind").orderBy("line_idx")
    return [p.withColumn("line_idx", F.row_number().over(w)).select(*_COLUMNS) for p in parts]


def merge(structure: DataFrame, objects: DataFrame, radius: float = 0.20, conf: DataFrame | None = None, least: dict[str, float] | None = None) -> DataFrame:
    """Walls, doors and windows of structure, and the distinct boxes of objects: scan_id, line_idx, line."""
    fixed = sure(structure.where("kind <> 'bbox'"), conf, least)
    boxes = distinct_boxes(sure(objects, conf, least), radius)
    return _written(_placed([fixed.select(*_COLUMNS), boxes.select(*_COLUMNS)]))


def voted_boxes(objects: DataFrame, aliases: DataFrame, radius: float = 0.30, votes: int = 2, conf: DataFrame | None = None, least: dict[str, float] | None = None) -> DataFrame:
    """scan_id, cls, v of boxes that `votes` layouts agree on; each layout's own repeats, and overlaps at last, made one."""
    agreed = layout.consensus_boxes(distinct_boxes(sure(objects, conf, least), 0.15), aliases, radius, votes)
    return layout.merge_overlaps(_ordered(agreed)).select("scan_id", "cls", "v")


def _ordered(boxes: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return boxes.withColumn("line_idx", F.row_number().over(Window.partitionBy("scan_id", "cls").orderBy("v")))


def merge_consensus(structure: DataFrame, objects: DataFrame, aliases: DataFrame, radius: float = 0.30, votes: int = 2, conf: DataFrame | None = None, least: dict[str, float] | None = None) -> DataFrame:
    """As merge, with the boxes that `votes` passes over a scene agree on."""
    fixed = sure(structure.where("kind <> 'bbox'"), conf, least)
    boxes = _numbered(voted_boxes(objects, aliases, radius, votes, conf, least), "bbox")
    return _written(_placed([fixed.select(*_COLUMNS), boxes]))


def merge_full_consensus(structures: DataFrame, objects: DataFrame, aliases: DataFrame, struct_votes: int = 2, object_votes: int = 2, radius: float = 0.30) -> DataFrame:
    """Walls, doors, windows and boxes that several passes agree on: scan_id, line_idx, line."""
    walls = layout.consensus_walls(structures.where("kind = 'wall'"), votes=struct_votes)
    openings = layout.consensus_openings(structures.where("kind IN ('door', 'window')"), votes=struct_votes)
    boxes = voted_boxes(objects, aliases, radius, object_votes)
    return _written(_placed([_numbered(walls, "wall"), _numbered(openings), _numbered(boxes, "bbox")]))


def drawn(items: DataFrame, spacing: float = 0.02, half: float = 0.10) -> DataFrame:
    """scan_id, x, y, z, r, g, b (0 to 1) of points along boxes' edges, walls' floor lines, and crosses at doors and
    windows, in the colours of their classes or kinds."""
    part = lambda k: items.where(F.col("kind") == k)
    key = F.struct("scan_id", "cls", "line_idx")
    boxes = part("bbox").select(key.alias("box_id"), *[F.col("v")[i].alias(c) for i, c in enumerate(("x", "y", "z", "yaw", "sx", "sy", "sz"))])
    edges = layout.densify(layout.box_edges(boxes), spacing, "box_id", "edge").select("box_id.scan_id", F.col("box_id.cls").alias("cls"), F.lit("bbox").alias("kind"), "x", "y", "z")
    end = lambda i: F.struct(*[F.col("v")[i + j].alias(c) for j, c in enumerate("xyz")])
    lines = layout.densify(part("wall").select("scan_id", end(0).alias("a"), end(3).alias("b")), spacing, "scan_id").select("scan_id", F.lit(None).cast("string").alias("cls"), F.lit("wall").alias("kind"), "x", "y", "z")
    marks = items.where("kind IN ('door', 'window')").select(F.struct("scan_id", "kind", "line_idx").alias("mark_id"), *[F.col("v")[i].alias(c) for i, c in enumerate("xyz")])
    crosses = layout.crosses(marks, half, spacing).select("mark_id.scan_id", F.lit(None).cast("string").alias("cls"), F.col("mark_id.kind").alias("kind"), "x", "y", "z")
    rows = [("bbox", c, *rgb) for c, rgb in CLASS_COLORS.items()] + [(k, None, *rgb) for k, rgb in KIND_COLORS.items()]
    colors = items.sparkSession.createDataFrame(rows, "of_kind string, of_cls string, r int, g int, b int")  # CLASS_COLORS and KIND_COLORS
    points = edges.unionByName(lines).unionByName(crosses)
    colored = points.join(F.broadcast(colors), (F.col("kind") == F.col("of_kind")) & F.col("cls").eqNullSafe(F.col("of_cls")), "left")
    return colored.select("scan_id", "x", "y", "z", *[(F.coalesce(F.col(c), F.lit(o)) / 255.0).alias(c) for c, o in zip("rgb", OTHER_COLOR)])


def embed(cloud: DataFrame, items: DataFrame, spacing: float = 0.02) -> DataFrame:
    """cloud(scan_id, x, y, z, r, g, b) and the drawn items of its scenes."""
    return cloud.select("scan_id", "x", "y", "z", "r", "g", "b").unionByName(drawn(items, spacing))
