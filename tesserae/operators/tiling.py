"""The patch grid, assignment to patches, spatial joins and rasters of polygons and pixels."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.functions.geometry import box_ring, is_box, ring_edges, ring_strips, rings_meet, strip_crossings, strip_spans
from tesserae.operators.planes import PLANE, each_patch, pixels_where

BOUNDS = ("xmin", "ymin", "xmax", "ymax")


@dataclass(frozen=True)
class Grid:
    """Squares of ``width`` that overlap by ``overlap`` over [x0, x1] x [y0, y1]. Edge patches overhang."""

    x0: float
    y0: float
    x1: float
    y1: float
    width: float
    overlap: float

    @property
    def step(self) -> float:
        return self.width - self.overlap

    def count(self, low: float, high: float) -> int:
        return max(1, math.ceil((high - low - self.overlap) / self.step))

    @property
    def nx(self) -> int:
        return self.count(self.x0, self.x1)

    @property
    def ny(self) -> int:
        return self.count(self.y0, self.y1)


def patch_grid(spark: SparkSession, grid: Grid) -> DataFrame:
    """patch_id (row by row), ix, iy, bounds and ring of every patch."""
    ix, iy = F.col("id") % grid.nx, F.floor(F.col("id") / grid.nx)
    out = spark.range(grid.nx * grid.ny).select(F.col("id").cast("int").alias("patch_id"), ix.cast("int").alias("ix"), iy.cast("int").alias("iy"))
    return out.withColumns(
        {"xmin": grid.x0 + F.col("ix") * float(grid.step), "ymin": grid.y0 + F.col("iy") * float(grid.step)}
    ).withColumns({"xmax": F.col("xmin") + float(grid.width), "ymax": F.col("ymin") + float(grid.width)})


def affine_transform(df: DataFrame, a: float, b: float, c: float, d: float, e: float, f: float) -> DataFrame:
    """x' = a x + b y + c, y' = d x + e y + f, for points (x, y) and for rings (ring)."""
    move = lambda x, y: ((a * x + b * y + c).alias("x"), (d * x + e * y + f).alias("y"))
    if "ring" in df.columns:
        return df.withColumn("ring", F.transform("ring", lambda p: F.struct(*move(p["x"], p["y"]))))
    x, y = move(F.col("x"), F.col("y"))
    return df.withColumns({"x": x, "y": y})


def _covering(value: Column, origin: float, grid: Grid, count: int) -> tuple[Column, Column]:
    """First and last place along one axis of the patches whose closed side holds the value."""
    low = F.ceil((value - origin - grid.width) / float(grid.step))
    high = F.floor((value - origin) / float(grid.step))
    return F.greatest(low, F.lit(0)), F.least(high, F.lit(count - 1))


def assign_points_to_patches(points: DataFrame, grid: Grid) -> DataFrame:
    """A row for each point and each patch whose closed square holds it. No join: the patches follow from the
    coordinates, so this is a narrow map, on streams too."""
    (xl, xh), (yl, yh) = _covering(F.col("x"), grid.x0, grid, grid.nx), _covering(F.col("y"), grid.y0, grid, grid.ny)
    inside = points.withColumns({"_xl": xl, "_xh": xh, "_yl": yl, "_yh": yh}).where("_xl <= _xh AND _yl <= _yh")
    wide = inside.withColumn("_ix", F.explode(F.sequence("_xl", "_xh"))).withColumn("_iy", F.explode(F.sequence("_yl", "_yh")))
    return wide.select((F.col("_iy") * grid.nx + F.col("_ix")).cast("int").alias("patch_id"), *points.columns)


def patch_point_counts(assigned: DataFrame, patches: DataFrame) -> DataFrame:
    """Points of every patch; empty patches have 0."""
    counts = assigned.groupBy("patch_id").agg(F.count(F.lit(1)).alias("n_points"))
    return patches.select("patch_id").join(counts, "patch_id", "left").select("patch_id", F.coalesce("n_points", F.lit(0)).alias("n_points"))


def patches_with_min_points(counts: DataFrame, least: int) -> DataFrame:
    return counts.where(F.col("n_points") >= least)


def points_in_box(points: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Closed box. The comparisons are on plain columns, so they reach the scan."""
    return points.where(F.col("x").between(xmin, xmax) & F.col("y").between(ymin, ymax))


def _meets_box(shapes: DataFrame, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Whether a shape whose bounding box meets a box meets it itself. Boxes do, so only other rings are looked at."""
    if "ring" not in shapes.columns:
        return F.lit(True)
    return is_box(F.col("ring"), *(F.col(c) for c in BOUNDS)) | rings_meet(F.col("ring"), box_ring(xmin, ymin, xmax, ymax))


def shapes_in_box(shapes: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Shapes that meet the closed box: their bounding boxes do (plain comparisons, which reach the scan), and so do their
    rings. Shapes without rings are their bounding boxes."""
    near = shapes.where((F.col("xmin") <= xmax) & (F.col("xmax") >= xmin) & (F.col("ymin") <= ymax) & (F.col("ymax") >= ymin))
    return near.where(_meets_box(shapes, *(F.lit(float(v)) for v in (xmin, ymin, xmax, ymax))))


def _level(size: float) -> Column:
    """The level of a shape's own size: at level k grid cells are ``size`` 2^k wide, and its box is no wider than one."""
    side = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(side, F.lit(size)) / size))).cast("int")


def _buckets(df: DataFrame, size: float, levels: list[int], prefix: str) -> DataFrame:
    """A row for each grid cell that a shape's box touches at its own level and at those of larger shapes: four a level at most."""
    renamed = df.select(*(F.col(c).alias(prefix + c) for c in df.columns), _level(size).alias(f"_{prefix}level"), *(F.col(c).alias(f"_{c}") for c in BOUNDS))
    wide = renamed.withColumn("_level", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda k: k >= F.col(f"_{prefix}level"))))
    cell = F.lit(float(size)) * F.pow(F.lit(2.0), F.col("_level"))
    for axis in ("x", "y"):
        wide = wide.withColumn(f"_b{axis}", F.explode(F.sequence(F.floor(F.col(f"_{axis}min") / cell), F.floor(F.col(f"_{axis}max") / cell))))
    return wide.drop(*(f"_{c}" for c in BOUNDS))


def spatial_join(left: DataFrame, right: DataFrame, size: float = 32.0) -> DataFrame:
    """Pairs of shapes that meet (closed); columns get the prefixes l_ and r_.

    Shapes live in a grid of the level of their own size, so a shape of any size is in four cells at most. Those of two levels
    meet in cells of the larger one's, to which the smaller one goes too; only levels that occur are used. A pair is kept only in
    the cell that holds the lower corner of the boxes' intersection, so no pair comes twice and none is shuffled to find out.
    Rings are compared exactly unless both are boxes. A ring that follows from its bounds is not sent along.
    """
    ringed = all(dict(df.dtypes).get("ring") == "array<struct<x:double,y:double>>" for df in (left, right))
    if ringed:
        left, right = (df.where("ring IS NOT NULL").withColumn("ring", F.when(F.col("ring") != box_ring(*map(F.col, BOUNDS)), F.col("ring"))) for df in (left, right))
    own = left.select(_level(size).alias("k")).unionByName(right.select(_level(size).alias("k")))
    # a number for each doubling of the size
    levels = sorted(r["k"] for r in own.where("k IS NOT NULL").distinct().collect())
    a, b = _buckets(left, size, levels, "l_"), _buckets(right, size, levels, "r_")
    meet = (F.col("l_xmin") <= F.col("r_xmax")) & (F.col("r_xmin") <= F.col("l_xmax")) & (F.col("l_ymin") <= F.col("r_ymax")) & (F.col("r_ymin") <= F.col("l_ymax"))
    cell = F.lit(float(size)) * F.pow(F.lit(2.0), F.col("_level"))
    first = (F.col("_bx") == F.floor(F.greatest("l_xmin", "r_xmin") / cell)) & (F.col("_by") == F.floor(F.greatest("l_ymin", "r_ymin") / cell))
    # the planner takes the cells for as small as the files of their shapes, and would send all of one side through the driver
    met = a.hint("merge").join(b, ["_level", "_bx", "_by"]).where((F.col("_level") == F.greatest("_l_level", "_r_level")) & meet & first)
    pairs = met.drop("_level", "_bx", "_by", "_l_level", "_r_level")
    if "ring" not in left.columns or "ring" not in right.columns:
        return pairs
    box = lambda s: is_box(F.col(f"{s}ring"), *(F.col(s + c) for c in BOUNDS))
    if ringed:
        whole = {f"{s}ring": F.coalesce(f"{s}ring", box_ring(*(F.col(s + c) for c in BOUNDS))) for s in ("l_", "r_")}
        plain = lambda s: F.col(f"{s}ring").isNull() | box(s)
        return pairs.where((plain("l_") & plain("r_")) | rings_meet(*whole.values())).withColumns(whole)
    return pairs.where((box("l_") & box("r_")) | rings_meet(F.col("l_ring"), F.col("r_ring")))


def shapes_of_patches(shapes: DataFrame, grid: Grid) -> DataFrame:
    """A row for each shape and patch whose closed square it meets; join-free as for points."""
    (xl, _), (_, xh) = _covering(F.col("xmin"), grid.x0, grid, grid.nx), _covering(F.col("xmax"), grid.x0, grid, grid.nx)
    (yl, _), (_, yh) = _covering(F.col("ymin"), grid.y0, grid, grid.ny), _covering(F.col("ymax"), grid.y0, grid, grid.ny)
    inside = shapes.withColumns({"_xl": xl, "_xh": xh, "_yl": yl, "_yh": yh}).where("_xl <= _xh AND _yl <= _yh")
    wide = inside.withColumn("_ix", F.explode(F.sequence("_xl", "_xh"))).withColumn("_iy", F.explode(F.sequence("_yl", "_yh")))
    px, py = grid.x0 + F.col("_ix") * float(grid.step), grid.y0 + F.col("_iy") * float(grid.step)
    wide = wide.where(_meets_box(shapes, px, py, px + float(grid.width), py + float(grid.width)))
    return wide.select((F.col("_iy") * grid.nx + F.col("_ix")).cast("int").alias("patch_id"), *shapes.columns)


def valid_patches(patches: DataFrame, counts: DataFrame, shapes: DataFrame | None, grid: Grid, x_max: float, y_max: float, min_cells: int, min_points: int, check_border: bool = True) -> DataFrame:
    """Patches inside the image with enough points and, if shapes are given, enough shapes."""
    out = patches
    if check_border:
        out = out.where((F.floor("xmax") <= x_max) & (F.floor("ymax") <= y_max))
    if min_points > 0:
        out = out.join(patches_with_min_points(counts, min_points).select("patch_id"), "patch_id", "left_semi")
    if shapes is not None and min_cells > 0:
        cells = shapes_of_patches(shapes, grid).groupBy("patch_id").agg(F.count(F.lit(1)).alias("n_cells")).where(F.col("n_cells") >= min_cells)
        out = out.join(cells.select("patch_id"), "patch_id", "left_semi")
    return out


def patches_hit_by(grid: Grid, annotations: DataFrame) -> DataFrame:
    return shapes_of_patches(annotations, grid).select("patch_id").distinct()


def exclude_patches(patches: DataFrame, ids: DataFrame) -> DataFrame:
    return patches.join(ids.select("patch_id"), "patch_id", "left_anti")


def _origin(grid: Grid) -> tuple[Column, Column]:
    """A patch's first pixel row and column, from patch_id."""
    return F.floor(grid.y0 + F.floor(F.col("patch_id") / grid.nx) * float(grid.step)).cast("int"), F.floor(grid.x0 + F.col("patch_id") % grid.nx * float(grid.step)).cast("int")


def crop_labels(shapes: DataFrame, grid: Grid, key: str) -> DataFrame:
    """Shapes of each patch with their label: the rank of the key among them, from 1."""
    return shapes_of_patches(shapes, grid).withColumn("label", F.row_number().over(W.partitionBy("patch_id").orderBy(key)))


def polygon_spans(shapes: DataFrame, grid: Grid, key: str, boxes: bool = True) -> DataFrame:
    """patch_id, label, y0, y1, x0, x1: rectangles of pixels (ends included) that make up the pixels that a shape touches in a patch.
    boxes: the shapes are axis-parallel boxes, whose pixels are plain arithmetic. Others are simple polygons, cut into strips."""
    oy, ox = _origin(grid)
    side = int(grid.width)
    labelled = crop_labels(shapes, grid, key)
    if boxes:
        spans = labelled.select(
            "patch_id",
            "label",
            F.greatest(F.floor("ymin") - oy, F.lit(0)).alias("y0"),
            F.least(F.ceil("ymax") - 1 - oy, F.lit(side - 1)).alias("y1"),
            F.greatest(F.floor("xmin") - ox, F.lit(0)).alias("x0"),
            F.least(F.ceil("xmax") - 1 - ox, F.lit(side - 1)).alias("x1"),
        )
        return spans.where("y0 <= y1 AND x0 <= x1")
    # row by row of pixels, and between corners within a row: plain columns, no shuffle
    strips = labelled.select("patch_id", "label", oy.alias("oy"), ox.alias("ox"), ring_edges(F.col("ring")).alias("edges"), F.explode(ring_strips(F.col("ring"), oy, oy + side)).alias("s"))
    crossed = strips.select("patch_id", "label", "ox", (F.floor("s.low") - F.col("oy")).alias("y"), strip_crossings(F.col("edges"), F.col("s.low"), F.col("s.high")).alias("at"))
    spans = crossed.select("patch_id", "label", "ox", "y", F.explode(strip_spans(F.col("at"))).alias("s"))
    x0, x1 = F.greatest(F.col("s.first") - F.col("ox"), F.lit(0)), F.least(F.col("s.last") - F.col("ox"), F.lit(side - 1))
    return spans.select("patch_id", "label", F.col("y").alias("y0"), F.col("y").alias("y1"), x0.alias("x0"), x1.alias("x1")).where("x0 <= x1")


def rasterize_polygons(shapes: DataFrame, grid: Grid, key: str, boxes: bool = True) -> DataFrame:
    """patch_id, y, x, label of every pixel that a shape touches; the shape with the larger key covers others. Boxes are painted patch
    by patch, so their pixels are not shuffled; rings, and boxes on planes too large for one place, meet pixel by pixel."""
    side = int(grid.width)
    spans = polygon_spans(shapes, grid, key, boxes)
    if boxes and side * side <= PLANE:
        return each_patch([spans], side, lambda label: pixels_where(label > 0, label), {"y": "int", "x": "int", "label": "int"})
    pixels = spans.withColumn("y", F.explode(F.sequence("y0", "y1"))).withColumn("x", F.explode(F.sequence("x0", "x1")))
    return pixels.groupBy("patch_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).agg(F.max("label").alias("label"))


def crop_pixels(pixels: DataFrame, xmin: int, ymin: int, xmax: int, ymax: int, channels: list[str]) -> DataFrame:
    """Half-open box of the chosen channels, with each channel's place in the request (rank)."""
    rank = F.array_position(F.array(*map(F.lit, channels)), F.col("channel")) - 1
    chosen = pixels.where(F.col("channel").isin(channels) & (F.col("x") >= xmin) & (F.col("x") < xmax) & (F.col("y") >= ymin) & (F.col("y") < ymax))
    return chosen.select(rank.cast("int").alias("rank"), "channel", (F.col("y") - ymin).alias("y"), (F.col("x") - xmin).alias("x"), "value")


def dense_grid(keys: DataFrame, height: int, width: int) -> DataFrame:
    """Every pixel of every key."""
    wide = keys.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    return wide.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))


def pad_to_shape(pixels: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """Zeros at the bottom and right, up to height x width for each key."""
    grid = dense_grid(pixels.select(*keys).distinct(), height, width)
    return grid.join(pixels, [*keys, "y", "x"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def resize_nearest(pixels: DataFrame, keys: list[str], src: tuple[int, int], dst: tuple[int, int]) -> DataFrame:
    """out(y, x) = in(floor(y src / dst)): each source pixel goes to the destinations that read it, so no join."""

    def span(c: str, s: int, d: int) -> Column:
        at = F.col(c).cast("long")
        first, last = F.ceil(at * F.lit(d).cast("long") / s), F.ceil((at + 1) * F.lit(d).cast("long") / s) - 1
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    wide = pixels.withColumn("y", F.explode(span("y", src[0], dst[0]))).withColumn("x", F.explode(span("x", src[1], dst[1])))
    return wide.select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "value")


def translate_shapes(shapes: DataFrame, grid: Grid) -> DataFrame:
    """Rings from a patch's frame to the slide's."""
    oy, ox = _origin(grid)
    moved = F.transform("ring", lambda p: F.struct((p["x"] + ox).alias("x"), (p["y"] + oy).alias("y")))
    return shapes.withColumn("ring", moved)


def boxes(df: DataFrame, key: str) -> DataFrame:
    """key, bounds and ring of shapes given by centre (cx, cy) and half sides (hw, hh)."""
    out = df.select(key, (F.col("cx") - F.col("hw")).alias("xmin"), (F.col("cy") - F.col("hh")).alias("ymin"), (F.col("cx") + F.col("hw")).alias("xmax"), (F.col("cy") + F.col("hh")).alias("ymax"))
    return out.withColumn("ring", box_ring(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax")))
