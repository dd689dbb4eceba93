"""Segmenting patches with a caller's function, judging the result, and stitching cells of all patches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.geometry import box_corners, box_overlap, box_ring, is_box, outline_of_union, outlines_of_boxes, pixel_rings, polygon_area, rings_overlap, with_bbox
from tesserae.operators.graph import components
from tesserae.operators.planes import each_patch
from tesserae.operators.tiling import BOUNDS, Grid, spatial_join, translate_shapes
from tesserae.sources.tables import durable, read_patch_results, write_layer


#: What segmenters have made in this process, by the call that they are of.
_MADE: dict[str, Callable] = {}


def made_once(name: str, segmenter: Callable[[], Callable]) -> Callable:
    """What the segmenter makes, for all tasks of a call that a worker's process runs; those of earlier calls are let go."""
    if name not in _MADE:
        _MADE.clear()
        _MADE[name] = segmenter()
    return _MADE[name]


def by_size(batch: pd.DataFrame, most: int) -> Iterator[pd.DataFrame]:
    """Runs of rows with ``most`` list elements at most, or one row."""
    lists = [c for c in batch.columns if batch[c].dtype == object and batch[c].map(lambda v: hasattr(v, "__len__")).any()]
    sizes = sum((batch[c].map(lambda v: len(v) if hasattr(v, "__len__") else 1).to_numpy() for c in lists), np.ones(len(batch), np.int64))
    begin, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and held + n > most:
            yield batch.iloc[begin:i]
            begin, held = i, 0
        held += n
    if len(batch) > begin:
        yield batch.iloc[begin:]


def segment_patches(samples: DataFrame, segmenter: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, most: int = 1 << 24) -> DataFrame:
    """Every patch row through a caller's function, which ``segmenter`` makes: once in each worker's process, so a model is loaded
    there and kept for the tasks that follow. A call gets at most ``most`` pixels, or one patch."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segment = made_once(name, segmenter)
        for batch in batches:
            for some in by_size(batch, most):
                yield segment(some)

    return samples.mapInPandas(run, schema)


def masked_flow_loss(pixels: DataFrame) -> DataFrame:
    """Over mask > 0: half the sum of the mean squares of (p - 5 t) in y and x, and the mean cross-entropy of the
    logits p_prob against t_prob > 0.5."""
    square = lambda c: F.avg(F.pow(F.col(f"p_{c}") - 5 * F.col(f"t_{c}"), 2))
    z, t = F.col("p_prob"), (F.col("t_prob") > 0.5).cast("double")
    entropy = F.avg(F.greatest(z, F.lit(0.0)) - z * t + F.log1p(F.exp(-F.abs(z))))
    return pixels.where("mask > 0").agg(((square("y") + square("x")) / 2 + entropy).alias("loss"))


def label_measures(labels: DataFrame) -> DataFrame:
    """patch_id, label, area, bounds and centroid of each label's pixels."""
    return labels.groupBy("patch_id", "label").agg(
        F.count(F.lit(1)).alias("area"),
        F.min("x").alias("xmin"),
        F.min("y").alias("ymin"),
        (F.max("x") + 1).alias("xmax"),
        (F.max("y") + 1).alias("ymax"),
        F.avg(F.col("x") + 0.5).alias("cx"),
        F.avg(F.col("y") + 0.5).alias("cy"),
    )


def labels_to_cells(labels: DataFrame) -> DataFrame:
    """label_measures, and rings: the exact rings of pixel edges around each label, corners only. Outer rings have a positive signed
    area, holes a negative one, so they add up to the area."""
    return label_measures(labels).join(label_rings(labels), ["patch_id", "label"])


POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
RINGS = "array<array<struct<x: double, y: double>>>"


def traced(label: np.ndarray, y: np.ndarray, x: np.ndarray) -> list:
    """The labels in order, their rings, and the largest one of each."""
    label, begins, corners = pixel_rings(label, y, x)
    points = pa.StructArray.from_arrays([pa.array(corners[:, 0]), pa.array(corners[:, 1])], fields=list(POINT))
    rings = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), points)
    after = np.arange(1, len(corners) + 1)
    after[begins[1:] - 1] = begins[:-1]
    (cx, cy), (u, v) = corners.T, corners[after].T
    size = np.abs(np.add.reduceat(cx * v - u * cy, begins[:-1]))
    own = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
    most = np.lexsort((-size, label))[own]
    nested = pa.ListArray.from_arrays(pa.array(np.r_[own, len(label)], pa.int32()), rings)
    return [label[own], nested, rings.take(pa.array(most))]


def label_rings(labels: DataFrame) -> DataFrame:
    """patch_id, label, rings and ring, the largest of them; a patch's labels are traced together."""

    def trace(pixels: pa.Table) -> pa.Table:
        own, rings, ring = traced(*(pixels[c].to_numpy() for c in ("label", "y", "x")))
        patch = pa.array(np.full(len(own), pixels["patch_id"][0].as_py()), pa.int32())
        return pa.Table.from_arrays([patch, pa.array(own, pa.int32()), rings, ring], names=["patch_id", "label", "rings", "ring"])

    return labels.groupBy("patch_id").applyInArrow(trace, f"patch_id int, label int, rings {RINGS}, ring {RINGS[6:-1]}")


MEASURES = {"label": "int", "area": "bigint", "xmin": "int", "ymin": "int", "xmax": "int", "ymax": "int", "cx": "double", "cy": "double"}


def plane_measures(label: np.ndarray) -> list[np.ndarray]:
    """label_measures of a patch's plane."""
    y, x = np.nonzero(label)
    found = label[y, x]
    area = np.bincount(found)
    own = np.flatnonzero(area)
    order = np.argsort(found, kind="stable")
    begins = np.r_[0, np.cumsum(area[own])[:-1]]
    if not len(own):
        return [own] * len(MEASURES)
    ends = [reach.reduceat(v[order], begins) + step for reach, step in ((np.minimum, 0), (np.maximum, 1)) for v in (x, y)]
    return [own, area[own], *ends, *(np.bincount(found, v + 0.5)[own] / area[own] for v in (x, y))]


def measures_of_shapes(shapes: DataFrame, side: int) -> DataFrame:
    """label_measures of spans of shapes (polygon_spans)."""
    return each_patch([shapes], side, plane_measures, MEASURES)


def cells_of_shapes(shapes: DataFrame, side: int) -> DataFrame:
    """labels_to_cells of spans of shapes: a patch is painted, measured and traced in one place."""

    def cells(label: np.ndarray) -> list:
        y, x = np.nonzero(label)
        _, rings, ring = traced(label[y, x], y, x)
        return [*plane_measures(label), rings, ring]

    return each_patch([shapes], side, cells, MEASURES | {"rings": RINGS, "ring": RINGS[6:-1]})


def filter_min_area(cells: DataFrame, least: float) -> DataFrame:
    return cells.where(F.col("area") >= least) if least > 0 else cells


def cell_probability_filter(pixels: DataFrame, least: float = -0.5) -> DataFrame:
    return pixels.where(F.col("p_prob") > least)


def _shapes(cells: DataFrame, boxes: bool) -> DataFrame:
    """Cells as shapes of one cell: group, bounds, area, rings, box (it is its bounding box), fresh (not compared yet)."""
    ring = box_ring(*(F.col(c) for c in BOUNDS)) if boxes else F.col("ring")
    box = F.lit(True) if boxes else is_box(F.col("ring"), *(F.col(c) for c in BOUNDS))
    return cells.select(F.col("cell_id").alias("group"), *BOUNDS, polygon_area(ring).alias("area"), F.array(ring).alias("rings"), box.alias("box"), F.lit(True).alias("fresh"))


def conflicts(shapes: DataFrame, threshold: float = 0.25) -> DataFrame:
    """a < b: shapes (see _shapes), one of them fresh at least, whose overlap is at least ``threshold`` of the smaller one. Bounding
    boxes meet first; rings are fetched by their shapes' keys, for pairs of which one is not a box."""
    flat = shapes.drop("rings")
    pairs = spatial_join(flat.where("fresh"), flat).where("l_group <> r_group AND (l_group < r_group OR NOT r_fresh)")
    small = F.lit(float(threshold)) * F.least("l_area", "r_area")
    boxes = pairs.where(F.col("l_box") & F.col("r_box")).where((box_overlap("l_", "r_") >= small) & (box_overlap("l_", "r_") > 0))
    others = pairs.where(~(F.col("l_box") & F.col("r_box")) & (box_overlap("l_", "r_") >= small) & (box_overlap("l_", "r_") > 0))
    for s in ("l", "r"):
        others = others.join(shapes.select(F.col("group").alias(f"{s}_group"), F.col("rings").alias(f"{s}_rings")), f"{s}_group")
    area = rings_overlap("l_rings", "r_rings")
    others = others.withColumn("_shared", area).where((F.col("_shared") >= small) & (F.col("_shared") > 0))
    both = [F.least("l_group", "r_group").alias("a"), F.greatest("l_group", "r_group").alias("b")]
    return boxes.select(both).unionByName(others.select(both))


def resolve_conflicts(cells: DataFrame, threshold: float = 0.25, boxes: bool = True) -> DataFrame:
    """cell_id, group (its shape's smallest cell) for all cells.

    Pairs that overlap by ``threshold`` of the smaller one become one shape, and their union is compared anew with its own area, until
    no pair reaches the threshold. A round joins all pairs of current shapes that reach it, so the result does not depend on an
    order of cells. Only unions of the last round are fresh: what did not change is not compared again. Each round is written.
    """
    own = cells.select("cell_id", (box_ring(*(F.col(c) for c in BOUNDS)) if boxes else F.col("ring")).alias("ring"))
    members = cells.select("cell_id", F.col("cell_id").alias("group"))
    shapes = durable(_shapes(cells, boxes), "shapes")
    while True:
        found = components(conflicts(shapes, threshold))
        if found.isEmpty():
            return cells.join(members, "cell_id").select(*cells.columns, "group")
        moved = members.join(found, members.group == found.node, "left").select("cell_id", F.coalesce("component", "group").alias("group"))
        members = durable(moved, "members")
        joined = members.join(found.select(F.col("component").alias("group")).distinct(), "group", "left_semi").join(own, "cell_id")
        box = (F.size("rings") == 1) & is_box(F.col("rings")[0], *(F.col(c) for c in BOUNDS))
        unions = _with_rings_bbox(_unions(joined)).select("group", *BOUNDS, "area", "rings", box.alias("box"), F.lit(True).alias("fresh"))
        rest = shapes.join(found, shapes.group == found.node, "left_anti").withColumn("fresh", F.lit(False))
        shapes = durable(rest.unionByName(unions), "shapes")


def _with_rings_bbox(df: DataFrame) -> DataFrame:
    corner = lambda least, c: least(F.transform("rings", lambda r: least(r[c])))
    return df.withColumns({"xmin": corner(F.array_min, "x"), "ymin": corner(F.array_min, "y"), "xmax": corner(F.array_max, "x"), "ymax": corner(F.array_max, "y")})


def _unions(cells: DataFrame) -> DataFrame:
    """The exact union of each group's cells (columns group, ring): group, n_cells, area, rings, the outer one of largest area first.
    Outer rings have a positive signed area and holes a negative one, so they add up to the area."""
    # few bytes are much work, so the number of tasks does not follow the bytes
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = cells.select("group", "ring").repartition(tasks, "group").groupBy("group").agg(F.collect_list("ring").alias("cells"))
    return lists.mapInArrow(_merged, f"group long, n_cells long, area double, rings {RINGS}")


#: Cells of grids of boxes (outlines_of_boxes) that are traced together. A group with more is merged by itself, edge by edge.
TRACED = 1 << 20


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unions of lists of rings (columns group, cells). Groups of boxes are traced together, others one by one."""
    for batch in batches:
        if not len(batch):
            continue
        lists = batch.column("cells")
        rings = lists.flatten()
        points = rings.flatten()
        xy = np.stack([points.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")], axis=1)
        count, corners = (v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for v in (lists, rings))
        at, start = np.r_[0, np.cumsum(count)], np.r_[0, np.cumsum(corners)]
        owner = np.repeat(np.arange(len(count)), count)
        bounds, plain = np.zeros((len(corners), 4)), np.zeros(len(corners), bool)
        four = np.flatnonzero(corners == 4)
        places = start[four][:, None] + np.arange(4)
        bounds[four], plain[four] = box_corners(xy[places, 0], xy[places, 1])
        together = (np.bincount(owner, ~plain, len(count)) == 0) & (count > 0) & (4 * count**3 <= TRACED)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        cost = np.cumsum(np.where(together, 4 * count**3, 0)) // TRACED
        for run in np.unique(cost[together]):
            own = together & (cost == run)
            some = own[owner]
            found.append(outlines_of_boxes(bounds[some], owner[some]))
        for k in np.flatnonzero(~together):
            one = outline_of_union([xy[start[i] : start[i + 1]] for i in range(at[k], at[k + 1])])
            found.append((np.full(len(one), k), np.r_[0, np.cumsum([len(r) for r in one])].astype(np.int64), np.concatenate([np.zeros((0, 2)), *one])))
        yield _as_rows(batch.column("group"), count, found)


def _as_rows(group: pa.Array, count: np.ndarray, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """group, n_cells, area and rings from rings of groups (see outlines_of_boxes), the largest signed area first."""
    own, corners = np.concatenate([f[0] for f in found]), np.concatenate([f[2] for f in found])
    length = np.concatenate([np.diff(f[1]) for f in found])
    begin = np.cumsum(length) - length
    ring = np.repeat(np.arange(len(own)), length)
    after = np.arange(1, len(corners) + 1)
    after[begin + length - 1] = begin
    x, y = (corners - corners[begin[ring]]).T
    size = np.bincount(ring, x * y[after] - x[after] * y, len(own)) / 2
    order = np.lexsort((-size, own))
    area = np.bincount(own, size, len(count))
    take = np.repeat(begin[order] - (np.cumsum(length[order]) - length[order]), length[order]) + np.arange(len(corners))
    points = pa.StructArray.from_arrays([pa.array(corners[take, k]) for k in (0, 1)], fields=list(POINT))
    rings = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length[order])], pa.int32()), points)
    nested = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(own, minlength=len(count)))], pa.int32()), rings)
    return pa.RecordBatch.from_arrays([group, pa.array(count, pa.int64()), pa.array(area), nested], names=["group", "n_cells", "area", "rings"])


def union_groups(cells: DataFrame) -> DataFrame:
    """One shape per group (columns cell_id, group, ring): group, n_cells, area, rings, and ring, the outer one of largest area. A cell
    without conflicts stays as it is; the cells of a larger group become their exact union, with its holes."""
    counted = cells.groupBy("group").agg(F.count(F.lit(1)).alias("n_cells"))
    alone = cells.join(counted.where("n_cells = 1"), "group").select("group", "n_cells", polygon_area(F.col("ring")).alias("area"), F.array("ring").alias("rings"))
    several = cells.join(counted.where("n_cells > 1").select("group"), "group", "left_semi")
    return alone.unionByName(_unions(several)).withColumn("ring", F.col("rings")[0])


def stitch(results: DataFrame, grid: Grid, least: float = 0.0, threshold: float = 0.25) -> DataFrame:
    """Per-patch cells (patch_id, cell_id, ring in the patch's frame) to the slide's cells, one per group of conflicts."""
    moved = with_bbox(translate_shapes(results, grid)).withColumn("area", polygon_area(F.col("ring")))
    kept = durable(filter_min_area(moved, least), "stitch-cells")
    return union_groups(durable(resolve_conflicts(kept.select("cell_id", "ring", "xmin", "ymin", "xmax", "ymax"), threshold, boxes=False), "stitch-groups"))


def stitch_layer(spark, folder: str, grid: Grid, layer: str, overwrite: bool = False, **options) -> None:
    write_layer(stitch(read_patch_results(spark, folder), grid, **options), layer, overwrite)
