"""Trustworthy cells and nuclei from their overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.geometry import box_overlap, intersection_area, polygon_area
from tesserae.operators.tiling import spatial_join
from tesserae.sources.tables import durable


def overlap_ratio(cells: DataFrame, nuclei: DataFrame, boxes: bool = True) -> DataFrame:
    """cell_id, nucleus_id, overlap, ratio = area(cell and nucleus) / area(nucleus) of all pairs that meet."""
    pairs = spatial_join(cells, nuclei)
    if boxes:
        area, whole = box_overlap("l_", "r_"), (F.col("r_xmax") - F.col("r_xmin")) * (F.col("r_ymax") - F.col("r_ymin"))
    else:
        area, whole = intersection_area("l_ring", "r_ring"), polygon_area(F.col("r_ring"))
    return pairs.select(F.col("l_cell_id").alias("cell_id"), F.col("r_nucleus_id").alias("nucleus_id"), area.alias("overlap"), (area / whole).alias("ratio"))


def classify_pairs(ratios: DataFrame, contain: float = 0.95, intersect: float | None = 0.05) -> DataFrame:
    """status: keep if the cell holds the nucleus or at least ``contain`` of it, else remove if it holds more than
    ``intersect``, else ignore. Without ``intersect`` it is 1 - contain; contain 0 leaves whole containment only."""
    intersect = 1 - contain if intersect is None else intersect
    keep, remove = F.col("ratio") >= 1 - 1e-9, F.lit(False)
    if contain > 0:
        keep, remove = keep | (F.col("ratio") >= contain), F.col("ratio") > intersect
    return ratios.withColumn("status", F.when(keep, "keep").when(remove, "remove").otherwise("ignore"))


def cell_status(cells: DataFrame, pairs: DataFrame, accepted: set[int] | None = None) -> DataFrame:
    """cell_id, kept and removed nuclei, status."""
    accepted = {1} if accepted is None else accepted
    if 0 in accepted:
        raise ValueError("a cell without nuclei cannot count as one with nuclei")
    n = pairs.groupBy("cell_id").agg(F.count_if(F.col("status") == "keep").alias("kept"), F.count_if(F.col("status") == "remove").alias("removed"))
    out = cells.select("cell_id").join(n, "cell_id", "left").fillna(0, ["kept", "removed"])
    clean = F.col("removed") == 0
    status = F.when(F.col("kept").isin(sorted(accepted)) & clean, "with_nuclei").when((F.col("kept") == 0) & clean, "without_nuclei").otherwise("inconsistent")
    return out.withColumn("cell_status", status)


def nucleus_status(nuclei: DataFrame, pairs: DataFrame, cells: DataFrame, max_intersecting: int = 1) -> DataFrame:
    """nucleus_id and status: in_cell for each accepted cell that keeps it (so it may repeat); else not_in_cell if at most
    ``max_intersecting`` cells cut it; others have no row."""
    good = cells.where("cell_status = 'with_nuclei'").select("cell_id")
    inside = pairs.where("status = 'keep'").join(good, "cell_id", "left_semi").select("nucleus_id", F.lit("in_cell").alias("nucleus_status"))
    cut = pairs.where("status = 'remove'").groupBy("nucleus_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_intersecting)
    outside = nuclei.select("nucleus_id").join(inside, "nucleus_id", "left_anti").join(cut, "nucleus_id", "left_anti")
    return inside.unionByName(outside.withColumn("nucleus_status", F.lit("not_in_cell")))


def nuclei_per_cell(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """cell_id and its kept nuclei, sorted; empty for cells without any."""
    kept = pairs.where("status = 'keep'").groupBy("cell_id").agg(F.array_sort(F.collect_set("nucleus_id")).alias("nuclei"))
    return cells.select("cell_id").join(kept, "cell_id", "left").withColumn("nuclei", F.coalesce("nuclei", F.array().cast("array<int>")))


def consistent_target(cells: DataFrame, nuclei: DataFrame, contain: float = 0.95, intersect: float | None = 0.05, accepted: set[int] | None = None, max_intersecting: int = 1, boxes: bool = True) -> DataFrame:
    """layer and shape_id of the five layers: with_nuclei, without_nuclei, inconsistent, in_cell, not_in_cell."""
    # joined once, read four times
    pairs = durable(classify_pairs(overlap_ratio(cells, nuclei, boxes), contain, intersect), "curated-pairs")
    status = cell_status(cells, pairs, accepted)
    layers = status.select(F.col("cell_status").alias("layer"), F.col("cell_id").cast("long").alias("shape_id"))
    own = nucleus_status(nuclei, pairs, status, max_intersecting)
    return layers.unionByName(own.select(F.col("nucleus_status").alias("layer"), F.col("nucleus_id").cast("long").alias("shape_id")))


def require_nuclei(target: DataFrame) -> DataFrame:
    """The target, or an error if no cell has nuclei."""
    if target.where("layer = 'with_nuclei'").isEmpty():
        raise ValueError("no consistent cell found")
    return target
