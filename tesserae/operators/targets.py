"""Training masks: label layers, background, gradient mask, contours."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.operators.density import density_plane, kernel, smoothed, sums_by_label
from tesserae.operators.planes import PLANE, each_patch, pixels_where, spans_of
from tesserae.operators.tiling import Grid, rasterize_polygons, shapes_in_box

PIXEL = ["patch_id", "y", "x"]


def label_background_fraction(labels: DataFrame, background: DataFrame) -> DataFrame:
    """patch_id, label, fraction of its pixels in the background."""
    marked = labels.join(background.select(*PIXEL, F.lit(1.0).alias("bg")), PIXEL, "left")
    return marked.groupBy("patch_id", "label").agg(F.avg(F.coalesce("bg", F.lit(0.0))).alias("fraction"))


def drop_background_labels(labels: DataFrame, background: DataFrame, most: float) -> DataFrame:
    """Labels with more than ``most`` of their pixels in the background go."""
    bad = label_background_fraction(labels, background).where(F.col("fraction") > most).select("patch_id", "label")
    return labels.join(bad, ["patch_id", "label"], "left_anti")


def merge_label_layers(with_nuclei: DataFrame, without: DataFrame, nuclei_only: DataFrame) -> DataFrame:
    """One label per pixel. Nuclei yield to both cell layers, cells without nuclei to those with; labels of later layers
    are shifted by the largest one so far in the patch, so they never collide. Pixels of all layers are dealt once."""
    layers = [layer.select(*PIXEL, "label", F.lit(k).alias("_k")) for k, layer in enumerate((with_nuclei, without, nuclei_only))]
    every = layers[0].unionByName(layers[1]).unionByName(layers[2])
    # a row per patch
    tops = every.groupBy("patch_id").agg(*(F.coalesce(F.max(F.when(F.col("_k") == k, F.col("label"))), F.lit(0)).alias(f"_top{k}") for k in (0, 1)))
    own = every.withColumn("_first", F.min("_k").over(W.partitionBy(*PIXEL))).where("_k = _first").join(tops, "patch_id")
    has_second = F.when(F.col("_top1") > 0, F.col("_top0") + F.col("_top1")).otherwise(F.col("_top0"))
    shift = F.when(F.col("_k") == 0, 0).when(F.col("_k") == 1, F.col("_top0")).otherwise(has_second)
    return own.select(*PIXEL, (F.col("label") + shift).alias("label"))


def merged_planes(with_nuclei: np.ndarray, without: np.ndarray, nuclei_only: np.ndarray) -> np.ndarray:
    """merge_label_layers of a patch's planes."""
    second = np.where(without > 0, without + with_nuclei.max(), 0)
    third = np.where(nuclei_only > 0, nuclei_only + max(with_nuclei.max(), second.max()), 0)
    return np.where(with_nuclei > 0, with_nuclei, np.where(second > 0, second, third))


def merge_shape_layers(with_nuclei: DataFrame, without: DataFrame, nuclei_only: DataFrame, side: int) -> DataFrame:
    """merge_label_layers of layers given as spans (polygon_spans)."""

    def merge(*planes: np.ndarray) -> list[np.ndarray]:
        label = merged_planes(*planes)
        return pixels_where(label > 0, label)

    return each_patch([with_nuclei, without, nuclei_only], side, merge, {"y": "int", "x": "int", "label": "int"})


def background_fractions(raster: DataFrame, shapes: DataFrame, side: int, sigma: float, threshold: float) -> DataFrame:
    """label_background_fraction of spans of shapes, in the background of the pixels with points (patch_id, y, x)."""
    weights = kernel(sigma)

    def fractions(points: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        own, n, dark = sums_by_label(label, density_plane(points, weights) < threshold)
        return [own, dark / n]

    return each_patch([spans_of(raster), shapes], side, fractions, {"label": "int", "fraction": "double"})


def foreground_labels(raster: DataFrame, shapes: DataFrame, side: int, sigma: float, threshold: float, most: float) -> DataFrame:
    """drop_background_labels of spans of shapes, in the background of the pixels with points (patch_id, y, x)."""
    weights = kernel(sigma)

    def keep(points: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        own, n, dark = sums_by_label(label, density_plane(points, weights) < threshold)
        return pixels_where(np.isin(label, own[dark / n <= most]), label)

    return each_patch([spans_of(raster), shapes], side, keep, {"y": "int", "x": "int", "label": "int"})


def masked_density(raster: DataFrame, shapes: DataFrame, side: int, sigma: float, threshold: float) -> DataFrame:
    """mask_target with keep_label, of the density of pixels with points (patch_id, y, x): labels as channel 0, as channel 1 the density
    where there is a label and no background."""
    weights = kernel(sigma)

    def masked(points: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        dense, reached = smoothed((points > 0).astype(float), *np.nonzero(points), weights)
        own, lit = pixels_where(label > 0, label), pixels_where((label > 0) & reached & (dense >= threshold), dense)
        channel = np.repeat([0, 1], [len(own[0]), len(lit[0])])
        return [channel, *map(np.concatenate, zip(own, lit))]

    return each_patch([spans_of(raster), shapes], side, masked, {"channel": "int", "y": "int", "x": "int", "value": "double"})


def corrected_empty(raster: DataFrame, patches: DataFrame, shapes: list[DataFrame], side: int, sigma: float, threshold: float) -> DataFrame:
    """corrected_background for layers given as spans."""
    weights = kernel(sigma)

    def empty(points: np.ndarray, *labels: np.ndarray) -> list[np.ndarray]:
        return pixels_where((density_plane(points, weights) < threshold) & ~np.any([label > 0 for label in labels], axis=0))

    return each_patch([spans_of(raster), *shapes], side, empty, {"y": "int", "x": "int"}, patches)


def gradient_planes(raster: DataFrame, patches: DataFrame, shapes: list[DataFrame], side: int, sigma: float, threshold: float) -> DataFrame:
    """gradient_mask of three layers given as spans and the background of the pixels with points."""
    weights = kernel(sigma)

    def gradient(points: np.ndarray, *labels: np.ndarray) -> list[np.ndarray]:
        a, b, c = (label > 0 for label in labels)
        value = (a | b | c).astype(np.int32) + b + 3 * c + (density_plane(points, weights) < threshold)
        return pixels_where(value > 0, value)

    return each_patch([spans_of(raster), *shapes], side, gradient, {"y": "int", "x": "int", "mask": "int"}, patches)


def corrected_background(background: DataFrame, layers: list[DataFrame], nuclei: DataFrame | None = None) -> DataFrame:
    """Background without the pixels of the layers and, if given, of all nuclei."""
    for layer in [*layers, *([nuclei] if nuclei is not None else [])]:
        background = background.join(layer.select(*PIXEL), PIXEL, "left_anti")
    return background


def gradient_mask(with_nuclei: DataFrame, without: DataFrame, nuclei_only: DataFrame, background: DataFrame) -> DataFrame:
    """1 cells with nuclei, 2 without, 4 nuclei alone, 1 background; all other pixels are 0 and absent."""
    parts = [layer.select(*PIXEL, F.lit(k).alias("k")) for k, layer in enumerate((with_nuclei, without, nuclei_only, background))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    has = lambda k: F.max((F.col("k") == k).cast("int"))
    flags = every.groupBy(*PIXEL).agg(*(has(k).alias(f"h{k}") for k in range(4)))
    value = F.greatest("h0", "h1", "h2") + F.col("h1") + 3 * F.col("h2") + F.col("h3")
    return flags.select(*PIXEL, value.alias("mask"))


def mask_target(target: DataFrame, labels: DataFrame, background: DataFrame, keep_label: bool = False) -> DataFrame:
    """Target channels only where there is a label and no background. With keep_label the labels come as channel 0
    and the others move up."""
    own = target.join(labels.select(*PIXEL), PIXEL, "left_semi").join(background.select(*PIXEL), PIXEL, "left_anti")
    if not keep_label:
        return own
    first = labels.select(*PIXEL, F.lit(0).alias("channel"), F.col("label").cast("double").alias("value"))
    return first.unionByName(own.select(*PIXEL, (F.col("channel") + 1).alias("channel"), "value"))


def label_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("patch_id", "label").agg(F.count(F.lit(1)).alias("size"))


def drop_small(labels: DataFrame, least: int) -> DataFrame:
    """Labels of at least ``least`` pixels, with their size. The labels are read and dealt by label once."""
    return labels.withColumn("size", F.count(F.lit(1)).over(W.partitionBy("patch_id", "label"))).where(F.col("size") >= least)


def sizes_of_shapes(shapes: DataFrame, side: int, least: int) -> DataFrame:
    """patch_id, label, size of the labels of at least ``least`` pixels, from spans of shapes."""

    def sizes(label: np.ndarray) -> list[np.ndarray]:
        size = np.bincount(label.ravel())
        own = np.flatnonzero(size[1:] >= max(least, 1)) + 1
        return [own, size[own]]

    return each_patch([shapes], side, sizes, {"label": "int", "size": "bigint"})


def cell_contours(labels: DataFrame, side: int, line: int, least: int) -> DataFrame:
    """patch_id, y, x, value: for each label of at least ``least`` pixels its maximum filter less its minimum filter, added up. A pixel is on
    a label's contour if its window holds some of the label's pixels and not only them; mirrored windows see only pixels of the patch."""
    own = drop_small(labels, least).select(*PIXEL, "label")
    low, high = line // 2, (line - 1) // 2
    place = lambda c: F.explode(F.sequence(F.greatest(F.col(c) - high, F.lit(0)), F.least(F.col(c) + low, F.lit(side - 1))))
    near = own.withColumn("_y", place("y")).withColumn("_x", place("x"))
    lit = near.groupBy("patch_id", "label", F.col("_y").cast("int").alias("y"), F.col("_x").cast("int").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    span = lambda c: F.least(F.col(c) + high, F.lit(side - 1)) - F.greatest(F.col(c) - low, F.lit(0)) + 1
    return lit.where(F.col("n") < span("y") * span("x")).groupBy(*PIXEL).agg(F.count(F.lit(1)).cast("double").alias("value"))


def contours_of_plane(label: np.ndarray, line: int, least: int) -> np.ndarray:
    """cell_contours of a patch's plane: the different labels in each pixel's window, less one where the window has one label only."""
    size = np.bincount(label.ravel())
    label = np.where(size[label] >= least, label, 0)
    low, high = line // 2, (line - 1) // 2
    window = np.lib.stride_tricks.sliding_window_view(np.pad(label, ((low, high), (low, high)), mode="symmetric"), (line, line))
    out = np.zeros(label.shape)
    for rows in np.array_split(np.arange(len(label)), -(-label.size * line * line // PLANE)):
        seen = np.sort(window[rows].reshape(len(rows), label.shape[1], -1), axis=2)
        different = (seen[..., 0] > 0) + ((seen[..., 1:] != seen[..., :-1])).sum(axis=2)
        out[rows] = different - ((seen[..., 0] == seen[..., -1]) & (seen[..., 0] > 0))
    return out


def contours_of_shapes(shapes: DataFrame, side: int, line: int, least: int) -> DataFrame:
    """cell_contours of spans of shapes."""

    def contours(label: np.ndarray) -> list[np.ndarray]:
        value = contours_of_plane(label, line, least)
        return pixels_where(value > 0, value)

    return each_patch([shapes], side, contours, {"y": "int", "x": "int", "value": "double"})


def region_contours(shapes: DataFrame, xmin: int, ymin: int, side: int, key: str, line: int = 5, least: int = 5) -> DataFrame:
    """Contours of the shapes in a free square."""
    own = shapes_in_box(shapes, xmin, ymin, xmin + side, ymin + side)
    return cell_contours(rasterize_polygons(own, Grid(xmin, ymin, xmin + side, ymin + side, side, 0), key), side, line, least)
