"""Point densities, thresholds and background."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.planes import PLANE, each_patch, pixels_where, spans_of
from tesserae.operators.quantiles import percentiles
from tesserae.operators.tiling import Grid, _origin, dense_grid, patch_grid, patch_point_counts, polygon_spans, valid_patches
from tesserae.sources.tables import durable


def pixel_of(grid: Grid) -> tuple[Column, Column]:
    """Pixel of a point within its patch: both truncated, then subtracted."""
    oy, ox = _origin(grid)
    return F.col("y").cast("int") - oy, F.col("x").cast("int") - ox


def presence_raster(assigned: DataFrame, grid: Grid) -> DataFrame:
    """patch_id, y, x of the pixels with any point."""
    y, x = pixel_of(grid)
    side = int(grid.width)
    return assigned.select("patch_id", y.alias("y"), x.alias("x")).where(f"y >= 0 AND y < {side} AND x >= 0 AND x < {side}").distinct()


def kernel(sigma: float) -> np.ndarray:
    radius = int(4 * sigma + 0.5)
    weights = np.exp(-np.arange(-radius, radius + 1.0) ** 2 / (2 * sigma**2))
    return weights / weights.sum()


def reflected(place: Column, n: int) -> Column:
    """Mirror at the edges: d c b a | a b c d | d c b a."""
    m = F.pmod(place, F.lit(2 * n))
    return F.when(m < n, m).otherwise(2 * n - 1 - m)


def _smooth_axis(raster: DataFrame, keys: list[str], axis: str, n: int, weights: np.ndarray) -> DataFrame:
    """Each pixel sends its value, weighted, to those that read it; mirrored places may be sent twice."""
    radius = len(weights) // 2
    taps = F.array(*(F.struct(F.lit(d - radius).alias("d"), F.lit(float(w)).alias("w")) for d, w in enumerate(weights)))
    other = [c for c in ("y", "x") if c != axis]
    # the pixels whose window holds this one: in place, or across an edge that is near enough
    sources = F.filter(F.array(F.col(axis), -1 - F.col(axis), 2 * n - 1 - F.col(axis)), lambda s: (s >= -radius) & (s < n + radius))
    spread = raster.withColumn("_s", F.explode(sources)).withColumn("_t", F.explode(taps))
    spread = spread.withColumn("_to", F.col("_s") + F.col("_t.d")).where(f"_to >= 0 AND _to < {n}")
    return spread.groupBy(*keys, *other, F.col("_to").cast("int").alias(axis)).agg(F.sum(F.col("value") * F.col("_t.w")).alias("value"))


def gaussian_smooth(raster: DataFrame, keys: list[str], height: int, width: int, sigma: float) -> DataFrame:
    """Separable Gaussian of a sparse raster (value), by key; absent pixels are 0, and so are those out of reach of all others, which stay
    absent. Each key's dense plane is convolved with numpy, so a pixel is shuffled once; planes too large for one place
    scatter with built-in functions."""
    weights = kernel(sigma)
    if height * width > PLANE and len(weights) // 2 <= min(height, width):
        return _smooth_axis(_smooth_axis(raster, keys, "y", height, weights), keys, "x", width, weights)
    return by_plane(raster, keys, height, width, lambda dense, y, x: smoothed(dense, y, x, weights))


def by_plane(raster: DataFrame, keys: list[str], height: int, width: int, work: Callable[..., tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """keys, y, x, value: what ``work`` makes of each key's dense plane and the places y, x of its pixels: a plane, and which of its pixels
    are rows."""
    types = dict(raster.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "y int, x int, value double"])

    def run(plane: pd.DataFrame) -> pd.DataFrame:
        dense = np.zeros((height, width))
        dense[plane["y"], plane["x"]] = plane["value"]
        dense, held = work(dense, plane["y"].to_numpy(), plane["x"].to_numpy())
        y, x = np.nonzero(held)
        out = pd.DataFrame({"y": y.astype("int32"), "x": x.astype("int32"), "value": dense[y, x]})
        for i, k in enumerate(keys):
            out.insert(i, k, plane[k].iloc[0])
        return out

    return raster.groupBy(*keys).applyInPandas(run, schema)


def smoothed(dense: np.ndarray, y: np.ndarray, x: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A plane convolved, and which of its pixels are within reach of the pixels y, x."""
    held = np.zeros(dense.shape)
    held[y, x] = 1.0
    return convolved(dense, weights), convolved(held, (weights > 0).astype(float)) > 0


def convolved(dense: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Both axes, mirrored at the edges."""
    r = len(weights) // 2
    for axis in (0, 1):
        n = dense.shape[axis]
        place = np.arange(-r, n + r) % (2 * n)
        padded = np.take(dense, np.where(place < n, place, 2 * n - 1 - place), axis=axis)
        dense = sum(w * (padded[k : k + n] if axis == 0 else padded[:, k : k + n]) for k, w in enumerate(weights))
    return dense


def mean_density_per_polygon(labels: DataFrame, density: DataFrame) -> DataFrame:
    """patch_id, label and the mean density of its pixels, zeros included."""
    joined = labels.join(density, ["patch_id", "y", "x"], "left")
    return joined.groupBy("patch_id", "label").agg(F.avg(F.coalesce("value", F.lit(0.0))).alias("mean_density"))


def smoothed_means(raster: DataFrame, labels: DataFrame, side: int, sigma: float) -> DataFrame:
    """What mean_density_per_polygon gives for the smoothed raster (patch_id, y, x), for kernels of any size: each patch is convolved
    and averaged in one place, so no dense plane is ever a table. Patches without points or without labels have no rows."""
    weights = kernel(sigma)

    def means(key: tuple, points: pd.DataFrame, pixels: pd.DataFrame) -> pd.DataFrame:
        if points.empty or pixels.empty:
            return pd.DataFrame({"patch_id": [], "label": [], "mean_density": []})
        dense = np.zeros((side, side))
        dense[points["y"], points["x"]] = 1.0
        dense = convolved(dense, weights)
        label = pixels["label"].to_numpy()
        n = np.bincount(label)
        total = np.bincount(label, dense[pixels["y"], pixels["x"]])
        own = np.flatnonzero(n)
        return pd.DataFrame({"patch_id": key[0], "label": own, "mean_density": total[own] / n[own]})

    pair = raster.select("patch_id", "y", "x").groupBy("patch_id").cogroup(labels.select("patch_id", "y", "x", "label").groupBy("patch_id"))
    return pair.applyInPandas(means, "patch_id int, label int, mean_density double")


def density_plane(points: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The density of a patch from the plane of its pixels with points."""
    return convolved((points > 0).astype(float), weights) if points.any() else np.zeros(points.shape)


def sums_by_label(label: np.ndarray, plane: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The labels of a patch, their pixels' number and sum of a plane."""
    n, total = np.bincount(label.ravel()), np.bincount(label.ravel(), plane.ravel())
    own = np.flatnonzero(n[1:]) + 1
    return own, n[own], total[own]


def means_of_shapes(raster: DataFrame, shapes: DataFrame, side: int, sigma: float) -> DataFrame:
    """patch_id, label, mean_density of every label, zeros included, from pixels with points (patch_id, y, x) and spans of shapes."""
    weights = kernel(sigma)

    def means(points: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        own, n, total = sums_by_label(label, density_plane(points, weights))
        return [own, total / n]

    return each_patch([spans_of(raster), shapes], side, means, {"label": "int", "mean_density": "double"})


def density_threshold(means: DataFrame, percentile: float) -> DataFrame:
    """The percentile of all means, linearly interpolated; null if there are none."""
    return percentiles(means, "mean_density", [], [percentile / 100]).agg(F.max(F.col("percentiles")[0]).alias("threshold"))


def dataset_threshold(assigned: DataFrame, shapes: DataFrame, grid: Grid, key: str, sigma: float = 9.0, percentile: float = 5.0, min_points: int = 10, min_cells: int = 1, boxes: bool = True) -> DataFrame:
    """The density threshold of a slide: over the patches with at least min_points points and min_cells shapes, the percentile of
    all shapes' mean densities. Points and shapes are filtered by patch before any raster is made."""
    spark = assigned.sparkSession
    grids = patch_grid(spark, grid)
    counts = patch_point_counts(assigned, grids)
    # a row per patch that is used
    used = durable(valid_patches(grids, counts, shapes, grid, grid.x1, grid.y1, min_cells, min_points, check_border=False).select("patch_id"), "threshold-patches")
    raster = presence_raster(assigned.join(used, "patch_id", "left_semi"), grid)
    spans = polygon_spans(shapes, grid, key, boxes).join(used, "patch_id", "left_semi")
    return density_threshold(means_of_shapes(raster, spans, int(grid.width), sigma), percentile)


def background_of_points(raster: DataFrame, patches: DataFrame, side: int, sigma: float, threshold: float) -> DataFrame:
    """What background_mask gives for the smoothed raster (patch_id, y, x): each patch is convolved and compared in one place."""
    weights = kernel(sigma)
    return each_patch([spans_of(raster)], side, lambda points: pixels_where(density_plane(points, weights) < threshold), {"y": "int", "x": "int"}, patches)


def background_at(pixels: DataFrame, density: DataFrame, threshold: float) -> DataFrame:
    """patch_id, y, x of those pixels of a sparse table that are background: density below the threshold, or none. Where only
    labelled pixels are asked for, this spares the dense mask."""
    place = ["patch_id", "y", "x"]
    return pixels.select(*place).join(density, place, "left").where(F.coalesce("value", F.lit(0.0)) < threshold).select(*place)


def background_mask(patches: DataFrame, density: DataFrame, side: int, threshold: float) -> DataFrame:
    """patch_id, y, x of pixels with density below the threshold; dense, since most have none."""
    grid = dense_grid(patches.select("patch_id"), side, side)
    return grid.join(density, ["patch_id", "y", "x"], "left").where(F.coalesce("value", F.lit(0.0)) < threshold).select("patch_id", "y", "x")


def unit(*parts: Column | str) -> Column:
    """A repeatable number in [0, 1) from its arguments: the first 13 hex digits of their MD5."""
    text = F.concat_ws("|", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def sample_patches(patches: DataFrame, n: int, seed: int) -> DataFrame:
    """n patches without replacement, the same for a seed; all if there are no more."""
    return patches.withColumn("_u", unit("patch_id", F.lit(seed))).orderBy("_u", "patch_id").limit(n).drop("_u")
