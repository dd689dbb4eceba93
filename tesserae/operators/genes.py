"""Genes as numbers, RNA images and embeddings."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.operators.density import by_plane, gaussian_smooth, kernel, pixel_of, smoothed, unit
from tesserae.operators.planes import PLANE
from tesserae.operators.tiling import Grid, points_in_box


def build_gene_index(points: DataFrame) -> DataFrame:
    """gene and its number from 1 in sorted order; 0 stays free for padding. Only the different genes are sorted, a panel's thousands."""
    return points.select("gene").distinct().select("gene", F.row_number().over(W.orderBy("gene")).alias("gene_index"))


def encode_genes(points: DataFrame, index: DataFrame) -> DataFrame:
    """Adds gene_index; an unknown gene is an error where it is read."""
    joined = points.join(index, "gene", "left")
    return joined.withColumn("gene_index", F.coalesce("gene_index", F.raise_error(F.concat(F.lit("unknown gene "), F.col("gene"))).cast("int")))


def scaled_coords(assigned: DataFrame, grid: Grid, target: int) -> DataFrame:
    """Adds sy, sx: places in a patch resized to target x target. A point outside its patch is an error."""
    y, x = pixel_of(grid)
    inside = (y >= 0) & (y <= int(grid.width)) & (x >= 0) & (x <= int(grid.width))
    scale = lambda v: F.when(inside, (v * target / float(grid.width)).cast("int")).otherwise(F.raise_error(F.lit("point outside its patch")).cast("int"))
    return assigned.withColumns({"sy": scale(y), "sx": scale(x)})


def rna_image(points: DataFrame, keys: list[str], values: DataFrame | None = None, mode: str = "add", order: list[str] | None = None) -> DataFrame:
    """keys, y, x, channel, value: the sum of the points' gene vectors on each pixel (``add``), or the last point's in
    ``order`` (``last``). Without vectors each point counts 1 in channel 0. A gene without a vector is an error where it is read."""
    if values is None:
        wide = points.withColumn("value", F.array(F.lit(1.0)))
    else:
        missing = F.raise_error(F.concat(F.lit("no vector for gene "), F.col("gene"))).cast("array<double>")
        wide = points.join(values, "gene", "left").withColumn("value", F.coalesce(F.col("value").cast("array<double>"), missing))
    if mode == "last":
        wide = wide.groupBy(*keys, "y", "x").agg(F.max_by("value", F.struct(*order)).alias("value"))
        return wide.select(*keys, "y", "x", F.posexplode("value").alias("channel", "value"))
    wide = wide.select(*keys, "y", "x", F.posexplode("value").alias("channel", "value"))
    return wide.groupBy(*keys, "y", "x", "channel").agg(F.sum("value").alias("value"))


def max_filter(raster: DataFrame, keys: list[str], height: int, width: int, size: int) -> DataFrame:
    """Maximum over a size x size window from i - size/2 to i + (size - 1)/2, mirrored at the edges; absent pixels
    are 0, so a window with an absent pixel is 0 at least. Each key's plane is filtered in one place; on planes too large for that, one axis
    goes after the other, with the number of pixels that are there, so a pixel is sent to ``size`` places twice."""
    if height * width <= PLANE:
        return by_plane(raster, keys, height, width, lambda dense, y, x: highest(dense, y, x, size))
    low, high = size // 2, (size - 1) // 2

    def readers(c: str, n: int) -> Column:
        """The pixels whose window holds this one."""
        near = F.sequence(F.col(c) - high, F.col(c) + low)
        mirrored = F.concat(near, F.sequence(-1 - F.col(c) - high, -1 - F.col(c) + low), F.sequence(2 * n - 1 - F.col(c) - high, 2 * n - 1 - F.col(c) + low))
        return F.array_distinct(F.filter(mirrored, lambda p: (p >= 0) & (p < n)))

    found = raster.select(*keys, "y", "x", "value", F.lit(1).cast("long").alias("_n"))
    for axis, other, n in (("y", "x", height), ("x", "y", width)):
        wide = found.withColumn("_to", F.explode(readers(axis, n)))
        found = wide.groupBy(*keys, other, F.col("_to").cast("int").alias(axis)).agg(F.max("value").alias("value"), F.sum("_n").alias("_n"))
    found = found.select(*keys, "y", "x", "value", "_n")
    span = lambda c, n: F.least(F.col(c) + high, F.lit(n - 1)) - F.greatest(F.col(c) - low, F.lit(0)) + 1
    full = F.col("_n") == span("y", height) * span("x", width)
    return found.withColumn("value", F.when(full, F.col("value")).otherwise(F.greatest("value", F.lit(0.0)))).drop("_n")


def highest(dense: np.ndarray, y: np.ndarray, x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The maximum filter of a plane, and which windows have any of its pixels y, x."""
    held = np.zeros(dense.shape, bool)
    held[y, x] = True
    low, high = size // 2, (size - 1) // 2
    top, every, some = np.where(held, dense, -np.inf), held, held
    for axis in (0, 1):
        ends = [(low, high) if a == axis else (0, 0) for a in (0, 1)]
        window = lambda v: np.lib.stride_tricks.sliding_window_view(np.pad(v, ends, mode="symmetric"), size, axis)  # noqa: B023, E731
        top, every, some = window(top).max(axis=2), window(every).all(axis=2), window(some).any(axis=2)
    return np.where(every, top, np.maximum(top, 0.0)), some


def rna_input(points: DataFrame, keys: list[str], side: int, values: DataFrame | None = None) -> DataFrame:
    """RNA image, then maximum filter of 2, then Gaussian of 0.5."""
    image = rna_image(points, keys, values)
    if side * side > PLANE:
        return gaussian_smooth(max_filter(image, [*keys, "channel"], side, side, 2), [*keys, "channel"], side, side, 0.5)
    weights = kernel(0.5)

    def both(dense: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top, some = highest(dense, y, x, 2)
        return smoothed(np.where(some, top, 0.0), *np.nonzero(some), weights)

    return by_plane(image, [*keys, "channel"], side, side, both)


def stamp_embeddings(points: DataFrame, keys: list[str], embeddings: DataFrame, side: int, radius: int, order: list[str], dimensions: int, sigma: float = 0.0) -> DataFrame:
    """keys, y, x, channel, value: each point's vector on the (2 radius + 1) square around it, clamped to the edges. Offsets go in
    turn, points in ``order`` within each, and the last one stays. Points whose gene has no vector, such as padding, stamp
    zeros. With sigma each channel is smoothed afterwards."""
    if side * side * dimensions <= PLANE:
        return _stamped_by_plane(points, keys, embeddings, side, radius, order, dimensions, sigma)
    offsets = F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for i, (dy, dx) in enumerate((a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1))))
    vectors = points.join(embeddings, "gene", "left").withColumn("value", F.coalesce(F.col("value").cast("array<double>"), F.array_repeat(F.lit(0.0), dimensions)))
    vectors = vectors.withColumn("_o", F.explode(offsets))
    clamp = lambda v: F.least(F.greatest(v, F.lit(0)), F.lit(side - 1))
    placed = vectors.select(*keys, clamp(F.col("y") + F.col("_o.dy")).alias("y"), clamp(F.col("x") + F.col("_o.dx")).alias("x"), "value", F.struct("_o.rank", *order).alias("_k"))
    stamped = placed.groupBy(*keys, "y", "x").agg(F.max_by("value", "_k").alias("value"))
    image = stamped.select(*keys, "y", "x", F.posexplode("value").alias("channel", "value"))
    return gaussian_smooth(image, [*keys, "channel"], side, side, sigma) if sigma > 0 else image


def _stamped_by_plane(points: DataFrame, keys: list[str], embeddings: DataFrame, side: int, radius: int, order: list[str], dimensions: int, sigma: float) -> DataFrame:
    """stamp_embeddings, key by key. Points of one pixel stamp the same places, so the last of them is enough."""
    last = points.groupBy(*keys, "y", "x").agg(F.max(F.struct(*(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), "gene")).alias("_k"))
    by = [f"_o{i}" for i in range(len(order))]
    own = last.select(*keys, "y", "x", *(f"_k.{c}" for c in by), "_k.gene").join(embeddings, "gene", "left")
    own = own.select(*keys, "y", "x", *by, F.coalesce(F.col("value").cast("array<double>"), F.array_repeat(F.lit(0.0), dimensions)).alias("value"))
    types, weights = dict(points.dtypes), kernel(sigma) if sigma > 0 else None
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "y int, x int, channel int, value double"])

    def stamp(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(by, na_position="first", kind="stable")
        vectors = np.stack(group["value"].to_list()).astype(float)
        y, x = group["y"].to_numpy(), group["x"].to_numpy()
        source = np.full((side, side), -1)
        for dy in range(-radius, radius + 1):
            for dx in range(-radius, radius + 1):
                # of places that come twice, at the edges, the last one stays
                source[np.clip(y + dy, 0, side - 1), np.clip(x + dx, 0, side - 1)] = np.arange(len(group))
        held = source >= 0
        parts = []
        for channel in range(vectors.shape[1]):
            plane, lit = np.where(held, vectors[source, channel], 0.0), held
            if weights is not None:
                plane, lit = smoothed(plane, *np.nonzero(held), weights)
            at, along = np.nonzero(lit)
            parts.append(pd.DataFrame({"y": at.astype("int32"), "x": along.astype("int32"), "channel": np.int32(channel), "value": plane[at, along]}))
        out = pd.concat(parts, ignore_index=True)
        for i, k in enumerate(keys):
            out.insert(i, k, group[k].iloc[0])
        return out

    return own.groupBy(*keys).applyInPandas(stamp, schema)


def gauss(*parts: Column | str) -> Column:
    """A repeatable standard normal number (Box-Muller)."""
    u, v = unit(*parts, F.lit("u")), unit(*parts, F.lit("v"))
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def jitter_points(points: DataFrame, key: list[str], factor: int, sd: float, seed: int) -> DataFrame:
    """The points and factor - 1 copies of each (copy = 1, ...), moved by N(0, sd) along x and y."""
    wide = points.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    move = lambda axis: F.when(F.col("copy") > 0, F.col(axis) + sd * gauss(*key, "copy", F.lit(seed), F.lit(axis))).otherwise(F.col(axis))
    return wide.withColumns({"x": move("x"), "y": move("y")})


def _each_dimension(embeddings: DataFrame, change) -> DataFrame:
    indexed = F.transform("value", lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    return embeddings.withColumn("value", F.transform(indexed, lambda s: change(s["v"], s["i"])))


def noise_embeddings(embeddings: DataFrame, level: float, p: float, seed: int) -> DataFrame:
    """With probability p a gene's vector gets N(0, level) on every dimension."""
    hit = unit("gene", F.lit(seed), F.lit("hit")) < p
    return _each_dimension(embeddings, lambda v, i: F.when(hit, v + level * gauss(F.col("gene"), i, F.lit(seed))).otherwise(v))


def scale_shift_embeddings(embeddings: DataFrame, p: float, seed: int, scale: tuple[float, float] = (0.9, 1.1), shift: tuple[float, float] = (-1.0, 1.0)) -> DataFrame:
    """Each dimension of each vector is scaled and shifted with probability p."""

    def change(v: Column, i: Column) -> Column:
        draw = lambda what: unit(F.col("gene"), i, F.lit(seed), F.lit(what))
        return F.when(draw("hit") < p, v * (scale[0] + (scale[1] - scale[0]) * draw("scale")) + shift[0] + (shift[1] - shift[0]) * draw("shift")).otherwise(v)

    return _each_dimension(embeddings, change)


def augment_embeddings(embeddings: DataFrame, level: float, p: float, seed: int) -> DataFrame:
    return scale_shift_embeddings(noise_embeddings(embeddings, level, p, seed), p, seed + 1)


def region_rna_image(points: DataFrame, xmin: int, ymin: int, xmax: int, ymax: int, values: DataFrame) -> DataFrame:
    """RNA image of a free box, with a maximum filter of 5. The box reaches the scan."""
    own = points_in_box(points, xmin, ymin, xmax, ymax)
    height, width = ymax - ymin, xmax - xmin
    pixels = own.select("gene", (F.col("y").cast("int") - ymin).alias("y"), (F.col("x").cast("int") - xmin).alias("x")).where(f"y < {height} AND x < {width}")
    return max_filter(rna_image(pixels, [], values), ["channel"], height, width, 5)
