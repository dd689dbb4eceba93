"""Normalisation, assembly into samples and batches, and augmentation."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.operators.density import unit
from tesserae.operators.planes import PLANE
from tesserae.operators.quantiles import percentiles
from tesserae.operators.tiling import dense_grid
from tesserae.sources.tables import durable


def normalize99(pixels: DataFrame, by: list[str]) -> DataFrame:
    """(v - p1) / (p99 - p1) by group; zeros if these percentiles are within 0.001."""
    ends = percentiles(pixels, "value", by, [0.01, 0.99]).withColumnRenamed("percentiles", "_p")
    low, high = F.col("_p")[0], F.col("_p")[1]
    scaled = F.when(high - low > 1e-3, (F.col("value") - low) / (high - low)).otherwise(0.0)
    return pixels.join(ends, by).withColumn("value", scaled).drop("_p")


def stack_channels(*layers: DataFrame) -> DataFrame:
    """Layers (keys, channel, y, x, value) one after the other; channels are numbered on through the layers."""
    out = None
    for k, layer in enumerate(layers):
        own = layer.withColumn("_layer", F.lit(k))
        out = own if out is None else out.unionByName(own)
    # a row per channel
    ranks = out.select("_layer", "channel").distinct().withColumn("rank", F.row_number().over(W.orderBy("_layer", "channel")) - 1)
    return out.join(ranks, ["_layer", "channel"]).drop("_layer")


def pack_patches(pixels: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """A row per key with ``plane``: all height x width values, row by row; absent pixels are 0 and those outside are left out. One
    aggregate of the sparse pixels, whose gaps are filled in its result: no dense table, no join."""
    inside = F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)
    cell = F.struct((F.col("y") * width + F.col("x")).cast("int").alias("at"), F.coalesce("value", F.lit(0.0)).alias("v"))
    sparse = pixels.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(inside, cell))).alias("_s"))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    last = lambda i: F.when(i > 0, F.get("_s", i - 1)["at"]).otherwise(-1)
    filled = F.flatten(F.transform("_s", lambda c, i: F.concat(zeros(c["at"] - last(i) - 1), F.array(c["v"]))))
    return sparse.withColumn("plane", F.concat(filled, zeros(height * width - 1 - last(F.size("_s"))))).drop("_s")


def numbered(samples: DataFrame, key: str, name: str, order: list[Column] | None = None) -> DataFrame:
    """Adds the place (from 0) of each sample in the order of its key, or in ``order``; the key tells samples apart. Only keys are
    sorted, range by range, so no task sees them all: a row's place is its place in its range and the rows of the ranges before."""
    spark = samples.sparkSession
    columns = [F.col(key)] if order is None else [*order, F.col(key)]
    keys = samples.select(key, *(c.alias(f"_o{i}") for i, c in enumerate(columns)))
    by = [f"_o{i}" for i in range(len(columns))]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(keys.repartitionByRange(tasks, *by).sortWithinPartitions(*by).select(key, F.monotonically_increasing_id().alias("_at")), "places")
    # the task above bit 33, the place in it below
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    runs = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # a row per task
    offsets = runs.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    ranked = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").select(key, (F.col("_offset") + place).alias(name))
    return samples.join(ranked, key)


def numbered_batches(samples: DataFrame, key: str, size: int) -> DataFrame:
    """Adds batch: ``size`` samples each in the order of the key."""
    return numbered(samples, key, "_place").withColumn("batch", F.floor(F.col("_place") / size).cast("int")).drop("_place")


def collate_sequences(samples: DataFrame, key: str, columns: list[str], size: int) -> DataFrame:
    """Lists padded with 0 to the longest of their batch. A batch's samples meet in one task; ``size`` bounds them."""
    out = numbered_batches(samples, key, size)
    batch = W.partitionBy("batch")
    out = out.withColumns({f"_n{i}": F.max(F.size(c)).over(batch) for i, c in enumerate(columns)})
    return out.withColumns({c: F.concat(F.col(c), F.array_repeat(F.lit(0), F.col(f"_n{i}") - F.size(c))) for i, c in enumerate(columns)}).drop(*(f"_n{i}" for i in range(len(columns))))


def collate_channels(samples: DataFrame, key: str, column: str, size: int) -> DataFrame:
    """Lists of planes padded with zero planes to the most channels of their batch."""
    out = numbered_batches(samples, key, size).withColumn("_n", F.max(F.size(column)).over(W.partitionBy("batch")))
    blank = F.array_repeat(F.transform(F.col(column)[0], lambda v: v * 0), F.col("_n") - F.size(column))
    return out.withColumn(column, F.concat(column, blank)).drop("_n")


def train_val_split(patches: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Adds part: exactly round(fraction n) patches are ``val``, the same ones for a seed."""
    total = patches.agg(F.count(F.lit(1)).alias("_total"))
    placed = numbered(patches, "patch_id", "_place", [unit("patch_id", F.lit(seed))]).join(F.broadcast(total))  # one row
    return placed.withColumn("part", F.when(F.col("_place") < F.round(F.col("_total") * fraction), "val").otherwise("train")).drop("_place", "_total")


def channel_dropout(pixels: DataFrame, keep: float, epoch: int, warmup: int, seed: int, drop_dapi: bool = False, use: list[str] | None = None) -> DataFrame:
    """Per sample: membrane channels become 0 unless a draw is within ``keep`` (which is 0 before ``warmup``); DAPI likewise
    if asked. ``use`` keeps some channels only. Columns patch_id, kind (dapi, rna, membrane), channel, value."""
    p = 0.0 if epoch < warmup else keep
    lost = (F.col("kind") == "membrane") & (unit("patch_id", F.lit(epoch), F.lit(seed), F.lit("membrane")) > p)
    if drop_dapi:
        lost = lost | ((F.col("kind") == "dapi") & (unit("patch_id", F.lit(epoch), F.lit(seed), F.lit("dapi")) > p))
    out = pixels if use is None else pixels.where(F.col("channel").isin(use))
    return out.withColumn("value", F.when(lost, 0.0).otherwise(F.col("value")))


def augment_pixels(pixels: DataFrame, key: str, channels: int, side: int, seed: int, p: float = 0.2, most: float = 0.25, hole: int = 400) -> DataFrame:
    """Per sample, each with probability p: contrast and brightness within +-most, a blur (the mean of a window of 3, 5 or 7 pixels,
    mirrored at the edges), one or two rectangles in all channels, one in a single channel (up to ``hole`` pixels high and
    wide), and two channels swapped. Columns key, channel, y, x, value; absent pixels are 0 and stay so but for the blur. Parameters
    are drawn once per sample, from its key alone. A sample is augmented in one place, channel by channel; on planes too large for
    that, pixels are rows, and each goes to its readers."""
    if side * side <= PLANE:
        return _augmented_planes(pixels, key, channels, side, seed, p, most, hole)
    draw = lambda what: unit(key, F.lit(seed), F.lit(what))
    hit = lambda what: draw(what + "?") < p
    place = lambda what, n: F.floor(draw(what) * n)
    first, second = place("swap1", channels), place("swap2", channels)
    swapped = F.when(hit("swap") & (F.col("channel") == first), second).when(hit("swap") & (F.col("channel") == second), first).otherwise(F.col("channel"))
    out = pixels.select(key, swapped.cast("int").alias("channel"), "y", "x", "value")
    contrast, bright = 1 + most * (2 * draw("contrast") - 1), most * (2 * draw("bright") - 1)
    out = out.withColumn("value", F.when(hit("light"), F.col("value") * contrast + bright).otherwise(F.col("value")))
    radius = F.when(hit("blur"), 1 + place("blur", 3)).otherwise(0).cast("int")
    out = blurred(blurred(out.withColumn("_r", radius), [key, "channel", "_r"], "y", side), [key, "channel", "_r"], "x", side).drop("_r")

    def inside(what: str) -> Column:
        y, x = place(what + "y", side), place(what + "x", side)
        height, width = (1 + place(what + c, min(hole, side)) for c in ("h", "w"))
        return (F.col("y") >= y) & (F.col("y") < y + height) & (F.col("x") >= x) & (F.col("x") < x + width)

    every = hit("hole") & (inside("hole1") | ((draw("holes") >= 0.5) & inside("hole2")))
    holes = every | (hit("one") & (F.col("channel") == place("onechannel", channels)) & inside("one"))
    return out.withColumn("value", F.when(holes, 0.0).otherwise(F.col("value")))


def _augmented_planes(pixels: DataFrame, key: str, channels: int, side: int, seed: int, p: float, most: float, hole: int) -> DataFrame:
    """augment_pixels, each sample's planes in one place. A draw is an MD5, so as a column it costs far more than its pixel."""
    none = np.iinfo(np.int32).min

    def mean(plane: np.ndarray, axis: int, radius: int) -> np.ndarray:
        out = np.zeros_like(plane)
        for step in range(-radius, radius + 1):
            at = np.arange(side) + step
            at = np.where(at < 0, -1 - at, np.where(at >= side, 2 * side - 1 - at, at))
            here = (at >= 0) & (at < side)
            out[(slice(None),) * axis + (here,)] += plane.take(at[here], axis)
        return out

    def augment(rows: pa.Table) -> pa.Table:
        text = rows["_text"][0].as_py()
        draw = lambda what: int(hashlib.md5("|".join([*([] if text is None else [text]), str(seed), what]).encode()).hexdigest()[:13], 16) / (1 << 52)
        hit = lambda what: draw(what + "?") < p
        place = lambda what, n: math.floor(draw(what) * n)
        y, x = (pc.fill_null(rows[c], -1).to_numpy() for c in "yx")
        own = (y >= 0) & (y < side) & (x >= 0) & (x < side)
        at = (y * side + x)[own]
        channel, known = pc.fill_null(rows["channel"], none).to_numpy()[own], rows["value"].is_valid().to_numpy()[own]
        value = pc.fill_null(rows["value"], 0.0).to_numpy()[own]
        if hit("swap"):
            first, second = place("swap1", channels), place("swap2", channels)
            channel = np.where(channel == first, second, np.where(channel == second, first, channel))
        if hit("light"):
            value = np.where(known, value * (1 + most * (2 * draw("contrast") - 1)) + most * (2 * draw("bright") - 1), 0.0)
        radius = 1 + place("blur", 3) if hit("blur") else 0

        def inside(what: str) -> np.ndarray:
            out = np.zeros((side, side), bool)
            top, left = place(what + "y", side), place(what + "x", side)
            height, width = (1 + place(what + c, min(hole, side)) for c in ("h", "w"))
            out[top : top + height, left : left + width] = True
            return out

        every = np.zeros((side, side), bool)
        if hit("hole"):
            every |= inside("hole1")
            if draw("holes") >= 0.5:
                every |= inside("hole2")
        one, single = (place("onechannel", channels), inside("one")) if hit("one") else (None, every)
        made = []
        for c in np.unique(channel).tolist():
            mine = channel == c
            there, valid = (np.bincount(at[some], minlength=side * side).reshape(side, side) for some in (mine, mine & known))
            plane = np.bincount(at[mine & known], value[mine & known], side * side).reshape(side, side)
            for axis in (0, 1) if radius else ():
                there, valid, plane = mean(there, axis, radius), mean(valid, axis, radius), mean(plane / (2 * radius + 1), axis, radius)
            plane = np.where(every | single if c == one else every, 0.0, plane)
            row, column = np.nonzero(there)
            empty = (valid == 0) & ~(every | single if c == one else every)
            made.append((np.full(len(row), c), row, column, plane[row, column], empty[row, column]))
        channel, y, x, value, empty = (np.concatenate([m[k] for m in made]) if made else np.zeros(0) for k in range(5))
        keys = rows[key].combine_chunks().take(pa.array(np.zeros(len(y), np.int64)))
        ints = [pa.array(channel.astype(np.int32), mask=channel == none), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32))]
        return pa.Table.from_arrays([keys, *ints, pa.array(value, pa.float64(), mask=empty.astype(bool))], names=[key, "channel", "y", "x", "value"])

    whole = pixels.select(key, *(F.col(c).cast("int").alias(c) for c in ("channel", "y", "x")), F.col("value").cast("double").alias("value"), F.col(key).cast("string").alias("_text"))
    ints = [T.StructField(c, T.IntegerType()) for c in ("channel", "y", "x")]
    return whole.groupBy(key).applyInArrow(augment, T.StructType([T.StructField(key, pixels.schema[key].dataType), *ints, T.StructField("value", T.DoubleType())]))


def blurred(raster: DataFrame, keys: list[str], axis: str, n: int) -> DataFrame:
    """The mean over 2 _r + 1 pixels along an axis, mirrored at the edges; _r is one of the keys. Each pixel goes to its readers."""
    r, c = F.col("_r"), F.col(axis)
    sources = F.filter(F.array(c, -1 - c, 2 * n - 1 - c), lambda s: (s >= -r) & (s < n + r))
    spread = raster.withColumn("_s", F.explode(sources)).withColumn("_to", F.explode(F.sequence(F.col("_s") - r, F.col("_s") + r))).where(f"_to >= 0 AND _to < {n}")
    other = [o for o in ("y", "x") if o != axis]
    return spread.groupBy(*keys, *other, F.col("_to").cast("int").alias(axis)).agg(F.sum(F.col("value") / (2 * r + 1)).alias("value"))


def augment_geometry(
    pixels: DataFrame, key: str, carried: list[str], side: int, seed: int, p: float = 0.5, p_scale: float = 0.75, flows: tuple[str, str] | None = None, mask: str | None = None, crop: int | None = None
) -> DataFrame:
    """Per sample, with probability p a rotation and a scale of 0.5 to 1.5 about the middle, then with probability p_scale another
    such scale; image and target columns (``carried``) move together and flow vectors (y, x) turn with them. Nearest neighbour:
    each destination pixel reads the source at the inverse map; outside the source it is padding, which is absent, that is 0.

    crop: afterwards a square of this side is cut out, around a pixel with ``mask`` > 0 that the sample's seed chooses (anywhere, if there
    is none), and moved to the origin."""
    draw = lambda what: unit(key, F.lit(seed), F.lit(what))
    turned, resized = draw("turn?") < p, draw("resize?") < p_scale
    angle = F.when(turned, 2 * math.pi * draw("angle")).otherwise(0.0)
    scale = F.when(turned, 0.5 + draw("scale")).otherwise(1.0) * F.when(resized, 0.5 + draw("resize")).otherwise(1.0)
    grid = dense_grid(pixels.select(key).distinct().withColumns({"_a": angle, "_s": scale}), side, side)
    middle = (side - 1) / 2
    dy, dx = F.col("y") - middle, F.col("x") - middle
    sy = F.round((F.cos("_a") * dy - F.sin("_a") * dx) / F.col("_s") + middle)
    sx = F.round((F.sin("_a") * dy + F.cos("_a") * dx) / F.col("_s") + middle)
    wanted = grid.select(key, "y", "x", "_a", sy.cast("int").alias("_sy"), sx.cast("int").alias("_sx"))
    source = pixels.select(key, F.col("y").alias("_sy"), F.col("x").alias("_sx"), *carried)
    # the planner takes the grid for small, since its estimates do not see what an explode adds, and would broadcast it
    out = wanted.hint("merge").join(source, [key, "_sy", "_sx"])
    if flows:
        fy, fx = F.col(flows[0]), F.col(flows[1])
        out = out.withColumns({flows[0]: F.cos("_a") * fy + F.sin("_a") * fx, flows[1]: -F.sin("_a") * fy + F.cos("_a") * fx})
    out = out.select(key, "y", "x", *carried)
    return out if crop is None else cropped(out, key, side, crop, seed, mask)


def cropped(pixels: DataFrame, key: str, side: int, crop: int, seed: int, mask: str | None) -> DataFrame:
    """A square of ``crop`` pixels of each sample that holds a chosen pixel of the mask, moved to the origin."""
    draw = lambda what: unit(key, F.lit(seed), F.lit(what))
    lit = F.lit(False) if mask is None else F.col(mask) > 0
    choice = F.struct(unit(key, "y", "x", F.lit(seed), F.lit("crop")).alias("u"), "y", "x")
    held = pixels.groupBy(key).agg(F.min(F.when(lit, choice)).alias("_c"))

    def origin(c: str) -> Column:
        free = F.floor(draw("crop" + c) * (side - crop + 1))
        around = F.greatest(F.lit(0), F.least(F.lit(side - crop), F.col(f"_c.{c}") - F.floor(draw("crop" + c) * crop)))
        return F.when(F.col("_c").isNull(), free).otherwise(around).cast("int")

    moved = pixels.join(held.select(key, origin("y").alias("_oy"), origin("x").alias("_ox")), key)
    moved = moved.withColumns({"y": F.col("y") - F.col("_oy"), "x": F.col("x") - F.col("_ox")}).drop("_oy", "_ox")
    return moved.where(f"y >= 0 AND y < {crop} AND x >= 0 AND x < {crop}")
