"""Planes of patches: points and shapes meet by patch as compact rows, numpy paints and compares their pixels there, and only results
become rows. A table of pixels that is joined costs a shuffle of every pixel, and the planner takes it for small, since its estimates
do not see what an explode adds."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rectangles of pixels (all ends included) with their label.
SPAN = ["label", "y0", "y1", "x0", "x1"]
#: Planes of more pixels are not made in one place.
PLANE = 1 << 22
TYPES = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}


def spans_of(pixels: DataFrame) -> DataFrame:
    """Pixels patch_id, y, x as spans; all have label 1."""
    return pixels.select("patch_id", F.lit(1).alias("label"), *(F.col(c).alias(f"{c}{end}") for c in "yx" for end in "01"))


def painted(side: int, label: np.ndarray, y0: np.ndarray, y1: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """The label of each pixel, the largest where spans lie over each other; 0 without any."""
    plane = np.zeros((side, side), np.int32)
    if (y0 == y1).all() and (x0 == x1).all():
        np.maximum.at(plane, (y0, x0), label)
        return plane
    order = np.argsort(label, kind="stable")
    for k, top, bottom, left, right in zip(*(v[order].tolist() for v in (label, y0, y1, x0, x1))):
        plane[top : bottom + 1, left : right + 1] = k
    return plane


def each_patch(layers: list[DataFrame], side: int, work: Callable[..., list], columns: dict[str, str], patches: DataFrame | None = None) -> DataFrame:
    """patch_id and the columns that ``work`` makes of each patch's planes, one for each layer of spans. Patches without any span have no
    rows, unless ``patches`` names them. Every span is shuffled once; a task holds the planes of one patch."""
    tagged = [spans.select(F.lit(k).alias("layer"), "patch_id", *(F.col(c).cast("int").alias(c) for c in SPAN)) for k, spans in enumerate(layers)]
    if patches is not None:
        tagged.append(patches.select(F.lit(-1).alias("layer"), "patch_id", *(F.lit(0).alias(c) for c in SPAN)))
    number = len(layers)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        layer, *spans = (rows[c].to_numpy() for c in ("layer", *SPAN))
        made = work(*(painted(side, *(v[layer == k] for v in spans)) for k in range(number)))
        arrays = [v if isinstance(v, pa.Array) else pa.array(np.asarray(v), TYPES[t]) for v, t in zip(made, columns.values(), strict=True)]
        patch = pa.array(np.full(len(arrays[0]), key[0].as_py()), pa.int32())
        return pa.Table.from_arrays([patch, *arrays], names=["patch_id", *columns])

    # few bytes become many pixels, so the number of tasks does not follow the bytes
    tasks = int(layers[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = reduce(DataFrame.unionByName, tagged).repartition(tasks, "patch_id")
    return every.groupBy("patch_id").applyInArrow(run, ", ".join(["patch_id int", *(f"{c} {t}" for c, t in columns.items())]))


def pixels_where(lit: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """y, x and the values of the pixels that are lit."""
    y, x = np.nonzero(lit)
    return [y, x, *(v[y, x] for v in values)]
