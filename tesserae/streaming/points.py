"""The tiling steps on unbounded points. They are column maps, so a stream needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.operators.tiling import Grid, affine_transform, assign_points_to_patches, points_in_box


def read_point_stream(spark: SparkSession, folder: str, schema: str = "x double, y double, gene string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def tile_stream(points: DataFrame, grid: Grid, affine: tuple[float, ...] | None = None, box: tuple[float, ...] | None = None) -> DataFrame:
    moved = affine_transform(points, *affine) if affine else points
    return assign_points_to_patches(points_in_box(moved, *box) if box else moved, grid)


def write_patch_stream(assigned: DataFrame, folder: str, checkpoint: str):
    """Appends each micro-batch to the patches' folders; the checkpoint makes it exactly once."""
    return assigned.writeStream.format("parquet").partitionBy("patch_id").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
