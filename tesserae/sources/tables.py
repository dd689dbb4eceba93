"""Sources and sinks: points, patch points, bounds, per-patch results, layers, cached features."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only a local session, in which driver and executors are one process, may fall back on a
    temporary folder; elsewhere a missing setting is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    path = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df into the shared folder and read it back, which ends its lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_points(spark: SparkSession, path: str, x: str = "x", y: str = "y", gene: str = "gene", format: str = "parquet") -> DataFrame:
    """Points as x, y, gene; only these columns are scanned. A missing column is an error."""
    reader = spark.read.format(format)
    table = (reader.option("header", True) if format == "csv" else reader).load(path)
    missing = {x, y, gene} - set(table.columns)
    if missing:
        raise ValueError(f"columns missing in {path}: {sorted(missing)}")
    return table.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(gene).cast("string").alias("gene"))


def write_patch_points(assigned: DataFrame, path: str) -> None:
    """One folder per patch. Rows are dealt by patch first, so a folder has few files; a patch too large for one task is split."""
    assigned.select("patch_id", "x", "y", "gene").hint("rebalance", "patch_id").write.partitionBy("patch_id").parquet(path)


def _spread(value: Column) -> Column:
    """The bits of a number below 2^31 with a zero between each two."""
    for shift in (16, 8, 4, 2, 1):
        value = F.shiftleft(value, shift).bitwiseOR(value).bitwiseAND(F.lit((2**64 - 1) // (2**shift + 1)))
    return value


def curve_place(x: Column, y: Column, unit: float) -> Column:
    """Place on the Z-shaped curve of the square of ``unit`` that holds a point. Squares beyond 2^30 of them from 0 count as the last."""
    square = lambda v: F.least(F.greatest(F.floor(v / unit), F.lit(-(2**30))), F.lit(2**30 - 1)).cast("long") + 2**30
    return _spread(square(x)).bitwiseOR(F.shiftleft(_spread(square(y)), 1))


def write_clustered_points(points: DataFrame, path: str, unit: float, per_file: int = 4_000_000) -> None:
    """Points along a curve through the plane, about ``per_file`` in a file, so that files and their row groups hold small regions and a
    box (points_in_box) leaves out most of them by their least and greatest x and y. Dense regions get more files: cuts are quantiles of
    the rows, within a square by x and y. Points without a coordinate come first. All columns are kept."""
    files = max(1, -(-points.count() // per_file))
    place = curve_place(F.col("x"), F.col("y"), unit)
    points.repartitionByRange(files, place, "x", "y").sortWithinPartitions(place, "x", "y").write.option("maxRecordsPerFile", 2 * per_file).parquet(path)


def bounds_table(patches: DataFrame) -> DataFrame:
    return patches.select(
        "patch_id",
        F.array("xmin", "ymin", "xmax", "ymax").alias("bounds"),
        F.col("xmin").alias("bounds_min_x"),
        F.col("ymin").alias("bounds_min_y"),
        F.col("xmax").alias("bounds_max_x"),
        F.col("ymax").alias("bounds_max_y"),
    )


def write_patch_bounds(patches: DataFrame, path: str) -> None:
    bounds_table(patches).write.json(path)


def read_patch_results(spark: SparkSession, path: str) -> DataFrame:
    """All patches' results of a folder; each row says which patch it is from."""
    return spark.read.parquet(path)


def write_layer(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Refuses to replace a layer unless ``overwrite``."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def materialize_missing(patches: DataFrame, cache: str, experiment: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Features of all patches: those cached for the experiment, and the rest computed and appended.

    A table beside the cache says which patches have been computed, those without any feature row too. It is written after
    their rows, each run's rows in a part of their own (column run), so a run that was cut short counts for nothing. Runs that
    overlap may compute a patch twice; every reader then takes the run that was first to say so (by time, then by name).
    """
    spark = patches.sparkSession
    own = F.col("experiment") == experiment
    done = _existing(spark, f"{cache}-done")
    missing = patches if done is None else patches.join(done.where(own).select("patch_id"), "patch_id", "left_anti")
    missing = durable(missing, "missing-patches")
    if not missing.isEmpty():
        run = uuid.uuid4().hex
        labels = {"experiment": F.lit(experiment), "run": F.lit(run)}
        compute(missing).withColumns(labels).write.mode("append").parquet(cache)
        missing.select("patch_id").withColumns(labels).withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{cache}-done")
    said = spark.read.parquet(f"{cache}-done").where(own).join(patches.select("patch_id"), "patch_id", "left_semi")
    runs = said.groupBy("patch_id").agg(F.min_by("run", F.struct("at", "run")).alias("run"))
    features = spark.read.parquet(cache).where(own).drop("experiment")
    return features.join(runs.select("patch_id", "run"), ["patch_id", "run"], "left_semi").drop("run")
