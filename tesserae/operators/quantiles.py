"""Exact percentiles by rank selection, without a task that holds a group's values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.sources.tables import durable


def percentiles(df: DataFrame, value: str, by: list[str], fractions: list[float]) -> DataFrame:
    """by, and ``percentiles``: an array of the linearly interpolated percentiles of a group's values that are not null.

    Equal values are counted first. Values are dealt by ranges of (group, value), so a range's place in its group follows from the counts of
    the ranges before it, and only the ranges that hold a wanted rank are summed value by value. A group without values has no row.
    """
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*by) if by else F.lit(0)
    counted = df.where(F.col(value).isNotNull()).groupBy(key.alias("_k"), F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranged = durable(counted.repartitionByRange(tasks, "_k", "_v").withColumn("_part", F.spark_partition_id()), "ranges")
    own = W.partitionBy("_k").orderBy("_part")
    # a row for each group and range
    runs = ranged.groupBy("_k", "_part").agg(F.sum("_n").alias("_run"))
    runs = runs.withColumns({"_before": F.sum("_run").over(own) - F.col("_run"), "_all": F.sum("_run").over(W.partitionBy("_k"))})
    wanted = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(f)).alias("f")) for i, f in enumerate(fractions))))
    place = F.col("_w.f") * (F.col("_all") - 1)
    ranks = runs.withColumn("_w", wanted).select("_k", "_part", "_run", "_before", F.col("_w.i").alias("_i"), (place - F.floor(place)).alias("_share"), F.explode(F.array(F.floor(place), F.ceil(place))).alias("_rank"))
    ranks = durable(ranks.distinct().where("_rank >= _before AND _rank < _before + _run"), "ranks")
    reached = W.partitionBy("_k", "_part").orderBy("_v")
    near = ranged.join(ranks.select("_k", "_part").distinct(), ["_k", "_part"], "left_semi").withColumn("_to", F.sum("_n").over(reached))
    found = ranks.join(near, ["_k", "_part"]).where("_rank >= _before + _to - _n AND _rank < _before + _to")
    # the lower and the higher of two neighbours; one row if they are the same
    ends = found.groupBy("_k", "_i").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.first("_share").alias("_share"))
    lists = ends.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_i", (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_share")).alias("v")))).alias("_l"))
    return lists.select(*(F.col(f"_k.{c}").alias(c) for c in by), F.col("_l.v").alias("percentiles"))
