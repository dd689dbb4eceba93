"""What fails on large tables only: numbers that overflow, tables that are taken for small."""

from pyspark.sql import functions as F

from tesserae.operators import batching, tiling
from tesserae.operators.tiling import boxes


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def places(df):
    return sorted((r["y"], r["x"]) for r in df.collect())


def test_resizing_an_image_of_many_rows(spark):
    pixels = spark.createDataFrame([("a", 59_999, 1, 1.0)], "channel string, y int, x int, value double")
    got = places(tiling.resize_nearest(pixels, ["channel"], (60_000, 2), (90_000, 2)))
    assert got == [(89_999, 1)]


def test_the_grid_of_turned_samples_is_not_broadcast(spark):
    # a range, since its size is known
    pixels = spark.range(1).selectExpr("cast(id as int) AS patch_id", "3 AS y", "3 AS x", "1.0D AS value")
    turned = batching.augment_geometry(pixels, "patch_id", ["value"], 64, 8)
    assert "SortMergeJoin" in plan_of(turned) and "BroadcastHashJoin" not in plan_of(turned)


def test_rings_of_boxes_are_not_sent_to_cells(spark):
    own = boxes(spark.range(40).selectExpr("id AS k", "cast(id * 7 % 90 as double) AS cx", "cast(id * 5 % 60 as double) AS cy", "4.0D AS hw", "3.0D AS hh"), "k")
    shifted = own.withColumn("ring", F.concat(F.slice("ring", 2, 4), F.slice("ring", 1, 1)))
    plain = tiling.spatial_join(own.drop("ring"), own.drop("ring"))
    for other in (own, shifted):
        got = tiling.spatial_join(own, other)
        assert sorted(map(tuple, got.select("l_k", "r_k").collect())) == sorted(map(tuple, plain.select("l_k", "r_k").collect()))
        back = got.join(own.select(F.col("k").alias("l_k"), F.col("ring").alias("a")), "l_k").join(other.select(F.col("k").alias("r_k"), F.col("ring").alias("b")), "r_k")
        assert back.where("l_ring <> a OR r_ring <> b").isEmpty()
    assert "CASE WHEN NOT (" in plan_of(got) and "BroadcastHashJoin" not in plan_of(tiling.spatial_join(own, own))
