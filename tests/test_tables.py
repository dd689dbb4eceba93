import pytest
from pyspark.sql import functions as F

from tesserae.operators.tiling import Grid, assign_points_to_patches, points_in_box
from tesserae.sources import tables
from tesserae.streaming.points import read_point_stream, tile_stream, write_patch_stream

GRID = Grid(0, 0, 550, 300, 300, 50)


def points(spark):
    return spark.range(100).selectExpr("cast(id * 5.5 as double) AS x", "cast(id * 2 as double) AS y", "concat('G', id % 3) AS gene")


def test_place_on_the_curve_takes_turns_between_bits(spark):
    pairs = [(0.0, 0.0), (5.5, 3.0), (-1.0, 2.0), (123456.0, -654321.5), (1e30, -1e30)]
    got = spark.createDataFrame(pairs, "x double, y double").select(tables.curve_place(F.col("x"), F.col("y"), 0.5).alias("p"))
    bits = lambda v: min(max(int(v // 0.5) + 2**30, 0), 2**31 - 1)
    assert [r["p"] for r in got.collect()] == [sum((bits(x) >> k & 1) << 2 * k | (bits(y) >> k & 1) << 2 * k + 1 for k in range(31)) for x, y in pairs]


def test_a_box_reads_few_files_of_points_along_a_curve(spark, tmp_path):
    """Half of all points are in one small square; some have no coordinates."""
    spread = spark.range(20_000).selectExpr("cast(id * 7919 % 10007 / 10 as double) AS x", "cast(id * 104729 % 10009 / 10 as double) AS y", "id")
    dense = spark.range(20_000).selectExpr("cast(500 + id % 100 / 100 as double) AS x", "cast(500 + id % 89 / 89 as double) AS y", "id")
    own = spread.unionByName(dense).unionByName(spark.sql("SELECT cast(null as double) AS x, 1D AS y, -1L AS id"))
    path = str(tmp_path / "p")
    tables.write_clustered_points(own, path, 4.0, per_file=1000)
    back = spark.read.parquet(path)
    assert back.count() == 40_001 and back.exceptAll(own).isEmpty()
    sizes = [r["n"] for r in back.groupBy("_metadata.file_path").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) > 30 and max(sizes) <= 2000
    bounds = back.groupBy("_metadata.file_path").agg(*(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("x", "y"))).collect()
    for box in ((100, 100, 150, 150), (500, 500, 500.1, 500.1)):
        near = [b for b in bounds if b["min_x"] <= box[2] and b["max_x"] >= box[0] and b["min_y"] <= box[3] and b["max_y"] >= box[1]]
        assert len(near) * 5 <= len(bounds)
        held = points_in_box(back, *box)
        assert held.count() == points_in_box(own, *box).count() > 0
        assert held.select("_metadata.file_path").distinct().count() <= len(near)


def test_missing_columns(spark, tmp_path):
    points(spark).drop("gene").write.parquet(str(tmp_path / "p"))
    with pytest.raises(ValueError, match="gene"):
        tables.read_points(spark, str(tmp_path / "p"))


def test_csv_points(spark, tmp_path):
    points(spark).write.option("header", True).csv(str(tmp_path / "c"))
    assert tables.read_points(spark, str(tmp_path / "c"), format="csv").count() == 100


def test_layer_is_not_replaced(spark, tmp_path):
    tables.write_layer(points(spark), str(tmp_path / "l"))
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        tables.write_layer(points(spark), str(tmp_path / "l"))
    tables.write_layer(points(spark).limit(1), str(tmp_path / "l"), overwrite=True)
    assert spark.read.parquet(str(tmp_path / "l")).count() == 1


def test_only_missing_patches_are_computed(spark, tmp_path):
    patches = spark.createDataFrame([(0,), (1,), (2,)], "patch_id int")
    asked = []

    def compute(p):
        asked.append(sorted(r["patch_id"] for r in p.collect()))
        return p.selectExpr("patch_id", "patch_id * 10 AS feature")

    path = str(tmp_path / "cache")
    tables.materialize_missing(patches.where("patch_id < 2"), path, "a", compute)
    assert tables.materialize_missing(patches, path, "a", compute).count() == 3
    tables.materialize_missing(patches, path, "b", compute)
    assert asked == [[0, 1], [2], [0, 1, 2]]


def test_a_patch_without_features_is_computed_once(spark, tmp_path):
    patches, asked = spark.createDataFrame([(0,), (1,)], "patch_id int"), []

    def compute(p):
        asked.append(sorted(r["patch_id"] for r in p.collect()))
        return p.where("patch_id = 1").selectExpr("patch_id", "patch_id * 10 AS feature")

    path = str(tmp_path / "cache")
    for _ in range(2):
        assert tables.materialize_missing(patches, path, "a", compute).count() == 1
    assert asked == [[0, 1]]


def test_runs_that_overlap_give_each_patch_once(spark, tmp_path):
    patches, path, inner = spark.createDataFrame([(0,), (1,), (2,)], "patch_id int"), str(tmp_path / "cache"), []

    def compute(p):
        if not inner:  # another run begins and ends in the midst of this one
            inner.append(True)
            inner.append(sorted(map(tuple, tables.materialize_missing(patches.where("patch_id > 0"), path, "a", compute).collect())))
        return p.selectExpr("patch_id", f"patch_id * 10 + {len(inner)} AS feature")

    got = sorted(map(tuple, tables.materialize_missing(patches, path, "a", compute).collect()))
    assert inner[1] == [(1, 11), (2, 21)] and got == [(0, 2), (1, 11), (2, 21)]
    assert sorted(map(tuple, tables.materialize_missing(patches, path, "a", compute).collect())) == got


def test_a_run_that_was_cut_short_counts_for_nothing(spark, tmp_path):
    patches, path = spark.createDataFrame([(0,), (1,)], "patch_id int"), str(tmp_path / "cache")
    patches.selectExpr("patch_id", "-1 AS feature", "'a' AS experiment", "'cut' AS run").write.parquet(path)
    got = tables.materialize_missing(patches, path, "a", lambda p: p.selectExpr("patch_id", "patch_id AS feature"))
    assert sorted(map(tuple, got.collect())) == [(0, 0), (1, 1)]


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master = "local-cluster[2,1,1024]"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_dir(Session)


def test_stream_is_the_batch(spark, tmp_path):
    points(spark).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = tile_stream(read_point_stream(spark, str(tmp_path / "in")), GRID, box=(0, 0, 400, 300))
    write_patch_stream(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    batch = assign_points_to_patches(points(spark).where("x <= 400"), GRID)
    got = spark.read.parquet(str(tmp_path / "out")).select("patch_id", "x", "y", "gene")
    assert got.exceptAll(batch).isEmpty() and got.count() == batch.count()
