"""Patches painted and compared in one place, against tables of pixels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import density, genes, planes, segmentation, targets, tiling
from tesserae.operators.tiling import Grid, boxes

GRID = Grid(0, 0, 40, 40, 20, 0)
SIDE = 20


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or sorted(df.columns)) for r in df.collect())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def slide(spark):
    """Boxes that lie over each other and over the edges of patches, and pixels with points in three of four patches."""
    made = spark.range(30).selectExpr("cast(id as int) AS cell_id", "cast((id * 13) % 41 as double) AS cx", "cast((id * 29) % 39 as double) AS cy", "cast(2 + id % 3 as double) AS hw", "cast(1.5 + id % 4 as double) AS hh")
    points = spark.range(150).selectExpr("cast((id * 7) % 40 + 0.5 as double) AS x", "cast((id * 11) % 23 + 0.5 as double) AS y").where("x < 20 OR y < 20")
    return boxes(made, "cell_id"), density.presence_raster(tiling.assign_points_to_patches(points, GRID), GRID)


def test_painted_boxes_are_not_shuffled_as_pixels(spark, slide):
    cells, _ = slide
    got = tiling.rasterize_polygons(cells, GRID, "cell_id")
    assert rows(got) == rows(tiling.rasterize_polygons(cells, GRID, "cell_id", boxes=False))
    assert "FlatMapGroupsInArrow" in plan_of(got) and "sequence(y0" not in plan_of(got)


def test_a_box_of_one_pixel_beside_others(spark):
    spans = spark.createDataFrame([(0, 1, 0, 0, 0, 0), (0, 3, 0, 0, 0, 0), (0, 2, 0, 0, 0, 0)], "patch_id int, label int, y0 int, y1 int, x0 int, x1 int")
    got = planes.each_patch([spans], 4, lambda label: planes.pixels_where(label > 0, label), {"y": "int", "x": "int", "label": "int"})
    assert rows(got, "y", "x", "label") == [(0, 0, 3)]


def test_a_smoothed_pixel_is_shuffled_once(spark, slide):
    raster = slide[1].withColumn("value", F.lit(1.0))
    got = density.gaussian_smooth(raster, ["patch_id"], SIDE, SIDE, 1.0)
    weights = density.kernel(1.0)
    want = rows(density._smooth_axis(density._smooth_axis(raster, ["patch_id"], "y", SIDE, weights), ["patch_id"], "x", SIDE, weights), "patch_id", "y", "x", "value")
    for a, b in zip(rows(got, "patch_id", "y", "x", "value"), want, strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3])
    assert "Generate" not in plan_of(density.gaussian_smooth(spark.createDataFrame([(1, 1, 1, 1.0)], "k int, y int, x int, value double"), ["k"], 9, 9, 1.0))


def test_smoothing_keeps_pixels_that_come_to_zero(spark):
    raster = spark.createDataFrame([(1, 3, 3, 0.0)], "k int, y int, x int, value double")
    assert density.gaussian_smooth(raster, ["k"], 9, 9, 0.5).count() == 25


def test_means_and_background_as_by_tables(spark, slide):
    cells, raster = slide
    smooth = density.gaussian_smooth(raster.withColumn("value", F.lit(1.0)), ["patch_id"], SIDE, SIDE, 1.0)
    labels = tiling.rasterize_polygons(cells, GRID, "cell_id")
    means = density.means_of_shapes(raster, tiling.polygon_spans(cells, GRID, "cell_id"), SIDE, 1.0)
    want = rows(density.mean_density_per_polygon(labels, smooth), "patch_id", "label", "mean_density")
    assert 0.0 in {m for *_, m in want}
    for a, b in zip(rows(means, "patch_id", "label", "mean_density"), want, strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2])
    patches = tiling.patch_grid(spark, GRID)
    empty = density.background_of_points(raster, patches, SIDE, 1.0, 0.05)
    assert rows(empty, "patch_id", "y", "x") == rows(density.background_mask(patches, smooth, SIDE, 0.05), "patch_id", "y", "x")
    assert "Join" not in plan_of(empty) and "Join" not in plan_of(means)


def same(got, want, *columns):
    for a, b in zip(rows(got, *columns), rows(want, *columns), strict=True):
        assert a == pytest.approx(b)
    assert "Join" not in plan_of(got)


def test_masks_of_shapes_as_by_tables(spark, slide):
    cells, raster = slide
    smooth = density.gaussian_smooth(raster.withColumn("value", F.lit(1.0)), ["patch_id"], SIDE, SIDE, 1.0)
    patches = tiling.patch_grid(spark, GRID)
    empty = density.background_mask(patches, smooth, SIDE, 0.15)
    own = [cells.where(f"cell_id % 4 = {k}") for k in (3, 1, 2)]
    spans, labels = ([f(c, GRID, "cell_id") for c in [cells, *own]] for f in (tiling.polygon_spans, tiling.rasterize_polygons))
    background = (SIDE, 1.0, 0.15)
    same(targets.background_fractions(raster, spans[0], *background), targets.label_background_fraction(labels[0], empty), "patch_id", "label", "fraction")
    same(targets.foreground_labels(raster, spans[0], *background, 0.5), targets.drop_background_labels(labels[0], empty, 0.5), "patch_id", "y", "x", "label")
    masked = targets.mask_target(smooth.withColumn("channel", F.lit(0)), labels[0], empty, keep_label=True)
    same(targets.masked_density(raster, spans[0], *background), masked, "patch_id", "channel", "y", "x", "value")
    same(targets.corrected_empty(raster, patches, spans[1:], *background), targets.corrected_background(empty, labels[1:]), "patch_id", "y", "x")
    same(targets.gradient_planes(raster, patches, spans[1:], *background), targets.gradient_mask(*labels[1:], empty), "patch_id", "y", "x", "mask")


def test_merged_layers_need_no_join_of_pixels(spark, slide):
    cells, _ = slide
    own = [cells.where(f"cell_id % 4 = {k}") for k in (3, 1, 2)]
    merged = targets.merge_shape_layers(*(tiling.polygon_spans(c, GRID, "cell_id") for c in own), SIDE)
    want = targets.merge_label_layers(*(tiling.rasterize_polygons(c, GRID, "cell_id") for c in own))
    same(merged, want, "patch_id", "y", "x", "label")
    assert "LeftAnti" not in plan_of(want)


@pytest.mark.parametrize("line", [1, 2, 3, 4, 5])
def test_contours_of_shapes_as_by_tables(spark, slide, line):
    cells, _ = slide
    want = targets.cell_contours(tiling.rasterize_polygons(cells, GRID, "cell_id"), SIDE, line, 4)
    same(targets.contours_of_shapes(tiling.polygon_spans(cells, GRID, "cell_id"), SIDE, line, 4), want, "patch_id", "y", "x", "value")
    assert "Join" not in plan_of(want)


def test_cells_of_shapes_as_by_tables(spark, slide):
    cells, _ = slide
    labels, spans = tiling.rasterize_polygons(cells, GRID, "cell_id"), tiling.polygon_spans(cells, GRID, "cell_id")
    columns = ["patch_id", "label", "area", "xmin", "ymin", "xmax", "ymax", "cx", "cy"]
    same(segmentation.measures_of_shapes(spans, SIDE), segmentation.label_measures(labels), *columns)
    got, want = segmentation.cells_of_shapes(spans, SIDE), segmentation.labels_to_cells(labels)
    assert rows(got, *columns, "rings", "ring") == rows(want, *columns, "rings", "ring") and "Join" not in plan_of(got)
    same(targets.sizes_of_shapes(spans, SIDE, 5), targets.label_sizes(targets.drop_small(labels, 5)), "patch_id", "label", "size")


def crowd(spark):
    return spark.range(400).selectExpr("cast(id % 3 as int) AS patch_id", "cast((id * 7) % 11 as int) AS y", "cast((id * 5) % 12 as int) AS x", "concat('G', id * 13 % 5) AS gene", "(id * 31) % 101 AS k", "id AS id")


def test_inputs_of_planes_as_by_scattering(spark, monkeypatch):
    """Few copies of a pixel are shuffled; larger planes take the other way, with the same rows."""
    vectors = spark.createDataFrame([(f"G{k}", [k - 2.0, 1.5 * k]) for k in range(4)], "gene string, value array<double>")
    points, known = crowd(spark), crowd(spark).where("gene <> 'G4'")
    raster = genes.rna_image(known, ["patch_id"], vectors)
    made = lambda: [
        genes.max_filter(raster, ["patch_id", "channel"], 12, 12, 3),
        genes.rna_input(known, ["patch_id"], 12, vectors),
        genes.stamp_embeddings(points, ["patch_id"], vectors, 12, 1, ["k", "id"], 2),
        genes.stamp_embeddings(points, ["patch_id"], vectors, 12, 1, ["k", "id"], 2, 0.5),
    ]
    got = made()
    assert all("Generate explode(array_distinct" not in plan_of(df) and "explode([[" not in plan_of(df) for df in got)
    got = [rows(df, "patch_id", "channel", "y", "x", "value") for df in got]
    for module in (genes, density):
        monkeypatch.setattr(module, "PLANE", 0)
    for a, b in zip(got, made()):
        for p, q in zip(a, rows(b, "patch_id", "channel", "y", "x", "value"), strict=True):
            assert p == pytest.approx(q)
