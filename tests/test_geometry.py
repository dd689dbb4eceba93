"""Small cases with answers known by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions.geometry import area_of, box_ring, intersection_area, outline_of_union, overlap_areas, pixel_rings, polygon_area, polygon_centroid, with_bbox
from tesserae.operators import batching, curation, density, genes, segmentation, targets, tiling
from tesserae.operators.tiling import Grid

L_SHAPE = np.array([(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)], float)


def clip(polygon: np.ndarray, nx: float, ny: float, c: float) -> np.ndarray:
    """The part of a polygon with nx x + ny y <= c."""
    if not len(polygon):
        return polygon
    side = polygon @ np.array([nx, ny]) - c
    out = []
    for i in range(len(polygon)):
        j = (i + 1) % len(polygon)
        if side[i] <= 0:
            out.append(polygon[i])
        if (side[i] < 0 < side[j]) or (side[j] < 0 < side[i]):
            out.append(polygon[i] + (polygon[j] - polygon[i]) * (side[i] / (side[i] - side[j])))
    return np.array(out).reshape(-1, 2)


def overlap_area(a: np.ndarray, b: np.ndarray) -> float:
    return float(overlap_areas([a], [b])[0])


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_grid():
    assert (Grid(0, 0, 4000, 4000, 1200, 150).nx, Grid(0, 0, 4000, 4000, 1200, 150).ny) == (4, 4)
    assert Grid(0, 0, 10, 10, 300, 50).nx == 1


def test_patch_5_of_16(spark):
    patch = tiling.patch_grid(spark, Grid(0, 0, 4000, 4000, 1200, 150)).where("patch_id = 5").first()
    assert (patch["xmin"], patch["ymin"], patch["xmax"], patch["ymax"]) == (1050, 1050, 2250, 2250)


def test_point_on_a_shared_edge_is_in_both_patches(spark):
    points = spark.createDataFrame([(250.0, 10.0), (300.0, 10.0), (301.0, 10.0), (-1.0, 10.0)], "x double, y double")
    got = rows(tiling.assign_points_to_patches(points, Grid(0, 0, 550, 300, 300, 50)), "x", "patch_id")
    assert got == [(250.0, 0), (250.0, 1), (300.0, 0), (300.0, 1), (301.0, 1)]


def test_tiles_without_overlap_cover_once(spark):
    points = spark.range(200).selectExpr("cast(id * 4.9 + 0.05 as double) AS x", "5.5D AS y")
    assert tiling.assign_points_to_patches(points, Grid(0, 0, 1000, 100, 100, 0)).count() == 200


def test_l_shape():
    box = np.array([(0, 0), (2, 0), (2, 2), (0, 2)], float)
    assert overlap_area(L_SHAPE, box) == pytest.approx(3) and overlap_area(box, L_SHAPE[::-1]) == pytest.approx(3)
    assert overlap_area(L_SHAPE, box + 2) == pytest.approx(0)


def test_ring_measures(spark):
    ring = [{"x": float(x), "y": float(y)} for x, y in L_SHAPE]
    df = spark.createDataFrame([(ring, ring)], "a array<struct<x: double, y: double>>, b array<struct<x: double, y: double>>")
    got = df.select(polygon_area(F.col("a")).alias("area"), polygon_centroid(F.col("a")).alias("c"), intersection_area("a", "b").alias("same")).first()
    assert got["area"] == 7 and got["same"] == pytest.approx(7)
    assert got["c"]["x"] == pytest.approx(got["c"]["y"]) == pytest.approx((4 * 2 + 3 * 0.5) / 7)


def box_frame(spark, key, items):
    df = spark.createDataFrame([(i, *map(float, b)) for i, b in items], f"{key} long, xmin double, ymin double, xmax double, ymax double")
    return df.withColumn("ring", box_ring(*(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))))


def test_ratios_at_the_thresholds(spark):
    cells = box_frame(spark, "cell_id", [(1, (0, 0, 95, 10)), (2, (200, 0, 205, 10)), (3, (400, 0, 410, 10)), (4, (600, 0, 650, 10))])
    nuclei = box_frame(spark, "nucleus_id", [(1, (0, 0, 100, 10)), (2, (200, 0, 300, 10)), (3, (410, 0, 420, 10)), (4, (600, 0, 700, 10))])
    for plain in (True, False):
        pairs = curation.classify_pairs(curation.overlap_ratio(cells, nuclei, plain))
        assert rows(pairs, "cell_id", "nucleus_id", "status") == [(1, 1, "keep"), (2, 2, "ignore"), (3, 3, "ignore"), (4, 4, "remove")]


def test_nuclei_cut_by_several_cells(spark):
    cells = box_frame(spark, "cell_id", [(1, (0, 0, 5, 10)), (2, (5, 0, 10, 10)), (3, (50, 0, 60, 10))])
    nuclei = box_frame(spark, "nucleus_id", [(1, (0, 0, 10, 10)), (2, (52, 2, 54, 4))])
    target = curation.consistent_target(cells, nuclei, max_intersecting=1)
    assert rows(target, "layer", "shape_id") == [("in_cell", 2), ("inconsistent", 1), ("inconsistent", 2), ("with_nuclei", 3)]
    assert ("not_in_cell", 1) in rows(curation.consistent_target(cells, nuclei, max_intersecting=2), "layer", "shape_id")
    with pytest.raises(ValueError):
        curation.cell_status(cells, nuclei, {0, 1})


def test_no_pair_comes_twice(spark):
    big = box_frame(spark, "k", [(1, (0, 0, 200, 200)), (2, (10, 10, 190, 190))])
    assert tiling.spatial_join(big, big).count() == 4


@pytest.mark.parametrize("plain", [True, False])
def test_rasters_of_boxes_and_rings_agree(spark, plain):
    shapes = box_frame(spark, "k", [(1, (1, 1, 3, 3)), (2, (2.5, 2, 4, 3.5))])
    got = rows(tiling.rasterize_polygons(shapes, Grid(0, 0, 10, 10, 10, 0), "k", plain), "y", "x", "label")
    assert got == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (2, 2, 2), (2, 3, 2), (3, 2, 2), (3, 3, 2)]


def test_presence_is_one_and_counts_add(spark):
    points = spark.createDataFrame([(1.2, 3.4, "A"), (1.9, 3.9, "A")], "x double, y double, gene string")
    own = tiling.assign_points_to_patches(points, Grid(0, 0, 10, 10, 10, 0))
    assert rows(density.presence_raster(own, Grid(0, 0, 10, 10, 10, 0)), "y", "x") == [(3, 1)]
    placed = own.select("patch_id", "gene", F.lit(3).alias("y"), F.lit(1).alias("x"))
    assert rows(genes.rna_image(placed, ["patch_id"]), "value") == [(2.0,)]


def test_maximum_of_two_reaches_the_next_pixel(spark):
    one = spark.createDataFrame([(4, 4, 1.0)], "y int, x int, value double")
    assert rows(genes.max_filter(one, [], 10, 10, 2), "y", "x") == [(4, 4), (4, 5), (5, 4), (5, 5)]


@pytest.mark.parametrize("sigma", [0.5, 1.0])
def test_small_and_large_kernels_agree(spark, sigma, monkeypatch):
    raster = spark.createDataFrame([(1, 0, 0, 1.0), (1, 5, 7, 2.0), (2, 9, 9, 1.0)], "k int, y int, x int, value double")
    small = {r[:3]: r[3] for r in rows(density.gaussian_smooth(raster, ["k"], 10, 10, sigma), "k", "y", "x", "value")}
    weights = density.kernel(sigma)
    padded = np.concatenate([weights, np.zeros(20)])[: len(weights) + 20]
    monkeypatch.setattr(density, "kernel", lambda s: np.concatenate([np.zeros(5), padded[: len(weights)], np.zeros(5)]))
    large = {r[:3]: r[3] for r in rows(density.gaussian_smooth(raster, ["k"], 10, 10, sigma), "k", "y", "x", "value")}
    assert {k: pytest.approx(v) for k, v in small.items() if v > 1e-12} == {k: v for k, v in large.items() if v > 1e-12}
    assert sum(v for k, v in small.items() if k[0] == 1) == pytest.approx(3)


def test_percentile_is_linear(spark):
    means = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 4.0)], "mean_density double")
    assert density.density_threshold(means, 50).first()[0] == 2.5


def test_labels_in_the_background(spark):
    labels = spark.createDataFrame([(0, 0, x, 1) for x in range(20)] + [(0, 1, x, 2) for x in range(20)], "patch_id int, y int, x int, label int")
    background = spark.createDataFrame([(0, 0, 3)] + [(0, 1, x) for x in range(20)], "patch_id int, y int, x int")
    assert {r["label"] for r in targets.drop_background_labels(labels, background, 0.05).collect()} == {1}


def test_chain_of_cells_is_one_group(spark):
    cells = box_frame(spark, "cell_id", [(1, (0, 0, 10, 10)), (2, (5, 0, 15, 10)), (3, (10, 0, 20, 10)), (4, (50, 0, 60, 10))])
    groups = segmentation.resolve_conflicts(cells)
    assert rows(groups, "cell_id", "group") == [(1, 1), (2, 1), (3, 1), (4, 4)]
    merged = segmentation.union_groups(groups)
    assert rows(merged, "group", "n_cells", "area") == [(1, 3, 200), (4, 1, 100)]
    ring = merged.where("n_cells = 3").first()["ring"]
    assert sorted((p["x"], p["y"]) for p in ring) == [(0, 0), (0, 10), (20, 0), (20, 10)]


def test_a_lone_cell_stays_as_it_is(spark):
    cells = box_frame(spark, "cell_id", [(1, (0.5, 0.5, 10.5, 10.5)), (2, (100, 0, 110, 10)), (3, (104, 0, 114, 10))])
    merged = {r["group"]: r for r in segmentation.union_groups(segmentation.resolve_conflicts(cells, boxes=False)).collect()}
    assert merged[1]["area"] == 100 and [(p["x"], p["y"]) for p in merged[1]["ring"]] == [(0.5, 0.5), (10.5, 0.5), (10.5, 10.5), (0.5, 10.5)]
    assert merged[2]["n_cells"] == 2 and merged[2]["area"] == pytest.approx(140)


def test_cells_below_the_threshold_stay_apart(spark):
    cells = box_frame(spark, "cell_id", [(1, (0, 0, 10, 10)), (2, (7.5, 0, 17.5, 10)), (3, (100, 0, 110, 10)), (4, (107.6, 0, 117.6, 10))])
    assert rows(segmentation.resolve_conflicts(cells), "cell_id", "group") == [(1, 1), (2, 1), (3, 3), (4, 4)]


RNG = np.random.default_rng(8)


def star(corners, cx=0.0, cy=0.0, size=10.0):
    """A simple polygon: corners at rising angles, with gaps below half a turn."""
    angle = (np.arange(corners) + RNG.uniform(0, 0.4, corners)) * 2 * np.pi / corners
    reach = RNG.uniform(0.3, 1, corners) * size
    return np.stack([cx + reach * np.cos(angle), cy + reach * np.sin(angle)], axis=1)


@pytest.mark.parametrize("corners", [4, 7, 12])
def test_union_of_polygons_by_areas(corners):
    """area(A or B) = area(A) + area(B) - area(A and B), of rings anywhere."""
    for _ in range(30):
        a, b = star(corners), star(corners + 1, *RNG.uniform(-6, 6, 2))
        rings = outline_of_union([a, b])
        assert sum(map(area_of, rings)) == pytest.approx(area_of(a) + area_of(b) - overlap_area(a, b), rel=1e-6)


def test_many_overlaps_as_triangle_by_triangle():
    def one(a, b):
        total = 0.0
        for i in range(1, len(b) - 1):
            triangle = b[[0, i, i + 1]]
            sign, part = np.sign(area_of(triangle)), a
            for p, q in zip(triangle, np.roll(triangle, -1, axis=0)):
                nx, ny = sign * (q[1] - p[1]), -sign * (q[0] - p[0])
                part = clip(part, nx, ny, nx * p[0] + ny * p[1])
            total += sign * abs(area_of(part))
        return abs(total)

    a, b = [star(int(n)) for n in RNG.integers(3, 12, 60)], [star(int(n), *RNG.uniform(-12, 12, 2)) for n in RNG.integers(3, 12, 60)]
    assert overlap_areas(a, b) == pytest.approx([one(x, y) for x, y in zip(a, b)])
    assert overlap_areas(a, b, most=500) == pytest.approx(overlap_areas(a, b)) and overlap_areas([], []).tolist() == []


def test_unions_that_share_edges_and_leave_holes():
    box = lambda x0, y0, x1, y1: np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], float)
    beside = outline_of_union([box(0, 0, 2, 2), box(2, 0, 4, 2)])
    assert len(beside) == 1 and sorted(map(tuple, beside[0])) == [(0, 0), (0, 2), (4, 0), (4, 2)]
    same = outline_of_union([box(0, 0, 2, 2), box(0, 0, 2, 2)])
    assert len(same) == 1 and area_of(same[0]) == 4
    within = outline_of_union([box(0, 0, 9, 9), box(3, 3, 5, 5)[::-1]])
    assert len(within) == 1 and area_of(within[0]) == 81
    frame = outline_of_union([box(0, 0, 9, 2), box(0, 7, 9, 9), box(0, 0, 2, 9), box(7, 0, 9, 9)])
    assert sorted(round(area_of(r), 6) for r in frame) == [-25, 81]
    shifted = outline_of_union([box(1, 1, 11, 11), box(1.5, 1, 11.5, 11)])
    assert len(shifted) == 1 and area_of(shifted[0]) == pytest.approx(105) and len(shifted[0]) == 4


def pixels_by_clipping(ring):
    """Pixels of which a polygon covers more than rounding."""
    (x0, y0), (x1, y1) = np.floor(ring.min(axis=0)).astype(int), np.ceil(ring.max(axis=0)).astype(int)
    rows = {y: clip(clip(ring, 0, -1, -y), 0, 1, y + 1) for y in range(y0, y1)}
    return {(y, x) for y, row in rows.items() for x in range(x0, x1) if abs(area_of(clip(clip(row, -1, 0, -x), 1, 0, x + 1))) > 1e-12}


def test_pixels_of_rings_as_by_clipping(spark):
    """Stars, an L, boxes on and off whole numbers; whole, and cut to a patch that holds a part of them."""
    shapes = [star(corners, *RNG.uniform(20, 80, 2), size=size) for corners in (3, 5, 9, 30) for size in (0.4, 6, 25)]
    shapes += [L_SHAPE + 10, L_SHAPE[::-1] * 3.5 + 30.25, np.array([(5, 5), (9, 5), (9, 8), (5, 8)], float)]
    # a hundred columns for each, so that none covers another
    shapes = [ring + [100 * k, 0] for k, ring in enumerate(shapes)]
    own = ring_frame(spark, "key", list(enumerate(shapes)))
    want = set().union(*map(pixels_by_clipping, shapes))
    for grid in (Grid(0, 0, 1500, 100, 1500, 0), Grid(0, 0, 1520, 120, 40, 0)):
        found = [(r["y"] + r["patch_id"] // grid.nx * grid.width, r["x"] + r["patch_id"] % grid.nx * grid.width) for r in tiling.rasterize_polygons(own, grid, "key", boxes=False).collect()]
        assert len(found) == len(want) and set(found) == want


def test_rings_need_no_python_to_become_pixels(spark):
    plan = tiling.rasterize_polygons(ring_frame(spark, "key", [(1, L_SHAPE)]), Grid(0, 0, 40, 40, 40, 0), "key", boxes=False)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def outlines(y: np.ndarray, x: np.ndarray) -> list[list[tuple[float, float]]]:
    """The rings of pixel edges around a set of pixels, corners only, edge by edge."""
    own = set(zip(y.tolist(), x.tolist()))
    edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r, c in own:
        for start, end, beyond in (((c, r), (c + 1, r), (r - 1, c)), ((c + 1, r), (c + 1, r + 1), (r, c + 1)), ((c + 1, r + 1), (c, r + 1), (r + 1, c)), ((c, r + 1), (c, r), (r, c - 1))):
            if beyond not in own:
                edges.setdefault(start, []).append(end)
    rings = []
    while edges:
        at = min(edges)
        ring, way = [at], None
        while at in edges:
            ends = edges[at]
            # where two pixels touch at a corner only, turn left so that the ring stays with its pixel
            ends.sort(key=lambda e: 0 if way is None else (e[0] - at[0]) * way[1] - (e[1] - at[1]) * way[0])
            end = ends.pop(0)
            if not ends:
                del edges[at]
            way, at = (end[0] - at[0], end[1] - at[1]), end
            ring.append(at)
        ring = ring[:-1]
        rings.append([(float(p[0]), float(p[1])) for o, p, q in zip([ring[-1], *ring], ring, [*ring[1:], ring[0]]) if (p[0] - o[0]) * (q[1] - p[1]) != (p[1] - o[1]) * (q[0] - p[0])])
    return rings


def turned(ring):
    k = ring.index(min(ring))
    return tuple(ring[k:] + ring[:k])


def test_rings_of_labels_as_edge_by_edge():
    """Labels that meet, with holes, islands in them, single pixels and corners that touch."""
    for density in (0.3, 0.6, 0.9):
        field = RNG.integers(1, 4, (25, 30)) * (RNG.random((25, 30)) < density)
        y, x = np.nonzero(field)
        order = RNG.permutation(len(y))
        y, x = y[order], x[order]
        label, begins, corners = pixel_rings(field[y, x], y, x)
        got = sorted((int(k), turned([tuple(c) for c in corners[a:b].tolist()])) for k, a, b in zip(label, begins, begins[1:]))
        assert got == sorted((k, turned(r)) for k in (1, 2, 3) for r in outlines(*np.nonzero(field == k)))
        sizes = {k: sum(area_of(corners[a:b]) for own, a, b in zip(label, begins, begins[1:]) if own == k) for k in (1, 2, 3)}
        assert sizes == {k: (field == k).sum() for k in (1, 2, 3)}


def ring_frame(spark, key, items):
    rings = [(i, [{"x": float(x), "y": float(y)} for x, y in ring]) for i, ring in items]
    return with_bbox(spark.createDataFrame(rings, f"{key} long, ring array<struct<x: double, y: double>>"))


SHAPES = [
    (1, [(0, 0), (10, 0), (0, 10)]),  # a triangle
    (2, [(8, 8), (12, 8), (12, 12), (8, 12)]),  # its bounding box meets the triangle's, it does not
    (3, [(5, 5), (9, 5), (9, 9), (5, 9)]),  # touches the long side in a point
    (4, [(1, 1), (2, 1), (2, 2), (1, 2)]),  # inside the triangle
    (5, [(20, 0), (30, 0), (30, 10), (20, 10), (20, 8), (28, 8), (28, 2), (20, 2)]),  # a hook
    (6, [(22, 4), (24, 4), (24, 6), (22, 6)]),  # in the hook's mouth
]


def test_pairs_that_meet_exactly(spark):
    shapes = ring_frame(spark, "k", SHAPES)
    pairs = tiling.spatial_join(shapes, shapes, 7.0).where("l_k < r_k")
    assert rows(pairs, "l_k", "r_k") == [(1, 3), (1, 4), (2, 3)]


def test_shapes_in_a_box_exactly(spark):
    shapes = ring_frame(spark, "k", SHAPES)
    assert rows(tiling.shapes_in_box(shapes, 6, 6, 8.5, 8.5), "k") == [(2,), (3,)]
    assert rows(tiling.shapes_in_box(shapes, 22, 3, 26, 7), "k") == [(6,)]
    assert rows(tiling.shapes_in_box(shapes, -5, -5, 50, 50), "k") == [(k,) for k in range(1, 7)]


def test_patches_by_exact_shapes(spark):
    grid = Grid(0, 0, 40, 20, 10, 0)
    triangle = ring_frame(spark, "k", [(1, [(1, 1), (19, 1), (1, 19)])])
    assert rows(tiling.patches_hit_by(grid, triangle), "patch_id") == [(0,), (1,), (4,), (5,)]
    small = ring_frame(spark, "k", [(1, [(1, 1), (17, 1), (1, 17)])])
    assert rows(tiling.patches_hit_by(grid, small), "patch_id") == [(0,), (1,), (4,)]
    counts = spark.createDataFrame([(k, 1) for k in range(8)], "patch_id int, n_points long")
    patches = tiling.patch_grid(spark, grid)
    assert rows(tiling.valid_patches(patches, counts, small, grid, 40, 20, 1, 0), "patch_id") == [(0,), (1,), (4,)]


def test_places_without_a_single_task(spark):
    ids = spark.range(1000).selectExpr("cast((id * 37) % 1000 as int) AS patch_id").repartition(7)
    assert rows(batching.numbered(ids, "patch_id", "n"), "patch_id", "n") == [(k, k) for k in range(1000)]


def test_threshold_of_a_dataset_skips_empty_patches(spark):
    grid = Grid(0, 0, 60, 20, 20, 0)
    points = spark.createDataFrame([(float(x % 20), float(x % 7)) for x in range(40)] + [(45.0, 5.0)], "x double, y double")
    cells = box_frame(spark, "cell_id", [(1, (2, 2, 6, 6)), (2, (42, 2, 46, 6)), (3, (25, 2, 28, 6))])
    own = tiling.assign_points_to_patches(points, grid)
    got = density.dataset_threshold(own, cells, grid, "cell_id", sigma=2.0, percentile=50).first()[0]
    raster = density.presence_raster(own.where("patch_id = 0"), grid).withColumn("value", F.lit(1.0))
    dense = np.zeros((20, 20))
    for r in raster.collect():
        dense[r["y"], r["x"]] = 1
    assert got == pytest.approx(density.convolved(dense, density.kernel(2.0))[2:6, 2:6].mean())


def test_means_by_patch_as_by_tables(spark):
    grid = Grid(0, 0, 40, 20, 20, 0)
    points = spark.createDataFrame([(float(x * 7 % 40), float(x * 3 % 20)) for x in range(60)], "x double, y double")
    cells = box_frame(spark, "cell_id", [(1, (2, 2, 6, 6)), (2, (22, 2, 26, 9)), (3, (1, 10, 19, 19))])
    raster = density.presence_raster(tiling.assign_points_to_patches(points, grid), grid)
    labels = tiling.rasterize_polygons(cells, grid, "cell_id")
    smooth = density.gaussian_smooth(raster.withColumn("value", F.lit(1.0)), ["patch_id"], 20, 20, 1.0)
    plain = rows(density.mean_density_per_polygon(labels, smooth), "patch_id", "label", "mean_density")
    for a, b in zip(plain, rows(density.smoothed_means(raster, labels, 20, 1.0), "patch_id", "label", "mean_density"), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2])


def test_background_of_some_pixels(spark):
    pixels = spark.createDataFrame([(0, 0, 0), (0, 0, 1), (0, 0, 2)], "patch_id int, y int, x int")
    thick = spark.createDataFrame([(0, 0, 1, 0.5), (0, 0, 2, 0.1)], "patch_id int, y int, x int, value double")
    assert rows(density.background_at(pixels, thick, 0.2), "x") == [(0,), (2,)]


def test_a_gene_without_a_vector(spark):
    points = spark.createDataFrame([(0, 5, 5, "A", 1), (0, 9, 9, "pad", 2)], "patch_id int, y int, x int, gene string, k int")
    vectors = spark.createDataFrame([("A", [1.0, 2.0])], "gene string, value array<double>")
    stamped = genes.stamp_embeddings(points, ["patch_id"], vectors, 10, 1, ["k"], dimensions=2)
    assert stamped.where("x >= 8").agg(F.max("value")).first()[0] == 0 and stamped.where("channel = 1 AND value = 2").count() == 9
    soft = genes.stamp_embeddings(points, ["patch_id"], vectors, 10, 1, ["k"], dimensions=2, sigma=0.5)
    assert soft.where("channel = 1").agg(F.sum("value")).first()[0] == pytest.approx(18)
    with pytest.raises(Exception, match="no vector for gene pad"):
        genes.rna_image(points, ["patch_id"], vectors).collect()


def test_a_crop_holds_a_pixel_of_the_mask(spark):
    wide = spark.range(40 * 400).selectExpr("cast(id div 400 as int) AS patch_id", "cast(id % 400 div 20 as int) AS y", "cast(id % 20 as int) AS x", "cast(id % 400 = 57 as double) AS m", "1.0D AS v")
    out = batching.augment_geometry(wide, "patch_id", ["m", "v"], 20, 3, p=0.0, p_scale=0.0, mask="m", crop=6)
    got = {r["patch_id"]: r for r in out.groupBy("patch_id").agg(F.sum("m").alias("m"), F.sum("v").alias("v"), F.min("y").alias("y"), F.max("x").alias("x")).collect()}
    assert len(got) == 40 and all((r["m"], r["v"], r["y"], r["x"]) == (1, 36, 0, 5) for r in got.values())


def test_blur_is_the_mean_of_the_window(spark):
    one = spark.createDataFrame([(0, 0, 4, 4, 9.0, 1), (1, 0, 0, 4, 9.0, 1)], "k int, channel int, y int, x int, value double, _r int")
    out = batching.blurred(batching.blurred(one, ["k", "_r"], "y", 10), ["k", "_r"], "x", 10)
    got = {(r["k"], r["y"], r["x"]): r["value"] for r in out.collect()}
    assert {v for (k, _, _), v in got.items() if k == 0} == {1.0} and len([1 for k in got if k[0] == 0]) == 9
    assert got[1, 0, 4] == pytest.approx(2.0) and got[1, 1, 4] == pytest.approx(1.0)


def test_outline_of_an_l_shape():
    y, x = np.array([(0, 0), (0, 1), (1, 0), (2, 0)]).T
    label, begins, corners = pixel_rings(np.full(4, 3), y, x)
    assert label.tolist() == [3] and begins.tolist() == [0, 6]
    assert sorted(map(tuple, corners.tolist())) == [(0, 0), (0, 3), (1, 1), (1, 3), (2, 0), (2, 1)]


def test_rings_of_labels(spark):
    labels = spark.createDataFrame([(0, y, x, 7) for y in range(2) for x in range(3)], "patch_id int, y int, x int, label int")
    ring = segmentation.label_rings(labels).first()["ring"]
    assert sorted((p["x"], p["y"]) for p in ring) == [(0, 0), (0, 2), (3, 0), (3, 2)]


def test_rings_of_a_label_with_a_hole_and_an_island(spark):
    pixels = [(0, y, x, 7) for y in range(5) for x in range(5) if not (1 <= y <= 3 and 1 <= x <= 3)] + [(0, 2, 2, 7)]
    cell = segmentation.labels_to_cells(spark.createDataFrame(pixels, "patch_id int, y int, x int, label int")).first()
    areas = sorted(area_of(np.array([(p["x"], p["y"]) for p in ring])) for ring in cell["rings"])
    assert areas == [-9, 1, 25] and cell["area"] == 17 and len(cell["ring"]) == 4


def test_split_is_exact_and_repeatable(spark):
    ids = spark.range(50).selectExpr("cast(id as int) AS patch_id")
    first = rows(batching.train_val_split(ids, 0.1, 42), "patch_id", "part")
    assert sum(p == "val" for _, p in first) == 5 and first == rows(batching.train_val_split(ids.repartition(7), 0.1, 42), "patch_id", "part")


def test_flow_vectors_turn_with_the_image(spark):
    wide = spark.range(400).selectExpr("cast(1 as int) AS patch_id", "cast(id div 20 as int) AS y", "cast(id % 20 as int) AS x", "1.0D AS fy", "0.0D AS fx")
    turned = batching.augment_geometry(wide, "patch_id", ["fy", "fx"], 20, 1, p=1.0, flows=("fy", "fx")).collect()
    assert turned and all(r["fy"] ** 2 + r["fx"] ** 2 == pytest.approx(1) for r in turned)


def test_unknown_gene_is_an_error(spark):
    points = spark.createDataFrame([(0.0, 0.0, "A"), (0.0, 0.0, "B")], "x double, y double, gene string")
    index = genes.build_gene_index(points.where("gene = 'A'"))
    with pytest.raises(Exception, match="unknown gene B"):
        genes.encode_genes(points, index).collect()


def test_a_model_is_loaded_once_in_a_worker(spark, tmp_path):
    folder = str(tmp_path)

    def loader():
        import tempfile

        tempfile.mkstemp(dir=folder)
        return lambda samples: samples[["patch_id"]].assign(n=len(samples))

    samples = spark.range(60).selectExpr("cast(id as int) AS patch_id", "array_repeat(0.0D, 10) AS plane").repartition(20)
    got = segmentation.segment_patches(samples, loader, "patch_id int, n long", most=25).collect()
    assert sorted(r["patch_id"] for r in got) == list(range(60)) and max(r["n"] for r in got) == 2
    assert len(list(tmp_path.iterdir())) < 20


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_window_maximum_in_two_steps(spark, size):
    r = np.random.default_rng(size)
    dense = np.where(r.random((9, 7)) < 0.6, r.integers(-5, 9, (9, 7)), 0).astype(float)
    lit = [(int(y), int(x), float(dense[y, x])) for y, x in zip(*np.nonzero(dense))]
    low, high = size // 2, (size - 1) // 2
    padded = np.pad(dense, ((low, high), (low, high)), mode="symmetric")
    want = {(y, x): padded[y : y + size, x : x + size].max() for y in range(9) for x in range(7)}
    got = {(r["y"], r["x"]): r["value"] for r in genes.max_filter(spark.createDataFrame(lit, "y int, x int, value double"), [], 9, 7, size).collect()}
    assert all(want[k] == got.get(k, 0.0) for k in want)


def test_planes_of_sparse_pixels(spark):
    pixels = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 1, 2, 2.0), ("a", 5, 0, 9.0), ("b", 1, 1, 3.0), ("c", 7, 7, 4.0), ("d", 0, 1, None)], "k string, y int, x int, value double")
    packed = batching.pack_patches(pixels, ["k"], 2, 3)
    assert rows(packed, "k", "plane") == [("a", [1, 0, 0, 0, 0, 2]), ("b", [0, 0, 0, 0, 3, 0]), ("c", [0] * 6), ("d", [0] * 6)]
    plan = batching.pack_patches(pixels, ["k"], 2, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
