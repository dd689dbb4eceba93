"""Unions that grow, and joins of shapes of mixed sizes, against brute force on pixels and on all pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserae.functions.geometry import area_of, outlines_of_boxes, ring_array, with_bbox
from tesserae.operators import segmentation, tiling
from tesserae.plans import queries


def boxes(spark, own):
    ring = lambda b: [(float(x), float(y)) for x, y in ((b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3]))]
    return with_bbox(spark.createDataFrame([(k, ring(b)) for k, b in own.items()], "cell_id long, ring array<struct<x: double, y: double>>"))


def pixels(b):
    return {(x, y) for x in range(b[0], b[2]) for y in range(b[1], b[3])}


def agglomerated(own, threshold=0.25):
    """One scan over all pairs of current sets of pixels after the other; what reaches the threshold in a scan becomes one."""
    shapes = {k: ({k}, pixels(b)) for k, b in own.items()}
    while True:
        root = {k: k for k in shapes}

        def top(k):
            return k if root[k] == k else top(root[k])

        for a in shapes:
            for b in shapes:
                common = len(shapes[a][1] & shapes[b][1])
                if a < b and common and common >= threshold * min(len(shapes[a][1]), len(shapes[b][1])):
                    root[max(top(a), top(b))] = min(top(a), top(b))
        if all(top(k) == k for k in shapes):
            return {c: (k, len(p)) for k, (cells, p) in shapes.items() for c in cells}
        grown = {}
        for k, (cells, p) in shapes.items():
            have = grown.setdefault(top(k), (set(), set()))
            have[0].update(cells)
            have[1].update(p)
        shapes = grown


def test_a_union_takes_part_in_later_pairs(spark):
    own = {1: (0, 0, 40, 40), 2: (28, 0, 68, 40), 3: (18, 31, 50, 63)}
    pair = lambda a, b: len(pixels(own[a]) & pixels(own[b])) / min(len(pixels(own[a])), len(pixels(own[b])))
    assert pair(1, 2) >= 0.25 > max(pair(1, 3), pair(2, 3))
    groups = segmentation.resolve_conflicts(boxes(spark, own))
    assert {r.cell_id: r.group for r in groups.collect()} == {1: 1, 2: 1, 3: 1}
    merged = segmentation.union_groups(groups).first()
    assert merged.n_cells == 3 and merged.area == len(pixels(own[1]) | pixels(own[2]) | pixels(own[3]))


@pytest.mark.parametrize("seed,as_boxes", [(0, True), (1, False), (2, True)])
def test_like_brute_force_on_pixels(spark, seed, as_boxes):
    rng = np.random.default_rng(seed)
    own = {int(k): (int(x), int(y), int(x + w), int(y + h)) for k, x, y, w, h in zip(range(1, 91), rng.integers(0, 150, 90), rng.integers(0, 150, 90), rng.integers(4, 40, 90), rng.integers(4, 40, 90))}
    groups = segmentation.resolve_conflicts(boxes(spark, own), boxes=as_boxes)
    areas = {r.group: r.area for r in segmentation.union_groups(groups).collect()}
    got = {r.cell_id: (r.group, round(areas[r.group], 6)) for r in groups.collect()}
    want = agglomerated(own)
    assert got == want
    once = {frozenset((a, b)) for a in own for b in own if a < b and len(pixels(own[a]) & pixels(own[b])) >= 0.25 * min(len(pixels(own[a])), len(pixels(own[b])))}
    plain = {k: k for k in own}
    for _ in own:
        for a, b in map(sorted, once):
            plain[a] = plain[b] = min(plain[a], plain[b])
    assert len(set(plain.values())) >= len({g for g, _ in want.values()})


def test_holes_stay_as_rings(spark):
    own = {1: (0, 0, 20, 6), 2: (0, 0, 6, 20), 3: (14, 0, 20, 20), 4: (0, 14, 20, 20)}
    merged = segmentation.union_groups(segmentation.resolve_conflicts(boxes(spark, own))).first()
    assert sorted(area_of(ring_array(r)) for r in merged.rings) == [-64, 400] and merged.area == 336
    assert merged.ring == merged.rings[0]


def test_a_large_shape_is_in_few_cells(spark):
    wide = boxes(spark, {1: (3, 5, 3203, 3205), 2: (0, 0, 10, 10), 3: (-5000, -5000, 5000, 5000)})
    assert max(r["count"] for r in tiling._buckets(wide, 32.0, [0, 7, 9], "l_").groupBy("l_cell_id", "_level").count().collect()) <= 4


def test_join_of_mixed_sizes_is_all_pairs(spark):
    rng = np.random.default_rng(4)

    def made(n, first):
        side = 2.0 ** rng.integers(0, 11, n)
        x, y = rng.integers(-600, 600, n), rng.integers(-600, 600, n)
        return {first + k: (int(x[k]), int(y[k]), int(x[k] + side[k]), int(y[k] + side[k] // rng.integers(1, 4) + 1)) for k in range(n)}

    a, b = made(80, 0), made(90, 1000)
    pairs = tiling.spatial_join(boxes(spark, a), boxes(spark, b)).select("l_cell_id", "r_cell_id").collect()
    want = sorted((i, j) for i, p in a.items() for j, q in b.items() if p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3])
    assert sorted(map(tuple, pairs)) == want
    empty = boxes(spark, a).where(F.lit(False))
    assert tiling.spatial_join(empty, boxes(spark, b)).count() == 0


def test_many_groups_of_boxes_are_outlined_together():
    """Against pixels, and in the time of one: edge by edge these groups took minutes."""
    rng = np.random.default_rng(3)
    groups = {7 * g: [(x, y, x + w, y + h) for x, y, w, h in rng.integers(1, 12, (rng.integers(1, 8), 4)).tolist()] for g in range(300)}
    owner = np.array([g for g, own in groups.items() for _ in own])
    names, begins, corners = outlines_of_boxes(np.array([b for own in groups.values() for b in own], float), owner)
    areas = dict.fromkeys(groups, 0.0)
    for k, g in enumerate(names.tolist()):
        areas[g] += area_of(corners[begins[k] : begins[k + 1]])
    assert areas == {g: len(set().union(*map(pixels, own))) for g, own in groups.items()}


def test_groups_that_touch_in_a_corner_keep_their_area():
    """Two boxes that meet in a corner beside a third: edge by edge their area came out wrong."""
    ring = lambda b: [{"x": float(x), "y": float(y)} for x, y in ((b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3]))]
    rng = np.random.default_rng(0)
    own = [[(x, y, x + w, y + h) for x, y, w, h in np.c_[rng.integers(0, 8, (n, 2)), rng.integers(1, 5, (n, 2))].tolist()] for n in rng.integers(2, 9, 400)]
    slanted = [{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 0.0, "y": 4.0}]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(402)), pa.array([*([ring(b) for b in boxes] for boxes in own), [slanted], [slanted, ring((0, 0, 4, 4))]], pa.list_(pa.list_(segmentation.POINT)))], names=["group", "cells"]
    )
    (merged,) = segmentation._merged(iter([batch]))
    assert merged["area"].to_pylist() == [len(set().union(*map(pixels, boxes))) for boxes in own] + [8, 16]
    assert merged["n_cells"].to_pylist() == [len(boxes) for boxes in own] + [1, 2]
    for rings, area in zip(merged["rings"].to_pylist(), merged["area"].to_pylist()):
        areas = [area_of(ring_array(r)) for r in rings]
        assert areas == sorted(areas, reverse=True) and sum(areas) == area


def test_copies_of_a_small_file_are_dealt_over_all_tasks(spark):
    assert queries.copies(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_union_that_is_a_box_is_known_as_one(spark, monkeypatch):
    """Pairs of boxes are compared in closed form; before, unions were compared ring by ring."""
    seen = []
    compare = segmentation.conflicts
    monkeypatch.setattr(segmentation, "conflicts", lambda shapes, threshold: seen.append(shapes) or compare(shapes, threshold))
    groups = segmentation.resolve_conflicts(boxes(spark, {1: (0, 0, 10, 6), 2: (3, 0, 13, 6), 3: (40, 0, 50, 6), 4: (42, 2, 52, 8)}))
    assert {r.cell_id: r.group for r in groups.collect()} == {1: 1, 2: 1, 3: 3, 4: 3}
    assert {r.group: (r.box, r.area) for r in seen[-1].collect()} == {1: (True, 78.0), 3: (False, 88.0)}
