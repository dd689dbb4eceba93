"""Polygons as arrays of (x, y): measures as Spark expressions, areas of intersections as Arrow functions, pixels of rings and rings of pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RING = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


def box_ring(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Four corners, counter-clockwise."""
    return F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax))))


def _sum(ring: Column, term) -> Column:
    """Sum of term(corner, next corner) around the ring."""
    n = F.size(ring)
    following = F.concat(F.slice(ring, 2, n), F.slice(ring, 1, 1))
    return F.aggregate(F.zip_with(ring, following, term), F.lit(0.0), lambda a, v: a + v)


def signed_area(ring: Column) -> Column:
    return _sum(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]) / 2


def polygon_area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def polygon_centroid(ring: Column) -> Column:
    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    scale = 6 * signed_area(ring)
    return F.struct(
        (_sum(ring, lambda p, q: (p["x"] + q["x"]) * cross(p, q)) / scale).alias("x"),
        (_sum(ring, lambda p, q: (p["y"] + q["y"]) * cross(p, q)) / scale).alias("y"),
    )


def perimeter(ring: Column) -> Column:
    return _sum(ring, lambda p, q: F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"])))


def ensure_ccw(ring: Column) -> Column:
    return F.when(signed_area(ring) < 0, F.reverse(ring)).otherwise(ring)


def with_bbox(df: DataFrame, ring: str = "ring") -> DataFrame:
    """Adds xmin, ymin, xmax, ymax of the ring."""
    xs, ys = F.col(ring)["x"], F.col(ring)["y"]
    return df.withColumns({"xmin": F.array_min(xs), "ymin": F.array_min(ys), "xmax": F.array_max(xs), "ymax": F.array_max(ys)})


def is_box(ring: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Whether a ring is its own bounding box: its four corners are the box's."""
    corner = lambda p: ((p["x"] == xmin) | (p["x"] == xmax)) & ((p["y"] == ymin) | (p["y"] == ymax))
    return (F.size(ring) == 4) & (F.size(F.array_distinct(ring)) == 4) & F.forall(ring, corner)


def ring_edges(ring: Column) -> Column:
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, following, lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def _holds(ring: Column, point: Column) -> Column:
    """Whether a point that is on no edge is inside: it is left of an odd number of edges."""

    def left_of(e: Column) -> Column:
        p, q = e["p"], e["q"]
        x = p["x"] + (point["y"] - p["y"]) / (q["y"] - p["y"]) * (q["x"] - p["x"])
        return ((p["y"] > point["y"]) != (q["y"] > point["y"])) & F.when(p["y"] != q["y"], point["x"] < x).otherwise(False)

    return F.size(F.filter(ring_edges(ring), left_of)) % 2 == 1


def rings_meet(a: Column, b: Column) -> Column:
    """Whether two closed polygons have a point in common: two of their edges do, or one polygon is inside the other."""
    side = lambda p, q, r: (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])

    def meet(e: Column, f: Column) -> Column:
        near = F.lit(True)
        for c in ("x", "y"):
            near = near & (F.least(e["p"][c], e["q"][c]) <= F.greatest(f["p"][c], f["q"][c])) & (F.least(f["p"][c], f["q"][c]) <= F.greatest(e["p"][c], e["q"][c]))
        apart = lambda g, h: F.signum(side(g["p"], g["q"], h["p"])) * F.signum(side(g["p"], g["q"], h["q"])) <= 0
        return near & apart(e, f) & apart(f, e)

    return F.exists(ring_edges(a), lambda e: F.exists(ring_edges(b), lambda f: meet(e, f))) | _holds(b, a[0]) | _holds(a, b[0])


def box_overlap(a: str, b: str) -> Column:
    """Area of the intersection of two boxes with columns {a}xmin, …, {b}ymax; closed form."""
    side = lambda k: F.greatest(F.lit(0.0), F.least(F.col(f"{a}{k}max"), F.col(f"{b}{k}max")) - F.greatest(F.col(f"{a}{k}min"), F.col(f"{b}{k}min")))
    return side("x") * side("y")


def area_of(polygon: np.ndarray) -> float:
    """Signed area."""
    if len(polygon) < 3:
        return 0.0
    x, y = polygon[:, 0] - polygon[0, 0], polygon[:, 1] - polygon[0, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def _clip_many(polygons: np.ndarray, normals: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The parts of many polygons with n . p <= c, each by its own line, at once. Every corner gives two places, itself and the cut after it; places
    that are not used repeat the corner before, which changes no area."""
    side = (polygons * normals[:, None]).sum(axis=2) - c[:, None]
    after, beyond = np.roll(polygons, -1, axis=1), np.roll(side, -1, axis=1)
    cut = (side < 0) & (beyond > 0) | (side > 0) & (beyond < 0)
    t = np.where(cut, side / np.where(cut, side - beyond, 1), 0)
    places = np.stack([polygons, polygons + t[..., None] * (after - polygons)], axis=2).reshape(len(polygons), -1, 2)
    used = np.stack([side <= 0, cut], axis=2).reshape(len(polygons), -1)
    last = np.maximum.accumulate(np.where(used, np.arange(used.shape[1]), -1), axis=1)
    last = np.where(last < 0, np.maximum(last[:, -1:], 0), last)
    return np.take_along_axis(places, last[..., None], axis=1)


def overlap_areas(a: list[np.ndarray], b: list[np.ndarray], most: int = 1 << 20) -> np.ndarray:
    """Areas of the intersections of pairs of simple polygons: each second one as signed triangles from its first corner, to each of
    which the first is clipped. All pairs' triangles are clipped together, ``most`` places at a time."""
    out = np.zeros(len(a))
    count = np.array([max(len(x) - 2, 0) for x in b], np.int64)
    pair = np.repeat(np.arange(len(a)), count)
    if not len(pair) or not max(map(len, a)):
        return out
    triangles = np.concatenate([np.stack([np.broadcast_to(x[:1], (len(x) - 2, 2)), x[1:-1], x[2:]], axis=1) for x in b if len(x) > 2])
    corners = max(map(len, a))
    padded = np.stack([np.concatenate([x, np.repeat(x[-1:], corners - len(x), axis=0)]) if len(x) else np.zeros((corners, 2)) for x in a])
    edge = triangles - triangles[:, :1]
    sign = np.sign(edge[:, 1, 0] * edge[:, 2, 1] - edge[:, 1, 1] * edge[:, 2, 0])
    step = max(most // (8 * corners), 1)
    for i in range(0, len(pair), step):
        own, tri, s = pair[i : i + step], triangles[i : i + step], sign[i : i + step]
        part = padded[own]
        for k in range(3):
            p, q = tri[:, k], tri[:, (k + 1) % 3]
            normal = s[:, None] * np.stack([q[:, 1] - p[:, 1], p[:, 0] - q[:, 0]], axis=1)
            part = _clip_many(part, normal, (normal * p).sum(axis=1))
        x, y = (part[..., k] - part[:, :1, k] for k in (0, 1))
        area = np.abs((x * np.roll(y, -1, axis=1) - np.roll(x, -1, axis=1) * y).sum(axis=1)) / 2
        out += np.bincount(own, s * area, len(a))
    return np.abs(out)


def ring_array(ring) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in ring], float).reshape(-1, 2)


@F.pandas_udf(T.DoubleType())
def intersection_area(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(overlap_areas([ring_array(p) for p in a], [ring_array(q) for q in b]), dtype=float)


@F.arrow_udf(T.DoubleType())
def rings_overlap(a: pa.Array, b: pa.Array) -> pa.Array:
    """Areas that shapes share, each an array of rings of which holes run the other way: what their rings share, pair by pair, by sign. A
    shape of a single ring may run either way."""

    def signed(rings) -> list[tuple[np.ndarray, float]]:
        arrays = [ring_array(r) for r in rings]
        return [(r, 1.0 if len(arrays) == 1 or area_of(r) > 0 else -1.0) for r in arrays]

    pairs = [(k, p, q, s * t) for k, (x, y) in enumerate(zip(a.to_pylist(), b.to_pylist())) for p, s in signed(x) for q, t in signed(y)]
    areas = overlap_areas([p[1] for p in pairs], [p[2] for p in pairs]) * np.array([p[3] for p in pairs])
    return pa.array(np.bincount([p[0] for p in pairs], areas, len(a)) if pairs else np.zeros(len(a)), pa.float64())


def ring_strips(ring: Column, first: Column, last: Column) -> Column:
    """The strips low, high of heights in [first, last] between neighbouring corners and whole numbers. Within a strip no edge of the
    ring begins or ends."""
    low, high = F.greatest(F.floor(F.array_min(ring["y"])), first), F.least(F.ceil(F.array_max(ring["y"])), last)
    rows = F.when(low < high, F.transform(F.sequence(low, high), lambda v: v.cast("double"))).otherwise(F.array().cast("array<double>"))
    levels = F.array_sort(F.array_distinct(F.concat(rows, F.filter(ring["y"], lambda v: (v > low) & (v < high)))))
    pairs = F.zip_with(levels, F.slice(levels, 2, F.greatest(F.size(levels), F.lit(1))), lambda a, b: F.struct(a.alias("low"), b.alias("high")))
    return F.filter(pairs, lambda s: s["low"] < s["high"])


def strip_crossings(edges: Column, low: Column, high: Column) -> Column:
    """The edges (see ring_edges) that cross a strip, from left to right: x in its middle, the least and the greatest x there."""
    middle = (low + high) / 2

    def crossing(e: Column) -> Column:
        p, q = e["p"], e["q"]
        x = lambda y: p["x"] + (y - p["y"]) / (q["y"] - p["y"]) * (q["x"] - p["x"])
        return F.struct(x(middle).alias("x"), F.least(x(low), x(high)).alias("left"), F.greatest(x(low), x(high)).alias("right"))

    here = F.filter(edges, lambda e: (F.least(e["p"]["y"], e["q"]["y"]) < middle) & (F.greatest(e["p"]["y"], e["q"]["y"]) > middle))
    return F.array_sort(F.transform(here, crossing))


def strip_spans(crossings: Column) -> Column:
    """first, last: columns of the pixels whose open square the polygon meets in a strip; it lies between its crossings, two by two.
    Less than 1e-9 of a pixel's width is rounding."""

    def span(c: Column, i: Column) -> Column:
        end = F.get(crossings, i + 1)["right"]
        return F.when(i % 2 == 0, F.struct(F.floor(c["left"] + 1e-9).alias("first"), (F.ceil(end - 1e-9) - 1).alias("last")))

    return F.array_compact(F.transform(crossings, span))


def pixel_rings(label: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rings of pixel edges around the pixels of each label: label of each ring, places where rings begin among the corners (and
    their number), corners (x, y). Labels are in order; outer rings have a positive signed area, holes a negative one.

    An edge is a pixel and a way: right along its top, down, left, up, where the pixel beyond has not its label. Next comes an edge of
    the pixel diagonally ahead if that one and the one before it have the label, of the pixel ahead if that alone has, else of
    the pixel itself, so pixels that touch in a corner only are in rings of their own. Doubled pointers find every ring's first
    edge, then each edge's distance to it.
    """
    names, rank = np.unique(np.asarray(label), return_inverse=True)
    y0, x0 = (int(np.min(v)) - 1 for v in (y, x))
    height, width = int(np.max(y)) - y0 + 2, int(np.max(x)) - x0 + 2
    code = np.unique((rank.astype(np.int64) * height + (np.asarray(y, np.int64) - y0)) * width + (np.asarray(x, np.int64) - x0))

    def held(wanted: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(code, wanted), len(code) - 1)
        return np.where(code[place] == wanted, place, -1)

    ahead = np.stack([held(code + step) for step in (1, width, -1, -width)], axis=1)
    is_edge = np.roll(ahead, 1, axis=1) < 0
    number = (np.cumsum(is_edge) - 1).reshape(is_edge.shape)
    pixel, way = np.nonzero(is_edge)
    front = ahead[pixel, way]
    beside = np.where(front >= 0, ahead[front, way - 1], -1)
    following = number[np.where(front < 0, pixel, np.where(beside < 0, front, beside)), (way + np.where(front < 0, 1, np.where(beside < 0, 0, -1))) % 4]
    first, jump = np.arange(len(way)), following
    while True:
        least = np.minimum(first, first[jump])
        if (least == first).all():
            break
        first, jump = least, jump[jump]
    root = first == np.arange(len(way))
    distance, jump = (~root).astype(np.int64), np.where(root, first, following)
    while not root[jump].all():
        distance, jump = distance + distance[jump], jump[jump]
    before = np.empty_like(following)
    before[following] = np.arange(len(way))
    order = np.lexsort((np.where(root, -len(way), -distance), first))
    order = order[way[before[order]] != way[order]]
    own, side = code[pixel[order]], way[order]
    corners = np.stack([own % width + x0 + np.isin(side, (1, 2)), own // width % height + y0 + np.isin(side, (2, 3))], axis=1).astype(float)
    begins = np.flatnonzero(np.r_[True, first[order][1:] != first[order][:-1]])
    return names[own[begins] // (width * height)], np.r_[begins, len(order)], corners


def box_corners(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """xmin, ymin, xmax, ymax of rings of four corners (rows of x and y), and whether a ring is an axis-parallel box."""
    bounds = np.stack([x.min(axis=1), y.min(axis=1), x.max(axis=1), y.max(axis=1)], axis=1)
    corner = (x == bounds[:, 2:3]) * 1 + (y == bounds[:, 3:]) * 2
    on = ((x == bounds[:, :1]) | (x == bounds[:, 2:3])) & ((y == bounds[:, 1:2]) | (y == bounds[:, 3:]))
    round_it = np.isin(corner ^ np.roll(corner, -1, axis=1), (1, 2)).all(axis=1) & (np.sort(corner, axis=1) == np.arange(4)).all(axis=1)
    return bounds, on.all(axis=1) & round_it & (bounds[:, 0] < bounds[:, 2]) & (bounds[:, 1] < bounds[:, 3])


def outlines_of_boxes(bounds: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rings around the unions of many groups of boxes at once (bounds xmin, ymin, xmax, ymax; groups are sorted whole numbers): group of
    each ring, places where rings begin among the corners (and their number), corners (x, y). See outline_of_union.

    The sides of a group's boxes cut the plane into a grid of its own, whose covered cells are traced like pixels. A group of n boxes has
    (2 n)^2 cells at most. Sides within 1e-9 of a group's size are one.
    """
    names, first = np.unique(group, return_index=True)
    rank = np.searchsorted(names, group)
    size = np.maximum((np.maximum.reduceat(bounds[:, 2:], first) - np.minimum.reduceat(bounds[:, :2], first)).max(axis=1), 1e-9)
    begin, end, sides, offsets = [], [], [], []
    for axis in (0, 1):
        value, owner = np.concatenate([bounds[:, axis], bounds[:, axis + 2]]), np.concatenate([rank, rank])
        order = np.lexsort((value, owner))
        value, owner = value[order], owner[order]
        fresh = np.r_[True, (owner[1:] != owner[:-1]) | (np.diff(value) > 1e-9 * size[owner[1:]])]
        offset = np.searchsorted(owner[fresh], np.arange(len(names)))
        place = np.empty(len(value), np.int64)
        place[order] = np.cumsum(fresh) - 1 - offset[owner]
        begin.append(place[: len(bounds)])
        end.append(place[len(bounds) :])
        sides.append(value[fresh])
        offsets.append(offset)
    wide, high = end[0] - begin[0], end[1] - begin[1]
    box = np.repeat(np.arange(len(bounds)), wide * high)
    cell = np.arange(len(box)) - np.repeat(np.cumsum(wide * high) - wide * high, wide * high)
    own, begins, corners = pixel_rings(rank[box], begin[1][box] + cell // wide[box], begin[0][box] + cell % wide[box])
    of = np.repeat(own, np.diff(begins))
    at = corners.astype(np.int64)
    return names[own], begins, np.stack([sides[k][offsets[k][of] + at[:, k]] for k in (0, 1)], axis=1)


def outline_of_union(rings: list[np.ndarray]) -> list[np.ndarray]:
    """The rings around the union of simple polygons: outer ones counter-clockwise, holes clockwise.

    All edges are cut where they meet another polygon's. A piece stays if its middle lies outside all other polygons; of pieces
    that coincide, one stays if they run alike, none if they run against each other. Pieces that stay are joined end to end.
    """
    rings = [r if area_of(r) > 0 else r[::-1] for r in rings]
    size = max(float(np.ptp(np.concatenate(rings), axis=0).max()), 1e-9)
    near = 1e-9 * size
    key = lambda v: tuple(np.floor(v / near / 8 + 0.2718281828).astype(int).tolist())
    edges = [(k, r[i], r[(i + 1) % len(r)]) for k, r in enumerate(rings) for i in range(len(r))]
    starts, ends = np.array([e[1] for e in edges]), np.array([e[2] for e in edges])
    owner = np.array([e[0] for e in edges])
    cross = lambda u, v: u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]
    pieces: dict[tuple, list] = {}
    for k, p, q in edges:
        way = q - p
        length = float(np.hypot(*way))
        if length <= near:
            continue
        other = owner != k
        u, v = starts[other], ends[other]
        along = v - u
        turn = cross(way, along)
        with np.errstate(divide="ignore", invalid="ignore"):
            t, w = cross(u - p, along) / turn, cross(u - p, way) / turn
        slack = near / length
        meets = (np.abs(turn) > 1e-12 * length * size) & (w >= -1e-9) & (w <= 1 + 1e-9) & (t > slack) & (t < 1 - slack)
        cuts = t[meets].tolist()
        for corner in (u, v):  # corners of others on this edge
            on = (corner - p) @ way / length**2
            off = np.abs(cross(corner - p, way)) / length
            cuts += on[(off <= near) & (on > slack) & (on < 1 - slack)].tolist()
        places = [0.0, *sorted(cuts), 1.0]
        for a, b in zip(places, places[1:]):
            if (b - a) * length <= near:
                continue
            start, end = p + a * way, p + b * way
            middle = (start + end) / 2
            if any(j != k and _inside(middle, r, near) for j, r in enumerate(rings)):
                continue
            ka, kb = key(start), key(end)
            if (kb, ka) in pieces:
                del pieces[kb, ka]
            else:
                pieces[ka, kb] = (start, end)
    following: dict[tuple, list] = {}
    for (ka, kb), (start, end) in pieces.items():
        following.setdefault(ka, []).append((kb, start, end))
    out = []
    while following:
        at = next(iter(following))
        ring, way = [], None
        while at in following:
            options = following[at]
            if way is not None and len(options) > 1:  # where rings touch in a corner, the sharpest right turn keeps them apart
                options.sort(key=lambda o: np.arctan2(way[0] * (o[2] - o[1])[1] - way[1] * (o[2] - o[1])[0], way @ (o[2] - o[1])))
            to, start, end = options.pop(0)
            if not options:
                del following[at]
            ring.append(start)
            way, at = end - start, to
        ring = _without_straight_corners(np.array(ring), near)
        if len(ring) > 2:
            out.append(ring)
    return out


def _inside(point: np.ndarray, ring: np.ndarray, near: float) -> bool:
    """Strictly inside; not within ``near`` of an edge."""
    p, q = ring, np.roll(ring, -1, axis=0)
    way = q - p
    t = np.clip(((point - p) * way).sum(axis=1) / np.maximum((way**2).sum(axis=1), 1e-300), 0, 1)
    if np.hypot(*(p + t[:, None] * way - point).T).min() <= near:
        return False
    crosses = (p[:, 1] > point[1]) != (q[:, 1] > point[1])
    x = p[crosses, 0] + (point[1] - p[crosses, 1]) / way[crosses, 1] * way[crosses, 0]
    return bool((x > point[0]).sum() % 2)


def _without_straight_corners(ring: np.ndarray, near: float) -> np.ndarray:
    before, after = ring - np.roll(ring, 1, axis=0), np.roll(ring, -1, axis=0) - ring
    bend = np.abs(before[:, 0] * after[:, 1] - before[:, 1] * after[:, 0])
    return ring[bend > near * (np.hypot(*before.T) + np.hypot(*after.T))]
