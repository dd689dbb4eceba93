import numpy as np
import pytest

from tesserae.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, label int, node long, part string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], c, 1, "x") for i, v, c in rows], SCHEMA).repartition(3)


def usable(v, label):
    return label is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def brute(rows):
    """vec_id to number of links and smallest vec_id reachable; vec_ids differ."""
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if usable(v, c) else None for _, v, c in rows]
    link = [[j for j in range(len(rows)) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= N.LINK] for i in range(len(rows))]
    out = {}
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in link[todo.pop()] if j not in seen]
            seen.update(new)
            todo += new
        out[rows[i][0]] = (len(link[i]), min(rows[j][0] for j in seen))
    return out


def found(df):
    return {r.vec_id: (r.n_links, r.component_id) for r in df.collect() if r.kept == (r.vec_id == r.component_id)}


def cloud(rng, n, dim=16):
    return [rng.standard_normal(dim) for _ in range(n)]


def near(rng, base, n, spread):
    return [base + spread * np.linalg.norm(base) / np.sqrt(len(base)) * rng.standard_normal(len(base)) for _ in range(n)]


def planted(seed=0, copies=20, cluster=120, wide=60):
    rng = np.random.default_rng(seed)
    vectors = cloud(rng, 150)
    pairs = [x for v in vectors[:20] for x in near(rng, v, 1, 0.15)]
    hot = near(rng, rng.standard_normal(16), cluster, 0.2)
    outer = near(rng, rng.standard_normal(16), wide, 0.35)  # many of these do not link
    vectors = [*vectors, *pairs, *hot, *outer, *[vectors[7]] * copies, *[3 * vectors[8]] * 2]
    order = rng.permutation(len(vectors))
    return [(int(i), vectors[k], int(k % 2) if k < 40 else 1) for i, k in enumerate(order)]


def test_all_in_one_cell_is_exact(spark):
    rows = planted()
    rows += [(9001, [0.0] * 16, 1), (9002, None, 1), (9003, [1.0, None] * 8, 1), (9004, [float("inf")] + [1.0] * 15, 1), (9005, [float("nan")] * 16, 1), (9006, rows[0][1], None), (9007, rows[0][1][:15], 1), (9008, [], 1), (9009, [1e-30] * 16, 5), (9010, [1e30] * 16, 5)]
    got, want = found(N.near_vectors(frame(spark, rows))), brute(rows)
    assert got == want
    assert max(n for n, _ in want.values()) > 2 * N.WIDEST  # some lists stay saturated
    assert want[9009] == (1, 9009)


def test_small_cells_and_lists_find_nearly_all(spark):
    rows = planted(1, cluster=60, wide=30)
    got, want = found(N.near_vectors(frame(spark, rows), k=5, cell=24, tables=4, widest=10)), brute(rows)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i][0] for i in want) >= 0.97 * sum(n for n, _ in want.values())


def test_exact_counts_among_saturated_nodes(spark, monkeypatch):
    monkeypatch.setattr(N, "CHUNK", 16)
    rng = np.random.default_rng(3)
    units = [v / np.linalg.norm(v) for v in near(rng, rng.standard_normal(8), 90, 0.35)]
    rows = [(i, 5, 1 + i % 3, v.tobytes()) for i, v in enumerate(units)]
    got = {r.node: r.n for r in N._counted(spark.createDataFrame(rows, "node long, component long, copies long, unit binary")).collect()}
    want = {i: sum(rows[j][2] for j in range(90) if j != i and float(units[i] @ units[j]) >= N.LINK) for i in range(90)}
    assert got == want and 0 < min(want.values()) < max(want.values())


def test_rows_that_repeat_and_null_ids(spark):
    rows = [(None, [1.0, 2.0], 1), (None, [5.0, -1.0], 1), (4, [1.0, 2.0], 1), (4, [1.0, 2.0], 1), (7, [2.0, 4.0], 1)]
    got = sorted(((r.vec_id or -1, r.n_links, r.component_id or -1) for r in N.near_vectors(frame(spark, rows)).collect()))
    assert got == [(-1, 0, -1), (-1, 3, 4), (4, 3, 4), (4, 3, 4), (7, 3, 4)]


def test_recall_counts_what_is_missing(spark):
    unit = [np.array(v, float) / np.linalg.norm(v) for v in ([1, 0], [1, 0.1], [0, 1])]
    nodes = spark.createDataFrame([(i, "p", 1, u.tobytes()) for i, u in enumerate(unit)], "node long, part string, copies long, unit binary")
    counts = spark.createDataFrame([(0, 1)], "node long, n long")
    assert N.recall(nodes, counts) == pytest.approx(0.5)


def test_nothing(spark):
    assert N.near_vectors(frame(spark, [])).collect() == []
