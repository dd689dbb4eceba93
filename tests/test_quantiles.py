import numpy as np
import pytest

from tesserae.operators.quantiles import percentiles


@pytest.mark.parametrize("kind", ["floats", "ties", "hot"])
def test_like_numpy(spark, kind):
    rng = np.random.default_rng(7)
    value = {"floats": rng.standard_normal(500), "ties": rng.integers(0, 6, 500) / 2, "hot": np.where(rng.random(500) < 0.7, 1.5, rng.random(500))}[kind]
    rows = [(f"g{i % 3}" if i % 7 else None, i % 2, None if i % 11 == 0 else float(v)) for i, v in enumerate(value)] + [("alone", 1, 4.0), ("none", 1, None)]
    df = spark.createDataFrame(rows, "a string, b int, v double").repartition(3)
    fractions = [0.0, 0.01, 0.33, 0.5, 0.99, 1.0]
    got = {(r.a, r.b): r.percentiles for r in percentiles(df, "v", ["a", "b"], fractions).collect()}
    groups = {}
    for a, b, v in rows:
        groups.setdefault((a, b), []).extend([v] if v is not None else [])
    assert set(got) == {k for k, v in groups.items() if v}
    for k, v in got.items():
        assert v == pytest.approx(np.quantile(groups[k], fractions), abs=1e-12)


def test_one_group_and_none(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "v double")
    assert percentiles(df, "v", [], [0.05]).first().percentiles == [5.0]
    assert percentiles(df.where("v < 0"), "v", [], [0.5]).collect() == []


def test_no_task_gathers_a_group(spark):
    df = spark.range(1000).selectExpr("cast(id % 2 as int) AS g", "cast(id as double) AS v")
    plan = percentiles(df, "v", ["g"], [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "SinglePartition" not in plan
