"""Augmented samples: planes in one place against pixels as rows."""

import numpy as np

from tesserae.operators import batching


def test_planes_are_as_rows_and_drawn_once_a_sample(spark, monkeypatch):
    rng = np.random.default_rng(5)
    sparse = sorted({(k, int(c), int(y), int(x)) for k in range(40) for c, y, x in rng.integers(0, (3, 9, 9), (30, 3))})
    rows = [(f"s{k}" if k else None, c if k != 3 else None, y, x, None if (y + x + k) % 11 == 0 else float(rng.integers(-9, 9))) for k, c, y, x in sparse]
    pixels = spark.createDataFrame(rows, "k string, channel int, y int, x int, value double")
    for p in (1.0, 0.5):
        made = batching.augment_pixels(pixels, "k", 3, 9, 8, p=p, hole=4)
        assert "md5" not in made._jdf.queryExecution().toString().lower()  # a draw as a column costs more than its pixel
        with monkeypatch.context() as m:
            m.setattr(batching, "PLANE", 0)
            plain = batching.augment_pixels(pixels, "k", 3, 9, 8, p=p, hole=4)
        assert made.schema.simpleString() == plain.schema.simpleString()
        got, want = ({(r.k, r.channel, r.y, r.x): None if r.value is None else round(r.value, 9) + 0.0 for r in df.collect()} for df in (made, plain))
        assert got == want and None in want.values()
    assert batching.augment_pixels(pixels.limit(0), "k", 3, 9, 8).count() == 0
