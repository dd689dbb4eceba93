import math
import zlib
from collections import Counter
from itertools import product

from pyspark.sql import functions as F

from tesserae.llm.hilbert import hilbert_index, hilbert_shards, shard_ranges, string_bounds, transitions


def test_curve_visits_each_cell_once_by_single_steps(spark):
    side = 8
    cells = spark.createDataFrame(list(product(range(side), repeat=3)), "a int, b int, c int")
    rows = cells.withColumn("at", hilbert_index([F.col("a"), F.col("b"), F.col("c")], 3)).orderBy("at").collect()
    assert [r["at"] for r in rows] == list(range(side**3))
    for p, q in zip(rows, rows[1:]):
        assert sum(abs(p[k] - q[k]) for k in "abc") == 1


def test_transition_table_is_a_permutation():
    place, following = transitions(2)
    assert all(sorted(place[i : i + 4]) == [0, 1, 2, 3] for i in range(0, len(place), 4)) and max(following) < len(place) // 4


def test_shards(edge, nothing):
    rows = hilbert_shards(edge, 4).collect()
    assert Counter(r["shard"] for r in rows).values() and max(Counter(r["shard"] for r in rows).values()) - min(Counter(r["shard"] for r in rows).values()) <= 1
    for shard in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in edge.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in rows)
    assert hilbert_shards(nothing).count() == 0


def test_runs_follow_the_curve_and_prune(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', cast(id % 50 as int)) as text", "concat('s', id % 10) as source", "array('en','de','fr')[id % 3] as lang")
    placed = hilbert_shards(docs, 24).cache()
    ends = placed.groupBy("shard").agg(F.min("curve").alias("a"), F.max("curve").alias("b")).orderBy("shard").collect()
    assert all(x["b"] <= y["a"] for x, y in zip(ends, ends[1:]))
    ranges = shard_ranges(placed.join(docs, "doc_id"), ["source", "lang", "size"]).collect()
    full = 9, 2
    narrow = sum(r["max_lang"] == r["min_lang"] or int(r["max_source"][1:]) - int(r["min_source"][1:]) < full[0] or r["max_size"] - r["min_size"] < 98 for r in ranges)
    assert narrow > 12


def test_strings_that_begin_alike_are_told_apart(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "'' AS text", "concat('https://example.org/site', lpad(id % 50, 3, '0')) AS source", "'en' AS lang")
    bounds = string_bounds(docs, "source", 10)
    assert bounds == [f"https://example.org/site{k:03d}" for k in range(5, 50, 5)]
    placed = hilbert_shards(docs, 10, ("source",)).join(docs, "doc_id")
    ranges = shard_ranges(placed, ["source"]).orderBy("min_source").collect()
    assert all(a["max_source"] <= b["min_source"] for a, b in zip(ranges, ranges[1:]))


def brute(rows, shards, bits=6):
    """Cells by sorting all values, the curve bit by bit, shards by cutting the sorted rows."""
    parts, dims, n = 1 << bits, 3, len(rows)
    place, following = transitions(dims)
    keys = [(r["source"] or "", r["lang"] or "", len((r["text"] or "").encode()) + 8) for r in rows]

    def cells(values, strings):
        ordered = sorted(values)
        if strings:
            first = {}
            for v in sorted(set(values)):
                first.setdefault(sum(x < v for x in values) * parts // n, v)
            cuts = [v for c, v in first.items() if c]
            return [sum(c <= v for c in cuts) for v in values]
        cuts = sorted({ordered[max(math.ceil((i + 1) / parts * n), 1) - 1] for i in range(parts - 1)})
        return [sum(c < v for c in cuts) for v in values]

    columns = [cells([k[d] for k in keys], d < 2) for d in range(dims)]
    out = []
    for i, r in enumerate(rows):
        state = index = 0
        for b in range(bits - 1, -1, -1):
            octant = sum((columns[d][i] >> b & 1) << d for d in range(dims))
            index, state = index * 8 + place[state * 8 + octant], following[state * 8 + octant]
        out.append((index, zlib.crc32((r["text"] or "").encode()), r["doc_id"] is not None, r["doc_id"] or 0))
    out.sort()
    found = []
    for k, (index, _, known, doc) in enumerate(out):
        shard = k * shards // n
        found.append((doc if known else None, index, shard, k - -(-shard * n // shards)))
    return found


def test_same_as_brute_force(edge, spark):
    more = spark.range(500).selectExpr("100 + id AS doc_id", "repeat('word ', cast(id * id % 71 as int)) AS text", "array('en', 'de', null)[id % 3] AS lang", "concat('https://site', id % 37, '/', id % 5) AS source")
    docs = edge.select("doc_id", "text", "lang", "source").where("doc_id IS NULL OR doc_id <> 10").unionByName(more)
    got = sorted(((r["doc_id"], r["curve"], r["shard"], r["slot"]) for r in hilbert_shards(docs, 24).collect()), key=repr)
    assert got == sorted(brute(docs.collect(), 24), key=repr)
