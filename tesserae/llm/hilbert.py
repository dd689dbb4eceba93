"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised at their own quantiles (of strings, whole values in order), a row's cell is mapped to its place on
the Hilbert curve, rows are range-partitioned along the curve, and the curve is cut into runs of equal row
counts. Neighbours on the curve are neighbours in every dimension, so each shard's minimum and maximum
of each dimension are close together and readers can skip shards by any of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.shared import documents, durable, whole


def transitions(dims: int) -> tuple[list[int], list[int]]:
    """The curve's state machine: for state * 2**dims + cell octant, the place within the octants and the
    next state. A state is the entry corner and the axis of a sub-cube (Hamilton's formulation)."""
    n = 1 << dims

    def turn(x: int, by: int) -> int:
        by %= dims
        return ((x >> by) | (x << (dims - by))) & (n - 1)

    def ones(x: int) -> int:  # trailing ones
        return 0 if not x & 1 else 1 + ones(x >> 1)

    def undo_gray(g: int) -> int:
        return g if g == 0 else g ^ undo_gray(g >> 1)

    def entry(w: int) -> int:
        v = 2 * ((w - 1) // 2)
        return 0 if w == 0 else v ^ (v >> 1)

    def axis(w: int) -> int:
        return 0 if w == 0 else ones(w - 1) % dims if w % 2 == 0 else ones(w) % dims

    place, following = [], []
    for state in range(n * dims):
        corner, d = divmod(state, dims)
        for octant in range(n):
            w = undo_gray(turn(octant ^ corner, d + 1))
            place.append(w)
            following.append((corner ^ turn(entry(w), -(d + 1))) * dims + (d + axis(w) + 1) % dims)
    return place, following


def hilbert_index(coordinates: list[Column], bits: int) -> Column:
    """The place of a cell on the curve over ``bits`` bits of each coordinate."""
    dims = len(coordinates)
    place, following = (F.array(*map(F.lit, x)) for x in transitions(dims))
    cells = F.array(*(c.cast("int") for c in coordinates))

    def step(acc: Column, bit: Column) -> Column:
        octant = reduce(
            lambda a, b: a.bitwiseOR(b),
            (F.call_function("shiftleft", F.call_function("shiftright", cells[i], bit).bitwiseAND(F.lit(1)), F.lit(i)) for i in range(dims)),
        )
        at = acc["state"] * (1 << dims) + octant
        return F.struct((acc["index"] * (1 << dims) + place[at]).alias("index"), following[at].alias("state"))

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("state"))
    return F.aggregate(F.array(*map(F.lit, range(bits - 1, -1, -1))), start, step)["index"]


def _number(value: Column) -> Column:
    """A number, a date or a boolean as a double; null comes first."""
    return F.coalesce(F.when(value.isNotNull(), F.coalesce(value.cast("double"), F.unix_timestamp(value.cast("timestamp")).cast("double"))), F.lit(float("-inf")))


def string_bounds(rows: DataFrame, name: str, cells: int) -> list[str]:
    """The first values of all cells but the lowest, when the values in order are cut into ``cells`` runs of about equal row counts.

    Whole values count. They are counted first, so only different ones are sorted, by ranges; a running sum within each
    range and one row per range give a value's rank. What comes back are cells - 1 values at most.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    placed = durable(counts.repartitionByRange(tasks, "value").withColumn("part", F.spark_partition_id()), "shard-values")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    ranges = placed.groupBy("part").agg(F.sum("n").alias("own"))
    # a row for each range
    offsets = ranges.select("part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("offset"), F.sum("own").over(W.partitionBy()).alias("total"))
    within = W.partitionBy("part").orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    ranked = placed.withColumn("so_far", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(offsets), "part")
    cell = F.expr(f"(offset + so_far) * {cells} div total")
    return sorted(r["first"] for r in ranked.groupBy(cell.alias("cell")).agg(F.min("value").alias("first")).where("cell > 0").collect())


def hilbert_shards(docs: DataFrame, shards: int = 24, dimensions: tuple[str, ...] = ("source", "lang", "size"), bits: int = 6) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null), curve.

    Sizes are the text's UTF-8 bytes plus 8; a null text has none and the checksum of the empty text. Row counts of the
    shards differ by one at most; slots count from 0 within a shard, along the curve. Within a cell equal
    texts stand together, then doc_id decides; rows that repeat everything are interchangeable. A null
    string is an empty one, a null number comes first. A dimension that docs lacks counts as null. An empty table gives no rows.
    Only these few columns are shuffled, never the texts.
    """
    spark = docs.sparkSession
    size = F.octet_length(whole("text")).cast("long") + 8
    names = [f"d{i}" for i in range(len(dimensions))]

    def dimension(name: str) -> Column:
        if name == "size":
            return size.cast("double")
        if name not in docs.columns:
            return F.lit(0.0)
        return F.coalesce(F.col(name), F.lit("")) if isinstance(docs.schema[name].dataType, T.StringType) else _number(F.col(name))

    rows = durable(
        docs.select("doc_id", size.alias("size"), F.crc32(whole("text").cast("binary")).alias("text_crc32"), *(dimension(d).alias(n) for d, n in zip(dimensions, names))),
        "shard-rows",
    )
    parts = (1 << bits) - 1
    at = F.array(*(F.lit((i + 1) / (parts + 1)) for i in range(parts)))
    strings = [n for n in names if isinstance(rows.schema[n].dataType, T.StringType)]
    # 2**bits - 1 values for each dimension, whatever the size of the input: a cell holds the values up to its bound
    bounds = rows.agg(F.lit(0).alias("none"), *(F.percentile_approx(n, at, 1000).alias(n) for n in names if n not in strings)).first().asDict()
    firsts = {n: string_bounds(rows, n, parts + 1) for n in strings}

    def cell(n: str) -> Column:
        cuts = firsts[n] if n in firsts else sorted(set(bounds[n] or []))
        if not cuts:
            return F.lit(0)
        return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda b: b <= F.col(n) if n in firsts else b < F.col(n)))

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["curve", "text_crc32", "doc_id", "size"]
    placed = durable(
        rows.select("doc_id", "size", "text_crc32", hilbert_index([cell(n) for n in names], bits).alias("curve"))
        .repartitionByRange(tasks, *order)
        .sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id()),  # the partition above bit 33, the row's place in it below
        "shard-order",
    )
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    runs = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # a row for each partition, so one task and a broadcast hold `tasks` rows at most
    offsets = runs.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(W.partitionBy()).alias("total"))
    ranked = placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.col("offset") + place)
    shard = F.expr(f"rank * {shards} div total")
    return ranked.withColumn("shard", shard).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.expr(f"rank - (shard * total + {shards - 1}) div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )


def shard_ranges(placed: DataFrame, columns: list[str]) -> DataFrame:
    """The manifest for pruning: rows and each column's minimum and maximum per shard."""
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *(f(c).alias(f"{k}_{c}") for c in columns for k, f in (("min", F.min), ("max", F.max))))


def op2_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    return hilbert_shards(documents(spark, sf_dir))
