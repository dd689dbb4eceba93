"""Spatial views over the driver's tables: points, cells, nuclei, annotations, pixels and flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.tiling import Grid, boxes

WIDTH, OVERLAP = 300, 50
POINT_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    x = """CASE WHEN l_linenumber % 4 = 0
      THEN cast((l_partkey div 2000) * 1000 as double) + ((l_orderkey*37 + l_linenumber*101 + l_partkey*13) % 4000) / 4.0D
      ELSE cast((l_partkey div 2000) * 1000 + (l_partkey*389) % 1000 as double) + ((l_orderkey*37 + l_linenumber*101) % 64 - 32) / 4.0D END AS x"""
    y = """CASE WHEN l_linenumber % 4 = 0 THEN ((l_suppkey*211 + l_partkey*17 + l_orderkey*7) % 4000) / 4.0D
      ELSE cast((l_partkey*613 + (l_partkey % 2000) div 1000 * 500) % 1000 as double) + ((l_suppkey*11 + l_orderkey*5) % 64 - 32) / 4.0D END AS y"""
    return table(spark, d, "lineitem").selectExpr(*POINT_KEY, x, y, "concat('G', l_partkey % 50) AS gene")


def cells(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "part").selectExpr(
        "p_partkey AS cell_id",
        "cast((p_partkey div 2000) * 1000 + (p_partkey*389) % 1000 as double) AS cx",
        "cast((p_partkey*613 + (p_partkey % 2000) div 1000 * 500) % 1000 as double) AS cy",
        "cast(4 + p_size % 8 as double) AS hw",
        "cast(4 + (p_size*3) % 8 as double) AS hh",
    )
    return boxes(own, "cell_id")


def nuclei(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "customer").selectExpr(
        "cast(c_custkey as bigint) AS nucleus_id",
        "(c_custkey div 2000) * 1000 + (c_custkey*389) % 1000 + ((c_custkey % 7) - 3) * 1.5D AS cx",
        "(c_custkey*613 + (c_custkey % 2000) div 1000 * 500) % 1000 + ((c_custkey % 5) - 2) * 1.5D AS cy",
        "cast(2 + c_custkey % 3 as double) AS hw",
        "cast(2 + c_custkey % 2 as double) AS hh",
    )
    second = table(spark, d, "supplier").selectExpr(
        "cast(1000000 + s_suppkey as bigint) AS nucleus_id",
        "(s_suppkey div 2000) * 1000 + (s_suppkey*389) % 1000 + 1.5D AS cx",
        "(s_suppkey*613 + (s_suppkey % 2000) div 1000 * 500) % 1000 - 1.0D AS cy",
        "1.0D AS hw",
        "1.0D AS hh",
    )
    return boxes(own.unionByName(second), "nucleus_id")


def annotations(spark: SparkSession, d: str, kind: str | None = None) -> DataFrame:
    """Diamonds of half a diagonal of 10; all of them, or those of one kind (the region's name)."""
    own = table(spark, d, "nation").selectExpr("n_nationkey AS ann_id", "n_regionkey", "cast((n_nationkey*197) % 1000 as double) AS cx", "cast((n_regionkey*211 + n_nationkey*31) % 1000 as double) AS cy")
    if kind is not None:
        own = own.join(table(spark, d, "region").where(F.col("r_name") == kind), F.col("n_regionkey") == F.col("r_regionkey"))
    cx, cy = F.col("cx"), F.col("cy")
    ring = F.array(*(F.struct((cx + x).alias("x"), (cy + y).alias("y")) for x, y in ((10.0, 0.0), (0.0, 10.0), (-10.0, 0.0), (0.0, -10.0))))
    return own.select("ann_id", (cx - 10.0).alias("xmin"), (cy - 10.0).alias("ymin"), (cx + 10.0).alias("xmax"), (cy + 10.0).alias("ymax"), ring.alias("ring"))


def pixels(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "embeddings").select(F.concat(F.lit("ch"), F.col("label").cast("string")).alias("channel"), F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("x", "value"))
    return wide.withColumn("value", F.col("value").cast("double"))


def gene_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.concat(F.lit("G"), F.col("vec_id").cast("string")).alias("gene"), F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double")).alias("value"))


def flow(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(
        "l_linenumber % 5 AS mask",
        "l_tax - 0.04D AS t_y",
        "l_discount - 0.05D AS t_x",
        "l_discount * 10 AS t_prob",
        "5 * (l_tax - 0.04D) + (l_linenumber - 4) / 10.0D AS p_y",
        "5 * (l_discount - 0.05D) - (l_linenumber - 4) / 10.0D AS p_x",
        "(l_quantity - 25) / 10.0D AS p_prob",
    )


def world(spark: SparkSession, d: str) -> Grid:
    blocks = (table(spark, d, "part").agg(F.max("p_partkey")).first()[0] or 0) // 2000 + 1
    return Grid(0, 0, 1000 * blocks, 1000, WIDTH, OVERLAP)


#: The same views for DuckDB.
VIEWS = """
transcripts AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
   CASE WHEN l_linenumber % 4 = 0
        THEN (l_partkey // 2000) * 1000 + ((l_orderkey*37 + l_linenumber*101 + l_partkey*13) % 4000) / 4.0::double
        ELSE (l_partkey // 2000) * 1000 + (l_partkey*389) % 1000 + ((l_orderkey*37 + l_linenumber*101) % 64 - 32) / 4.0::double END AS x,
   CASE WHEN l_linenumber % 4 = 0
        THEN ((l_suppkey*211 + l_partkey*17 + l_orderkey*7) % 4000) / 4.0::double
        ELSE (l_partkey*613 + (l_partkey % 2000) // 1000 * 500) % 1000 + ((l_suppkey*11 + l_orderkey*5) % 64 - 32) / 4.0::double END AS y,
   'G' || (l_partkey % 50) AS gene
  FROM lineitem),
cell_boxes AS (SELECT p_partkey AS cell_id,
   ((p_partkey // 2000) * 1000 + (p_partkey*389) % 1000)::double AS cx,
   ((p_partkey*613 + (p_partkey % 2000) // 1000 * 500) % 1000)::double AS cy,
   (4 + p_size % 8)::double AS hw, (4 + (p_size*3) % 8)::double AS hh FROM part),
cells AS (SELECT cell_id, cx - hw AS xmin, cy - hh AS ymin, cx + hw AS xmax, cy + hh AS ymax FROM cell_boxes),
nucleus_boxes AS (SELECT c_custkey::bigint AS nucleus_id,
   (c_custkey // 2000) * 1000 + (c_custkey*389) % 1000 + ((c_custkey % 7) - 3) * 1.5::double AS cx,
   (c_custkey*613 + (c_custkey % 2000) // 1000 * 500) % 1000 + ((c_custkey % 5) - 2) * 1.5::double AS cy,
   (2 + c_custkey % 3)::double AS hw, (2 + c_custkey % 2)::double AS hh FROM customer
  UNION ALL SELECT (1000000 + s_suppkey)::bigint,
   (s_suppkey // 2000) * 1000 + (s_suppkey*389) % 1000 + 1.5::double,
   (s_suppkey*613 + (s_suppkey % 2000) // 1000 * 500) % 1000 - 1.0::double, 1.0::double, 1.0::double FROM supplier),
nuclei AS (SELECT nucleus_id, cx - hw AS xmin, cy - hh AS ymin, cx + hw AS xmax, cy + hh AS ymax FROM nucleus_boxes),
annotations AS (SELECT n_nationkey AS ann_id, r_name AS kind, ((n_nationkey*197) % 1000)::double AS cx, ((n_regionkey*211 + n_nationkey*31) % 1000)::double AS cy FROM nation JOIN region ON n_regionkey = r_regionkey),
pixels AS (SELECT 'ch' || label AS channel, vec_id::int AS y, (p - 1)::int AS x, embedding[p]::double AS value FROM embeddings, range(1, 65) r(p)),
gene_values AS (SELECT 'G' || vec_id AS gene, (k - 1)::int AS channel, embedding[k]::double AS value FROM embeddings, range(1, 4) r(k)),
flow AS (SELECT l_linenumber % 5 AS mask, (l_tax - 0.04::double) AS t_y, (l_discount - 0.05::double) AS t_x, l_discount * 10 AS t_prob,
   5 * (l_tax - 0.04::double) + (l_linenumber - 4) / 10.0::double AS p_y,
   5 * (l_discount - 0.05::double) - (l_linenumber - 4) / 10.0::double AS p_x, (l_quantity - 25) / 10.0::double AS p_prob FROM lineitem),
world AS (SELECT max(p_partkey) // 2000 + 1 AS nb, ceil((1000 * (max(p_partkey) // 2000 + 1) - 50) / 250.0)::int AS nx FROM part),
patches AS (SELECT (iy * nx + ix)::int AS patch_id, ix::int AS ix, iy::int AS iy, (ix * 250)::double AS xmin, (iy * 250)::double AS ymin, (ix * 250 + 300)::double AS xmax, (iy * 250 + 300)::double AS ymax
  FROM world, range(0, 10000) a(ix), range(0, 4) b(iy) WHERE ix < nx),
assigned AS (SELECT patch_id, t.* FROM transcripts t JOIN patches p ON t.x BETWEEN p.xmin AND p.xmax AND t.y BETWEEN p.ymin AND p.ymax),
counts AS (SELECT p.patch_id, count(a.patch_id) AS n_points FROM patches p LEFT JOIN assigned a USING (patch_id) GROUP BY p.patch_id),
cells_in AS (SELECT p.patch_id, p.xmin AS px, p.ymin AS py, c.*, row_number() OVER (PARTITION BY p.patch_id ORDER BY cell_id)::int AS label FROM cells c
  JOIN patches p ON c.xmin <= p.xmax AND c.xmax >= p.xmin AND c.ymin <= p.ymax AND c.ymax >= p.ymin),
nuclei_in AS (SELECT p.patch_id, p.xmin AS px, p.ymin AS py, c.*, row_number() OVER (PARTITION BY p.patch_id ORDER BY nucleus_id)::int AS label FROM nuclei c
  JOIN patches p ON c.xmin <= p.xmax AND c.xmax >= p.xmin AND c.ymin <= p.ymax AND c.ymax >= p.ymin)
"""
