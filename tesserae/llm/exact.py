"""Exact deduplication that splits off heavy hitters.

Spark's ``freqItems`` keeps a Misra-Gries summary (at most 1/support counters) in each task and merges
the summaries. Its candidates are counted exactly, their winners - at most 1/support rows - are
broadcast and settle the frequent digests without a shuffle. The remaining digests, none of which
holds more than a ``support`` part of the rows, are grouped by an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.llm.shared import SPACE, documents, durable, fresh, whole


def text_digest(text: Column) -> Column:
    """SHA-256 (lowercase hex) of the text without the characters of ``[\\x20\\x09-\\x0D]``."""
    return F.sha2(F.regexp_replace(whole(text), SPACE, "").cast("binary"), 256)


def _winner() -> list[Column]:
    """The row that stays: longest original text, then smallest doc_id (null last), then first row."""
    order = F.struct((-F.col("size")).alias("len"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    return [F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size")]


def exact_groups(docs: DataFrame, support: float = 0.001) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are one group. Rows that repeat a doc_id and a text are rows of one group, of
    which exactly one has ``kept``. A null doc_id stays only if no other row of its group is as long.
    An empty table gives no rows. Columns besides doc_id and text are not looked at.
    """
    rows = durable(
        docs.select("doc_id", F.length(whole("text")).cast("long").alias("size"), text_digest(F.col("text")).alias("digest")).withColumn("row", F.monotonically_increasing_id()),
        "exact-digests",
    )
    candidates = rows.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    # at most 1/support rows each: Misra-Gries keeps no more counters
    heavy = durable(rows.join(F.broadcast(candidates), "digest").groupBy("digest").agg(*_winner()), "exact-heavy")
    settled = rows.join(F.broadcast(heavy), "digest")
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    others = rest.join(rest.groupBy("digest").agg(*_winner()), "digest")
    return settled.unionByName(others).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, support: float = 0.001) -> DataFrame:
    """The rows of docs that stay, with all columns of docs, whatever their names.

    The decision is joined by doc_id and digest together, so a null or repeated doc_id meets its own
    text only; of rows that repeat both, one stays.
    """
    key, order = fresh(docs, "key"), fresh(docs, "order")

    def of(digest: Column) -> Column:
        return F.concat_ws(":", digest, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))

    kept = exact_groups(docs, support).where("kept").select(of(F.col("text_sha256")).alias(key))
    found = docs.withColumn(key, of(text_digest(F.col("text")))).join(kept, key, "left_semi")
    first = W.partitionBy(key).orderBy(F.length(whole("text")).desc())
    return found.withColumn(order, F.row_number().over(first)).where(F.col(order) == 1).select(*docs.columns)


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


OP6_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS size,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id) AS place,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
"""
