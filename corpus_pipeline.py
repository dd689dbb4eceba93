"""The corpus pipeline: from ``documents`` to a tokenised training mix.

Every stage takes all rows that its predecessor kept. run() writes each stage's rows into the cluster's shared
folder and reads them again for the next, so a lost executor repeats one stage at most.

Null and empty texts pass every stage: they are not toxic by any word, all of them are one exact copy, they link with nothing, and
they have no pieces. Rows with a null doc_id are rows like others. Of rows that repeat everything one stays. An empty table
gives no rows. Further columns, whatever their names, go through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import exact, jaccard, mixing, pieces, toxicity
from tesserae.llm.shared import documents, durable


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that score below 0.5."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space: the longest, then that of the smallest doc_id."""
    return exact.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row of the smallest doc_id."""
    return jaccard.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes once for each epoch that has it; where a leaf's token-prefix ends inside one, its text is cut there."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, epoch, n_bytes, n_tokens, ids, lossless. Each epoch's copy of a document has merges skipped of its own."""
    return pieces.encode_documents(docs, epochs=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

#: SQL can express neither the trained scores nor the segmentation; tests hold each stage against brute force on what the one before kept.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
