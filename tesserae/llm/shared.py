"""Helpers of all operators here: free column names, text columns, and the core's durable tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.sources.tables import durable, scratch  # noqa: F401  the operators here take durable from this module

#: White space as the operators' contracts state it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def bucketed(df: DataFrame, key: str, name: str) -> tuple[DataFrame, Callable[[], None]]:
    """df as a table in the shared folder, dealt and sorted by ``key``, so that joins by it shuffle the other side only; and what takes
    the table's name out of the catalog once it is not needed."""
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(tasks, key).write.format("parquet").option("path", scratch(spark, name)).bucketBy(tasks, key).sortBy(key).saveAsTable(table)
    return spark.table(table), lambda: spark.sql(f"DROP TABLE {table}") and None


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name in taken:
        name += "_"
    return name


def whole(text: Column | str = "text") -> Column:
    """A text; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and leave every other letter as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_batches(spark: SparkSession, rows: int = 250) -> None:
    """Read and hand over texts and packed columns in batches of at most ``rows``: Spark's thousands of rows suit
    numbers, but with many kilobytes a row they fill an executor's memory. Smaller settings of the session stay."""
    for name in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        if not 0 < int(spark.conf.get(name)) <= rows:
            spark.conf.set(name, str(rows))
