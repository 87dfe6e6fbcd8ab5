"""What the operators of this subpackage share: session settings, written tables, column helpers."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.session import tune, written  # noqa: F401

# Token libraries run single-threaded inside tasks: Spark deals out the cores.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Rows and bytes of one Arrow batch, so that very long texts do not meet in one batch.
BATCH_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def ready(spark: SparkSession) -> SparkSession:
    """The session with this library's settings and bounded Arrow batches."""
    tune(spark)
    for key, value in BATCH_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a NULL id gives NULL."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(parts)


def text_of(column: str) -> Column:
    """The text, NULL read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
