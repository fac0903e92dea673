"""What the operators share: word patterns, intermediate tables, small batches."""

from __future__ import annotations

from pyspark.sql import SparkSession

from wagerframe.session import save, shared_folder  # noqa: F401  (used by the operators)

WHITE_SPACE = " \t\n\x0b\x0c\r"  # [\x20\x09-\x0D]
WORD = r"[^\x20\x09-\x0D]+"


def bounded_batches(spark: SparkSession, rows: int = 1000, size: str = "32m") -> None:
    """Keep the batches that Python workers receive small, whatever the length of a text."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
