"""Sinks: tables, JSON lines, guarded writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wagerframe.functions import checks


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """CSV with every cell quoted, columns in order; refuses an existing path unless told otherwise."""
    mode = "overwrite" if overwrite else "errorifexists"
    df.write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_lines(lines: DataFrame, path: str, overwrite: bool = False) -> None:
    lines.write.mode("overwrite" if overwrite else "errorifexists").text(path)


def publish(df: DataFrame, path: str, partition_by: list[str] | None = None, replace: bool = False) -> None:
    """Write a result table; the output committer makes it visible as a whole.

    An existing table is refused unless ``replace`` is set; with partitions, only
    those in ``df`` are then replaced.
    """
    writer = df.write.mode("overwrite" if replace else "errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def refuse_literal_newlines(df: DataFrame, columns: list[str], dataset: str) -> DataFrame:
    """Raise, with counts, when reasoning cells hold backslash newlines."""
    flags = [F.coalesce(checks.has_literal_newline(F.col(c)), F.lit(False)) for c in columns]
    cells = sum((f.cast("long") for f in flags), F.lit(0))
    found = df.agg(F.sum(cells).alias("cells"), F.count_if(cells > 0).alias("rows")).first()
    if found["cells"]:
        raise ValueError(
            f"{dataset}: {found['cells']} cells in {found['rows']} rows hold literal backslash newlines; "
            "normalise them before scoring"
        )
    return df
