"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVALUATION_SCHEMA_VERSION = 4


def write_csv(rows: DataFrame, path: str, separator: str = ",") -> None:
    """An extract as delimited files with a header; quotes inside a field are doubled."""
    rows.write.mode("overwrite").options(header=True, sep=separator, escape='"').csv(path)


def write_by_year(rows: DataFrame, path: str, gather: bool = True) -> None:
    """A fact as Parquet, a folder per underwriting year.

    Rows are gathered by year before writing, so a year becomes few large files. A year
    that holds much of the table is split over several tasks by the rebalance hint. Without
    ``gather`` rows stay in their tasks, each of which writes a file for each of its years:
    wide rows of a large table cost more to move than to read from more files.
    """
    rows = rows.hint("rebalance", "uw_year") if gather else rows
    rows.write.mode("overwrite").partitionBy("uw_year").parquet(path)


def append_evaluations(records: DataFrame, path: str) -> None:
    """Append answered questions as zstd Parquet, a folder per UTC date and batch.

    Only the folders of the records' batches are replaced, so a batch that is written again,
    after a failure or by mistake, leaves one copy.
    """
    utc = F.to_utc_timestamp("timestamp_utc", F.current_timezone())
    (
        records.withColumn("date", F.to_date(utc))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("date", "batch")
        .parquet(path)
    )
