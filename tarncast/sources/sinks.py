"""Writers. Rows are clustered by partition value before a partitioned write; Spark splits a value that
holds many rows over several tasks, from its measured size, and no task opens every folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ISSUE = ["reference_datetime", "site_id"]


def _clustered(df: DataFrame, partitioning: list[str], spread: int | None) -> DataFrame:
    """``spread`` fixes the number of tasks for a partition value; without it adaptive execution decides."""
    if spread is None:
        return df.hint("rebalance", *[F.col(c) for c in partitioning])
    data = [c for c in df.columns if c not in partitioning] or df.columns
    salt = F.pmod(F.xxhash64(*data), F.lit(spread))
    return df.repartition(*partitioning, salt)


def write_dataset(
    df: DataFrame, path: str, partitioning: list[str] = ISSUE, mode: str = "errorifexists", spread: int | None = None,
    compression: str = "zstd",
) -> None:
    """Hive-partitioned Parquet."""
    _clustered(df, partitioning, spread).write.mode(mode).option("compression", compression).partitionBy(
        *partitioning
    ).parquet(path)


def write_forecasts(df: DataFrame, path: str, spread: int | None = None) -> None:
    """Forecasts of any number of models and issues, one folder for each: a rerun replaces its own."""
    replace_partitions(df, path, ["model_id", "reference_datetime"], spread)


def write_table(df: DataFrame, path: str) -> None:
    """One combined table."""
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, compression: str | None = None, partitioning: list[str] = ()) -> None:
    """Delimited text with a header; missing values as NA."""
    writer = df.write.mode("overwrite").option("header", True).option("nullValue", "NA")
    if compression:
        writer = writer.option("compression", compression)
    if partitioning:
        writer = writer.partitionBy(*partitioning)
    writer.csv(path)


def replace_partitions(df: DataFrame, path: str, partitioning: list[str], spread: int | None = None) -> None:
    """Overwrite only the partitions that ``df`` has rows for."""
    _clustered(df, partitioning, spread).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(*partitioning).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
