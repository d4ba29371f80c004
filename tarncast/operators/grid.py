"""Calendars and grids, built by exploding sequences: no cross join is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all shuffle partitions, however few bytes they are.

    Used right before a small table is expanded or simulated: adaptive execution sizes
    partitions by bytes and would leave that work to one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def each_day(df: DataFrame, first: str, last: str, name="datetime") -> DataFrame:
    """One row for each day from ``first`` to ``last``."""
    days = F.sequence(F.col(first), F.col(last), F.expr("interval 1 day"))
    return df.withColumn(name, F.explode(days))


def each_member(df: DataFrame, members: int) -> DataFrame:
    return df.withColumn("member", F.explode(F.sequence(F.lit(1), F.lit(members))))


def each_horizon(df: DataFrame, first: int, last: int, ref="reference_datetime") -> DataFrame:
    """One row for each horizon, with its date."""
    return df.withColumn("horizon", F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumn(
        "datetime", F.date_add(ref, F.col("horizon"))
    )


def each_value(df: DataFrame, name: str, values) -> DataFrame:
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def issue_dates(targets: DataFrame, unit: str = "day", keys=("site_id",)) -> DataFrame:
    """Reference dates over the whole recorded period of each series.

    ``unit`` is the issue cadence: every day, or the first day of every week or month.
    """
    span = targets.groupBy(*keys).agg(F.min("datetime").alias("first"), F.max("datetime").alias("last"))
    if unit == "day":
        return each_day(span, "first", "last", "reference_datetime").drop("first", "last")
    step = F.expr(f"interval 1 {unit}")
    start = F.to_date(F.date_trunc(unit, "first"))
    return span.select(
        *keys,
        F.explode(F.sequence(start, F.col("last"), step)).alias("reference_datetime"),
    )
