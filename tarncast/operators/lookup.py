"""Joins with a meaning of their own: as-of, splice, upsert, membership."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def in_or_null(column: Column, values) -> Column:
    """Membership that also accepts a missing value."""
    return column.isin(*values) | column.isNull()


def in_strict(column: Column, values) -> Column:
    """Membership that is false, never NULL, for a missing value."""
    return F.coalesce(column.isin(*values), F.lit(False))


def splice(history: DataFrame, forecast: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One series from two: the history where it is known, the forecast elsewhere."""
    past = history.select(*keys, F.col(value).alias("past"))
    return (
        forecast.join(past, keys, "full")
        .withColumn(value, F.coalesce("past", value))
        .drop("past")
    )


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values replaced by the changes with the same key; no rows are added."""
    new = changes.select(*keys, F.col(value).alias("new"), F.lit(True).alias("changed"))
    return (
        table.join(new, keys, "left")
        .withColumn(value, F.when(F.col("changed"), F.col("new")).otherwise(F.col(value)))
        .drop("new", "changed")
    )


def last_before(observations: DataFrame, refs: DataFrame, keys: list[str], value: str, inclusive=False) -> DataFrame:
    """Latest known value and its date before each reference date.

    Observations and reference dates run through one ordered pass for each series instead of
    an interval join, so the cost is their sum and never their product.
    """
    obs = observations.filter(F.col(value).isNotNull()).select(
        *keys,
        F.col("datetime").alias("at"),
        F.lit(0 if inclusive else 1).alias("turn"),
        F.lit(None).cast("date").alias("reference_datetime"),
        F.col("datetime").alias("last_date"),
        F.col(value).alias("last_value"),
    )
    asks = refs.select(
        *keys,
        F.col("reference_datetime").alias("at"),
        F.lit(1 if inclusive else 0).alias("turn"),
        "reference_datetime",
        F.lit(None).cast("date").alias("last_date"),
        F.lit(None).cast("double").alias("last_value"),
    )
    past = W.partitionBy(*keys).orderBy("at", "turn").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        obs.unionByName(asks)
        .select(
            *keys,
            "reference_datetime",
            F.last("last_date", ignorenulls=True).over(past).alias("last_date"),
            F.last("last_value", ignorenulls=True).over(past).alias("last_value"),
        )
        .filter(F.col("reference_datetime").isNotNull())
    )


def value_at(observations: DataFrame, refs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Observation exactly on the reference date; NULL when there is none."""
    on_day = observations.select(*keys, F.col("datetime").alias("reference_datetime"), value)
    return refs.join(on_day, [*keys, "reference_datetime"], "left")


def known(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs in the other table."""
    return df.join(other.select(*keys), keys, "left_semi")


def unknown(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key does not occur in the other table."""
    return df.join(other.select(*keys), keys, "left_anti")


def attach_all(base: DataFrame, others: list[DataFrame], keys: list[str]) -> DataFrame:
    """Left join of several sources on one key."""
    return reduce(lambda a, b: a.join(b, keys, "left"), others, base)
