"""From raw readings to daily tables.

All of these are partial aggregates keyed by (series, day): Spark combines on the map side, so
one site holding most of the feed costs no more shuffle than any other. What leaves here has
one row for each series and day, which bounds every later per-series window by the calendar.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarncast.functions.optics import compensate


def not_nan(value: Column) -> Column:
    """NaN becomes NULL, the only missing value downstream."""
    return F.when(~F.isnan(value), value)


def daily_mean(df: DataFrame, values, keys=("site_id",), time="datetime") -> DataFrame:
    """Mean of each value column for each key and calendar day; ``datetime`` becomes the day."""
    means = [F.avg(not_nan(F.col(v))).alias(v) for v in values]
    return df.groupBy(*keys, F.to_date(time).alias("datetime")).agg(*means)


def compensated_daily_mean(df, reading="fdom", temperature="temp_c", keys=("site_id",), rho=-0.01) -> DataFrame:
    """Daily mean of readings corrected one by one to the reference temperature."""
    corrected = df.withColumn(reading, compensate(F.col(reading), F.col(temperature), rho))
    return daily_mean(corrected, [reading], keys)


def to_targets(daily: DataFrame, value: str, variable: str, depth: Column) -> DataFrame:
    """The shared long target table."""
    return daily.select(
        "datetime",
        "site_id",
        depth.cast("double").alias("depth_m"),
        F.lit(variable).alias("variable"),
        F.col(value).alias("observation"),
    )


def within_limits(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Keep readings strictly inside the limits; missing readings go too."""
    return df.filter((F.col(value) > low) & (F.col(value) < high))


def union_feeds(feeds: list[tuple[DataFrame, tuple[str, float, float] | None]]) -> DataFrame:
    """Union of feeds, each with its own range rule or none; repeated rows are kept."""
    cleaned = [within_limits(feed, *rule) if rule else feed for feed, rule in feeds]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cleaned)


def stitch_versions(versions: list[tuple[DataFrame, Column, dict[str, Column]]]) -> DataFrame:
    """Union of successive versions of a source: each is filtered to its period and projected."""
    parts = [
        df.filter(period).select(*[expr.alias(name) for name, expr in columns.items()])
        for df, period, columns in versions
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def ensemble_daily_mean(df: DataFrame, time="datetime") -> DataFrame:
    """Sub-daily driver ensemble to one value for each member and day."""
    return df.groupBy(
        "site_id", "reference_datetime", F.to_date(time).alias("datetime"), "variable", "parameter"
    ).agg(F.avg("prediction").alias("prediction"))


def average_repeats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Repeated measurements of one key resolved by their mean."""
    return df.groupBy(*keys).agg(F.avg(value).alias(value))


def issue_day_history(drivers: DataFrame, variables: list[str], keys=("site_id",)) -> DataFrame:
    """Members averaged on the day of issue: the best available past of each driver, one column each."""
    means = [
        F.avg(F.when(F.col("variable") == v, F.col("prediction"))).alias(v) for v in variables
    ]
    return (
        drivers.filter(F.col("reference_datetime") == F.col("datetime"))
        .groupBy(*keys, "datetime")
        .agg(*means)
    )


def deviation_from_daily_mean(df: DataFrame, value: str, when: Column, keys=("site_id",)) -> DataFrame:
    """Selected readings next to their own day's mean.

    The mean is an aggregate joined back, not a window over raw rows: no day's readings are
    ever gathered in one task, and the selection runs before the join.
    """
    day = F.to_date("datetime")
    means = df.groupBy(*keys, day.alias("date")).agg(F.avg(value).alias("daily_mean"))
    picked = df.filter(when & F.col(value).isNotNull()).withColumn("date", day)
    return picked.join(means, [*keys, "date"]).withColumn("diff", F.col(value) - F.col("daily_mean"))
