"""Daily series: gaps, lags, rolling sums and interpolation.

Input is daily (one row for each series and day, see ``daily``), so a window partition holds at
most the days of the record, whatever share of the raw feed the series had.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarncast.operators.grid import each_day


def horizon(datetime="datetime", ref="reference_datetime") -> Column:
    """Days from the reference date."""
    return F.datediff(F.col(datetime), F.col(ref))


def scaffold(df: DataFrame, keys: list[str], value: str, end: Column | None = None) -> DataFrame:
    """Every day of each series from its first known value to ``end``, gaps as NULL."""
    known = df.filter(F.col(value).isNotNull())
    span = known.groupBy(*keys).agg(F.min("datetime").alias("first"), F.max("datetime").alias("last"))
    if end is not None:
        span = span.withColumn("last", end)
    days = each_day(span, "first", "last").drop("first", "last")
    return days.join(df.select(*keys, "datetime", value), [*keys, "datetime"], "left")


def previous(value: str, keys: list[str], steps: int = 1, order="datetime") -> Column:
    """Value ``steps`` rows earlier; on a scaffold a row is a day."""
    return F.lag(value, steps).over(W.partitionBy(*keys).orderBy(order))


def rolling_sum(value: str, keys: list[str], width: int, order="datetime") -> Column:
    """Trailing sum over ``width`` rows; NULL until the window is full and where any value is missing."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(1 - width, 0)
    return F.when(F.count(value).over(w) == width, F.sum(value).over(w))


def interpolate(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Interior gaps linear in time, leading gaps back-filled, trailing gaps carried forward."""
    series = W.partitionBy(*keys).orderBy("datetime")
    back = series.rowsBetween(W.unboundedPreceding, W.currentRow)
    # Looking ahead is looking back in descending order: a running frame, linear in the series.
    ahead = W.partitionBy(*keys).orderBy(F.desc("datetime")).rowsBetween(W.unboundedPreceding, W.currentRow)
    day = F.when(F.col(value).isNotNull(), F.col("datetime"))
    marked = df.select(
        "*",
        F.last(value, ignorenulls=True).over(back).alias("v0"),
        F.last(day, ignorenulls=True).over(back).alias("d0"),
        F.last(value, ignorenulls=True).over(ahead).alias("v1"),
        F.last(day, ignorenulls=True).over(ahead).alias("d1"),
    )
    share = F.datediff("datetime", "d0") / F.datediff("d1", "d0")
    between = F.col("v0") + (F.col("v1") - F.col("v0")) * share
    filled = F.coalesce(F.col(value), between, F.col("v0"), F.col("v1"))
    return marked.withColumn(value, filled).drop("v0", "d0", "v1", "d1")


def first_known(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """First known value of each series and its date: a mergeable arg-min, no sort."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(F.min("datetime").alias("datetime"), F.min_by(value, "datetime").alias(value))
    )


def rows_between(df: DataFrame, keys: list[str], order: list[str], first: int, last: int) -> DataFrame:
    """Rows ``first`` to ``last`` of each series in recorded order."""
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("row", rn).filter(F.col("row").between(first, last))


def consecutive_change(df: DataFrame, keys: list[str], value: str) -> Column:
    """Change from the previous calendar day; NULL across a gap."""
    w = W.partitionBy(*keys).orderBy("datetime")
    step = F.datediff("datetime", F.lag("datetime").over(w))
    return F.when(step == 1, F.col(value) - F.lag(value).over(w))


def event_response(daily: DataFrame, events: DataFrame, keys: list[str], value: str, days_after=10) -> DataFrame:
    """Value the day before an event, the value ``days_after`` days after it, and the extremes between.

    Each event names the few dates it needs, so the join is an equality on the date.
    """
    spans = events.select("event_date", F.explode(F.sequence(F.lit(-1), F.lit(days_after))).alias("offset"))
    spans = spans.withColumn("datetime", F.date_add("event_date", F.col("offset")))

    def at(offset):
        return F.max(F.when(F.col("offset") == offset, F.col(value)))

    return (
        daily.join(spans, "datetime")
        .groupBy("event_date", *keys)
        .agg(
            at(-1).alias("before"),
            at(days_after).alias("after"),
            F.max(value).alias("highest"),
            F.min(value).alias("lowest"),
        )
        .withColumn("change", F.col("after") - F.col("before"))
    )


def depth_difference(df: DataFrame, value: str, top: float, bottom: float, keys=("site_id",)) -> DataFrame:
    """Daily difference between two depths of a profile."""

    def at(depth):
        return F.avg(F.when(F.col("depth_m") == depth, F.col(value)))

    return (
        df.groupBy(*keys, F.to_date("datetime").alias("datetime"))
        .agg(at(top).alias("top"), at(bottom).alias("bottom"))
        .withColumn("diff", F.col("top") - F.col("bottom"))
    )


def first_date_below(df: DataFrame, keys: list[str], value: str, threshold: float) -> DataFrame:
    """First day a series falls below a threshold."""
    return df.groupBy(*keys).agg(
        F.min(F.when(F.col(value) < threshold, F.col("datetime"))).alias("first_below")
    )
