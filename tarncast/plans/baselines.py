"""The two baselines: day-of-year climatology and persistence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarncast.functions.noise import draw_key, uniform_index
from tarncast.operators.grid import each_horizon, spread
from tarncast.operators.series import consecutive_change
from tarncast.plans.common import HORIZON, mu_sigma_rows


def doy_statistics(targets: DataFrame, keys=("site_id",)) -> DataFrame:
    """Mean and spread of each day of the year over the whole record."""
    return targets.groupBy(*keys, F.dayofyear("datetime").alias("doy")).agg(
        F.avg("observation").alias("clim_mean"), F.stddev_samp("observation").alias("clim_sd")
    )


def climatology(
    targets: DataFrame,
    refs: DataFrame,
    horizon: int = HORIZON,
    keys=("site_id",),
    min_dates: int = 3,
    inclusive_end: bool = False,
) -> DataFrame:
    """Normal forecast from earlier years: keys, reference_datetime, datetime, mu, sigma.

    mu is the mean of that day of the year before the reference date; sigma is the median, over
    the horizon, of the day-of-year spreads. Days never observed before are left out, and a
    forecast with fewer than ``min_dates`` days is not issued.

    Observations and requested days meet in one ordered pass for each (series, day of year).
    Such a group holds a handful of years, so no series is ever one task.
    """
    keys = list(keys)
    asks = each_horizon(refs.select(*keys, "reference_datetime"), 1, horizon + inclusive_end).select(
        *keys,
        F.dayofyear("datetime").alias("doy"),
        F.col("reference_datetime").alias("at"),
        F.lit(0).alias("turn"),
        "reference_datetime",
        "datetime",
        F.lit(None).cast("double").alias("observation"),
    )
    seen = targets.filter(F.col("observation").isNotNull()).select(
        *keys,
        F.dayofyear("datetime").alias("doy"),
        F.col("datetime").alias("at"),
        F.lit(1).alias("turn"),
        F.lit(None).cast("date").alias("reference_datetime"),
        F.lit(None).cast("date").alias("datetime"),
        "observation",
    )
    past = W.partitionBy(*keys, "doy").orderBy("at", "turn").rowsBetween(W.unboundedPreceding, W.currentRow)
    days = (
        seen.unionByName(asks)
        .select(
            *keys,
            "reference_datetime",
            "datetime",
            F.avg("observation").over(past).alias("mu"),
            F.stddev_samp("observation").over(past).alias("clim_sd"),
        )
        .filter(F.col("reference_datetime").isNotNull() & F.col("mu").isNotNull())
    )
    issue = W.partitionBy(*keys, "reference_datetime")
    return (
        days.withColumn("dates", F.count(F.lit(1)).over(issue))
        .withColumn("sigma", F.median("clim_sd").over(issue))
        .filter(F.col("dates") >= min_dates)
        .select(*keys, "reference_datetime", "datetime", "mu", "sigma")
    )


def persistence_state(targets: DataFrame, refs: DataFrame, keys=("site_id",)) -> DataFrame:
    """Last known value before each reference date, its date, and the mean squared daily change."""
    keys = list(keys)
    known = targets.filter(F.col("observation").isNotNull())
    days = known.withColumn("change", consecutive_change(known, keys, "observation")).select(
        *keys,
        F.col("datetime").alias("at"),
        F.lit(1).alias("turn"),
        F.lit(None).cast("date").alias("reference_datetime"),
        F.col("datetime").alias("last_date"),
        F.col("observation").alias("mu"),
        (F.col("change") * F.col("change")).alias("squared"),
    )
    asks = refs.select(
        *keys,
        F.col("reference_datetime").alias("at"),
        F.lit(0).alias("turn"),
        "reference_datetime",
        F.lit(None).cast("date").alias("last_date"),
        F.lit(None).cast("double").alias("mu"),
        F.lit(None).cast("double").alias("squared"),
    )
    past = W.partitionBy(*keys).orderBy("at", "turn").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        days.unionByName(asks)
        .select(
            *keys,
            "reference_datetime",
            F.last("last_date", ignorenulls=True).over(past).alias("last_date"),
            F.last("mu", ignorenulls=True).over(past).alias("mu"),
            F.avg("squared").over(past).alias("step_variance"),
            F.count("squared").over(past).alias("changes"),
        )
        .filter(F.col("reference_datetime").isNotNull() & F.col("mu").isNotNull())
    )


def persistence(targets: DataFrame, refs: DataFrame, horizon: int = HORIZON, keys=("site_id",)) -> DataFrame:
    """Random walk from the last known value: keys, reference_datetime, datetime, mu, sigma.

    The walk starts the day after the last value, so sigma is the root of the mean squared daily
    change times the days since then. Dates run to ``horizon - 1`` days past the reference date:
    the walk has ``horizon`` steps beyond the gap and its first one lands on the reference date
    when the last value is from the day before.
    """
    state = persistence_state(targets, refs, keys)
    steps = F.datediff("datetime", "last_date")
    return each_horizon(state, 1, horizon - 1).select(
        *keys,
        "reference_datetime",
        "datetime",
        "mu",
        F.sqrt(F.col("step_variance") * steps).alias("sigma"),
    )


def persistence_bootstrap(
    targets: DataFrame, refs: DataFrame, horizon: int = HORIZON, paths: int = 200, keys=("site_id",)
) -> DataFrame:
    """Random walk with resampled daily changes: one row for each path and day.

    Changes of a series are numbered in date order; the changes before a reference date are then
    the first ``changes`` numbers, so a draw is a number and fetching it an equality join. No
    list of changes is carried to the forecasts.
    """
    keys = list(keys)
    known = targets.filter(F.col("observation").isNotNull())
    changes = known.withColumn("change", consecutive_change(known, keys, "observation")).filter(
        F.col("change").isNotNull()
    )
    numbered = changes.select(
        *keys,
        F.row_number().over(W.partitionBy(*keys).orderBy("datetime")).alias("pick"),
        "change",
    )
    gap = F.datediff("reference_datetime", "last_date")
    walks = (
        spread(persistence_state(targets, refs, keys), *keys, "reference_datetime")
        .filter(F.col("changes") > 0)
        .withColumn("path", F.explode(F.sequence(F.lit(1), F.lit(paths))))
        .withColumn("step", F.explode(F.sequence(F.lit(1), gap + horizon - 1)))
    )
    key = draw_key(*[F.col(k) for k in keys], F.col("reference_datetime"), F.col("path"), F.lit("boot"), F.col("step"))
    drawn = walks.withColumn("pick", uniform_index(key, F.col("changes"))).join(numbered, [*keys, "pick"])
    run = (
        W.partitionBy(*keys, "reference_datetime", "path")
        .orderBy("step")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return (
        drawn.select(
            *keys,
            "reference_datetime",
            F.expr("date_add(last_date, step)").alias("datetime"),
            F.col("path").cast("string").alias("parameter"),
            (F.col("mu") + F.sum("change").over(run)).alias("prediction"),
        )
        .filter(F.col("datetime") > F.col("reference_datetime"))
    )


def normal_rows(forecast: DataFrame) -> DataFrame:
    """mu and sigma columns to parameter rows."""
    return mu_sigma_rows(forecast)
