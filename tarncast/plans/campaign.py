"""All models over all issue dates, and their scores: in one pass, or in slices that survive a restart."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tarncast.plans import baselines, neural, regressions
from tarncast.plans.common import chosen_series, standard_format
from tarncast.plans.scoring import score
from tarncast.sources.sinks import write_table

BASELINE_MODELS = ("Persistence", "DOY")
DRIVER_MODELS = ("TS_Met", "TS_Rain", "TS_AR")
NEURAL_MODEL = "NNAR"
ALL_MODELS = (*BASELINE_MODELS, *DRIVER_MODELS, NEURAL_MODEL)

MANIFEST = "slice date, issues bigint, forecasts bigint, scores bigint"


def forecast_all(
    targets: DataFrame,
    history: DataFrame,
    weather: DataFrame,
    water_temp: DataFrame,
    refs: DataFrame,
    variable: str,
    models=ALL_MODELS,
    start=None,
    min_rows: int | None = None,
    networks: int = 5,
    depths=None,
    depth: Column | None = None,
) -> DataFrame:
    """Forecasts of the chosen models in one long table.

    Models read the targets of ``variable``, and of ``depths`` if given. ``depth`` is what the forecasts carry
    as depth_m (an expression on site_id), so that scores can match it.
    """
    targets = chosen_series(targets, variable, depths)
    common = {"start": start, "min_rows": min_rows}
    runs = {
        "Persistence": lambda: baselines.normal_rows(baselines.persistence(targets, refs)),
        "DOY": lambda: baselines.normal_rows(baselines.climatology(targets, refs)),
        "TS_Met": lambda: regressions.met_regression(targets, history, weather, refs, **common),
        "TS_Rain": lambda: regressions.rain_lag(targets, history, weather, refs, **common),
        "TS_AR": lambda: regressions.ar_forecast(targets, history, weather, water_temp, refs, **common),
        "NNAR": lambda: neural.neural_ar(targets, refs, networks=networks),
    }
    family = {name: "normal" if name in BASELINE_MODELS else "ensemble" for name in runs}
    parts = [standard_format(runs[name](), name, family[name], variable, depth) for name in models]
    return reduce(lambda a, b: a.unionByName(b), parts)


def run_campaign(forecasts: DataFrame, targets: DataFrame, forecast_path: str, score_path: str) -> DataFrame:
    """Store the forecasts, score what was stored, store the scores and return them.

    Scoring reads the stored table: a lost executor costs a re-read, never a re-forecast. The
    models fix their members, so no ensemble can be hot.
    """
    spark = forecasts.sparkSession
    write_table(forecasts, forecast_path)
    scored = score(spark.read.parquet(forecast_path), targets, families=["normal"], bounded=True)
    write_table(scored, score_path)
    return spark.read.parquet(score_path)


# --- in slices, resumable ----------------------------------------------------------------------


def slice_of(unit: str = "month", ref: str = "reference_datetime") -> Column:
    """The first day of the period an issue belongs to."""
    return F.trunc(ref, unit).alias("slice")


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """One row for each finished slice; empty before the first."""
    path = f"{root}/manifest"
    try:
        return spark.read.schema(MANIFEST).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def open_slices(refs: DataFrame, root: str, unit: str = "month") -> DataFrame:
    """Slices of the issues in ``refs`` that no finished run has in its manifest."""
    wanted = refs.groupBy(slice_of(unit)).agg(F.count(F.lit(1)).alias("issues"))
    done = read_manifest(refs.sparkSession, root).select("slice").distinct()
    return wanted.join(done, "slice", "left_anti")


def _store(rows: DataFrame, path: str, unit: str) -> None:
    """Replace the (slice, model) partitions that ``rows`` holds, one file each, and leave all others."""
    placed = rows.withColumn("slice", slice_of(unit))
    (
        placed.repartition("slice", "model_id", "site_id")
        .sortWithinPartitions("slice", "model_id", "site_id", "reference_datetime")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("slice", "model_id")
        .parquet(path)
    )


def run_slices(
    forecast: Callable[[DataFrame], DataFrame],
    targets: DataFrame,
    refs: DataFrame,
    root: str,
    unit: str = "month",
    at_once: int = 12,
    after_store: Callable[[str, list], None] | None = None,
) -> int:
    """Forecast and score every issue in ``refs`` slice by slice; the number of slices run.

    ``forecast(refs)`` gives the long table of the issues it is handed. A slice is the issues of one period of ``unit`` over all
    sites, ``at_once`` of them go through the models together. Below ``root``: ``forecasts`` and
    ``scores``, partitioned by slice and model, and ``manifest``, to which a slice is added when both are stored.
    A run that was killed is simply started again: slices of the manifest are left out by an anti-join, and what the killed
    run had stored of the others is replaced partition by partition, so no row is lost or repeated. ``unit`` has to stay the same.

    The driver holds the open slices (one date each), never rows of them. ``after_store(step, slices)`` is called
    after each stored step.
    """
    spark = refs.sparkSession
    todo = [row["slice"] for row in open_slices(refs, root, unit).orderBy("slice").toLocalIterator()]
    told = after_store or (lambda step, slices: None)
    for first in range(0, len(todo), at_once):
        batch = todo[first : first + at_once]
        issues = refs.filter(slice_of(unit).isin(batch))
        _store(forecast(issues), f"{root}/forecasts", unit)
        told("forecasts", batch)
        stored = spark.read.parquet(f"{root}/forecasts").filter(F.col("slice").isin(batch))
        _store(score(stored.drop("slice"), targets, families=["normal"], bounded=True), f"{root}/scores", unit)
        told("scores", batch)
        counts = [
            spark.read.parquet(f"{root}/{name}").filter(F.col("slice").isin(batch)).groupBy("slice").agg(F.count(F.lit(1)).alias(name))
            for name in ("forecasts", "scores")
        ]
        finished = issues.groupBy(slice_of(unit)).agg(F.count(F.lit(1)).alias("issues"))
        for own in counts:
            finished = finished.join(own, "slice", "left")
        rows = finished.select("slice", "issues", *[F.coalesce(name, F.lit(0)).cast("bigint").alias(name) for name in ("forecasts", "scores")])
        rows.coalesce(1).write.mode("append").parquet(f"{root}/manifest")
        told("manifest", batch)
    return len(todo)


def campaign_sums(spark: SparkSession, root: str) -> DataFrame:
    """Cases, scored cases and sums of the scores for each (model, site, horizon) of a campaign in slices."""
    scores = spark.read.parquet(f"{root}/scores")
    return scores.groupBy("model_id", "site_id", F.datediff("datetime", "reference_datetime").cast("bigint").alias("horizon")).agg(
        F.count(F.lit(1)).alias("cases"), F.count("crps").alias("scored"), F.sum("crps").alias("crps_sum"), F.sum("logs").alias("logs_sum")
    )
