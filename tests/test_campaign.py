"""The campaign in slices: killed anywhere and started again, it ends with the rows of one undisturbed run."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarncast.operators.grid import issue_dates
from tarncast.plans import campaign
from tarncast.plans.scoring import score

DAY = dt.date(2024, 1, 1)


def on(i):
    return DAY + dt.timedelta(days=i)


@pytest.fixture(scope="module")
def inputs(spark):
    """Two sites of 130 days with gaps, drivers of three members for every issue of the last 70 days."""
    rng = np.random.default_rng(5)
    obs = [(site, on(i), float(10 + math.sin(i / 9) + rng.normal(0, 0.2)), "v", 1.5) for site in "ab" for i in range(130) if i % 11 != 4]
    targets = spark.createDataFrame(obs, "site_id string, datetime date, observation double, variable string, depth_m double")
    history = spark.createDataFrame(
        [(on(i), float(rng.gamma(1, 2)), float(rng.normal(200, 30)), float(rng.normal(12, 3))) for i in range(130)],
        "datetime date, rain double, shortwave double, water_temp double",
    ).cache()
    refs = issue_dates(targets, "day").filter(F.col("reference_datetime") >= F.lit(on(60))).cache()
    names = ["precipitation_flux", "surface_downwelling_shortwave_flux_in_air", "temperature"]
    days = refs.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(35)))).withColumn("parameter", F.explode(F.sequence(F.lit(1), F.lit(3))))
    drivers = days.withColumn("variable", F.explode(F.array(*[F.lit(n) for n in names]))).select(
        "site_id", "reference_datetime", F.expr("date_add(reference_datetime, h)").alias("datetime"), "parameter", "variable",
        (F.pmod(F.xxhash64("site_id", "reference_datetime", "h", "parameter", "variable"), F.lit(1000)) / 100).alias("prediction"),
    ).cache()
    weather, water = drivers.filter("variable <> 'temperature'"), drivers.filter("variable = 'temperature'")

    def forecast(issues):
        return campaign.forecast_all(
            targets, history, weather.join(issues, ["site_id", "reference_datetime"], "left_semi"),
            water.join(issues, ["site_id", "reference_datetime"], "left_semi"), issues, "v", networks=1,
        )

    return targets, refs, forecast


class Killed(Exception):
    pass


def settled(value):
    """A log score of an ensemble that is nearly one point is only known to be huge."""
    if not isinstance(value, float):
        return value
    return "huge" if abs(value) > 1e6 else round(value, 6)


def rows_of(df, *columns):
    return sorted(repr([settled(v) for v in row]) for row in df.select(*columns).collect())


FORECAST = ("model_id", "site_id", "reference_datetime", "datetime", "parameter", "prediction")
SCORE = ("model_id", "site_id", "reference_datetime", "datetime", "observation", "crps", "logs")


def test_killed_and_restarted(spark, inputs, tmp_path):
    targets, refs, forecast = inputs
    root = f"{tmp_path}/campaign"
    kills = iter([("forecasts", 0), ("scores", 1), ("manifest", 0)])
    kill, seen = next(kills), 0

    def after_store(step, batch):
        nonlocal seen
        if kill and step == kill[0]:
            seen += 1
            if seen > kill[1]:
                raise Killed

    ran = []
    while kill:
        seen = 0
        with pytest.raises(Killed):
            campaign.run_slices(forecast, targets, refs, root, at_once=1, after_store=after_store)
        ran.append(campaign.read_manifest(spark, root).count())
        kill = next(kills, None)
    assert ran == [0, 1, 2]  # nothing, one slice finished before the second was killed, and one more
    assert campaign.open_slices(refs, root).count() == 1
    assert campaign.run_slices(forecast, targets, refs, root, at_once=1) == 1
    assert campaign.run_slices(forecast, targets, refs, root, at_once=1) == 0

    whole = forecast(refs)
    stored, scores = spark.read.parquet(f"{root}/forecasts"), spark.read.parquet(f"{root}/scores")
    # The record is shorter than a year: the climatology has no earlier one.
    assert {r["model_id"] for r in stored.select("model_id").distinct().collect()} == set(campaign.ALL_MODELS) - {"DOY"}
    assert rows_of(stored, *FORECAST) == rows_of(whole, *FORECAST)
    assert rows_of(scores, *SCORE) == rows_of(score(whole, targets, families=["normal"], bounded=True), *SCORE)
    manifest = {r["slice"]: r for r in campaign.read_manifest(spark, root).collect()}
    assert sorted(manifest) == [dt.date(2024, 3, 1), dt.date(2024, 4, 1), dt.date(2024, 5, 1)]
    assert sum(r["forecasts"] for r in manifest.values()) == stored.count() and sum(r["scores"] for r in manifest.values()) == scores.count()
    assert sum(r["issues"] for r in manifest.values()) == refs.count()


def test_only_touched_slices_are_read_and_written(spark, inputs, tmp_path):
    """A slice added later leaves the files of the others as they are; its scoring reads its own partitions."""
    targets, refs, forecast = inputs
    root = f"{tmp_path}/campaign"
    fewer = lambda issues: campaign.forecast_all(targets, None, None, None, issues, "v", campaign.BASELINE_MODELS)
    early = refs.filter(F.col("reference_datetime") < F.lit(dt.date(2024, 5, 1)))
    assert campaign.run_slices(fewer, targets, early, root) == 2
    before = {f for f in spark.read.parquet(f"{root}/scores").inputFiles()}
    assert campaign.run_slices(fewer, targets, refs, root) == 1
    after = {f for f in spark.read.parquet(f"{root}/scores").inputFiles()}
    assert before < after and all("slice=2024-05-01" in f for f in after - before)
    plan = spark.read.parquet(f"{root}/forecasts").filter(F.col("slice").isin([dt.date(2024, 5, 1)]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(slice" in plan or "PartitionFilters: [(slice" in plan or "PartitionFilters: [slice" in plan
    sums = campaign.campaign_sums(spark, root).collect()
    assert {r["model_id"] for r in sums} == {"Persistence"}
    assert sum(r["cases"] for r in sums) == spark.read.parquet(f"{root}/scores").count()


def test_no_issues(spark, inputs, tmp_path):
    targets, refs, forecast = inputs
    assert campaign.run_slices(forecast, targets, refs.limit(0), f"{tmp_path}/none") == 0
    assert campaign.read_manifest(spark, f"{tmp_path}/none").count() == 0
