"""The shared test tables in the roles of the forecasting tables.

Each function takes (spark, folder) and returns whole tables under the names the operators use;
``catalog.roles`` states the same definitions in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarncast.functions.noise import mixed
from tarncast.operators.grid import each_horizon, each_member, issue_dates, spread
from tarncast.plans import baselines
from tarncast.plans.common import default_depth
from tarncast.plans.evaluation import with_horizon, with_model_type
from tarncast.plans.scoring import SCORES, SUMMARIES, score_parametric, with_summaries

VARIABLE = "fdom_mean"
FOCAL_DEPTHS = {"1-URGENT": 1.6}
OTHER_DEPTH = 1.5
DRIVER_NAMES = {
    "rain": "precipitation_flux",
    "shortwave": "surface_downwelling_shortwave_flux_in_air",
    "water_temp": "temperature",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sensor(spark, folder) -> DataFrame:
    """Raw readings of five sites."""
    return table(spark, folder, "events").select(
        F.col("event_type").alias("site_id"),
        F.col("ts").alias("datetime"),
        F.col("value").alias("fdom"),
        (5 + F.col("user_id") % 25).cast("double").alias("temp_c"),
        F.when(F.col("user_id") % 2 == 0, 0.1).otherwise(9.0).alias("depth_m"),
        "event_id",
    )


def targets(spark, folder) -> DataFrame:
    """Daily targets of five sites over several years, with real gaps."""
    orders = table(spark, folder, "orders")
    daily = orders.groupBy(
        F.col("o_orderpriority").alias("site_id"), F.to_date("o_orderdate").alias("datetime")
    ).agg((F.avg("o_totalprice") / 10000).alias("observation"))
    return daily.withColumn("variable", F.lit(VARIABLE)).withColumn(
        "depth_m", default_depth(F.col("site_id"), FOCAL_DEPTHS, OTHER_DEPTH)
    )


def driver_history(spark, folder) -> DataFrame:
    """Daily weather and water temperature, shared by the sites."""
    return (
        table(spark, folder, "lineitem")
        .groupBy(F.to_date("l_shipdate").alias("datetime"))
        .agg(F.avg("l_discount").alias("rain"), F.avg("l_quantity").alias("shortwave"), F.avg("l_tax").alias("water_temp"))
    )


def daily_refs(spark, folder) -> DataFrame:
    """Every day of every site's record as an issue date."""
    return issue_dates(targets(spark, folder), "day")


def monthly_refs(spark, folder) -> DataFrame:
    """First day of every month of every site's record as an issue date."""
    return issue_dates(targets(spark, folder), "month")


def driver_ensemble(spark, folder, refs, columns=tuple(DRIVER_NAMES), members: int = 31, horizon: int = 35) -> DataFrame:
    """Ensemble driver forecasts for each issue: the recorded day plus noise that grows with the horizon."""
    history = driver_history(spark, folder)
    days = each_horizon(refs.select("site_id", "reference_datetime"), 0, horizon)
    based = days.join(history.select("datetime", *columns), "datetime", "left")
    based = based.select(
        "site_id", "reference_datetime", "datetime", "horizon",
        *[F.coalesce(F.col(c), history.agg(F.avg(c)).scalar()).alias(c) for c in columns],
    )
    rows = each_member(spread(based, "site_id", "reference_datetime", "horizon"), members)

    def entry(column):
        day = (F.unix_date("reference_datetime").cast("bigint") * 31 + F.col("member")) * 37 + F.col("horizon")
        key = day * 7 + list(DRIVER_NAMES).index(column) + F.ascii("site_id").cast("bigint") * 1000003
        noise = 0.01 * F.col("horizon") * mixed(key)
        return F.struct(F.lit(DRIVER_NAMES[column]).alias("variable"), (F.col(column) + noise).alias("prediction"))

    return rows.withColumn("entry", F.explode(F.array(*[entry(c) for c in columns]))).select(
        "site_id", "reference_datetime", "datetime", F.col("member").alias("parameter"), "entry.variable", "entry.prediction"
    )


def weather(spark, folder, refs) -> DataFrame:
    return driver_ensemble(spark, folder, refs, ("rain", "shortwave"))


def water_temperature(spark, folder, refs) -> DataFrame:
    return driver_ensemble(spark, folder, refs, ("water_temp",))


def order_ensembles(spark, folder) -> DataFrame:
    """Ensembles of varying size with one observation each."""
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.col("l_extendedprice").alias("prediction")
    )
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("case_id"), F.col("o_totalprice").alias("observation")
    )
    return lines.join(orders, "case_id")


def flag_ensembles(spark, folder) -> DataFrame:
    """Three ensembles, each holding about a third of all rows."""
    lines = table(spark, folder, "lineitem")
    return lines.select(
        F.col("l_returnflag").alias("case_id"),
        F.col("l_extendedprice").alias("prediction"),
        F.lit(30000.0).alias("observation"),
    )


def normal_cases(spark, folder) -> DataFrame:
    """Normal forecasts with an observation."""
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_quantity").alias("mu"),
        (1 + 100 * F.col("l_tax")).alias("sigma"),
        (F.col("l_quantity") + 100 * (F.col("l_discount") - 0.05)).alias("observation"),
    )


MODELS = ["Persistence", "DOY", "Shifted", "Blend"]
BASELINES = {"P": "Persistence", "C": "DOY"}


def model_forecasts(spark, folder) -> DataFrame:
    """Both baselines and two variants of them for every day of the record, one row for each case and model.

    Only cases that both baselines cover: the variants are made of the two.
    """
    obs, refs = targets(spark, folder), daily_refs(spark, folder)
    case = ["site_id", "reference_datetime", "datetime"]
    walk = baselines.persistence(obs, refs)
    clim = baselines.climatology(obs, refs).withColumnsRenamed({"mu": "mu_c", "sigma": "sigma_c"})
    both = walk.join(clim, case)

    def model(name, mu, sigma):
        return F.struct(F.lit(name).alias("model_id"), mu.alias("mu"), sigma.alias("sigma"))

    mu, sigma, mu_c, sigma_c = (F.col(c) for c in ("mu", "sigma", "mu_c", "sigma_c"))
    entries = F.array(
        model("Persistence", mu, sigma),
        model("DOY", mu_c, sigma_c),
        model("Shifted", mu + 0.5, sigma),
        model("Blend", (mu + mu_c) / 2, F.sqrt((sigma * sigma + sigma_c * sigma_c) / 2)),
    )
    return both.select(*case, F.explode(entries).alias("m")).select(*case, "m.*")


def scored_models(spark, folder) -> DataFrame:
    """``model_forecasts`` with observations, scores, summaries and horizon."""
    obs = targets(spark, folder).select("site_id", "datetime", "observation")
    wide = model_forecasts(spark, folder).join(obs, ["site_id", "datetime"], "left")
    scored = score_parametric(wide.withColumn("family", F.lit("normal")), families=["normal"])
    names = ["site_id", "reference_datetime", "datetime", "model_id", "observation", "mu", "sigma", *SCORES, *SUMMARIES]
    return with_model_type(with_horizon(with_summaries(scored, ["normal"]).select(*names)), BASELINES.values())
