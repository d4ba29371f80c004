"""Pieces the forecast models share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarncast.functions.noise import draw_key, standard_normal
from tarncast.operators.grid import each_member, spread
from tarncast.operators.lookup import in_or_null, in_strict

# Members of an ensemble, days ahead, and the detection limit of the sensor.
MEMBERS = 31
HORIZON = 35
INITIAL_SD = 0.07
SITE_REF = ["site_id", "reference_datetime"]


def chosen_series(targets: DataFrame, variable: str | None = None, depths=None) -> DataFrame:
    """The targets of one variable and of some depths (None among them for a missing one), one row for each site and day.

    Models key by site: without a choice, several variables or depths of a table would be mixed. Repeats are averaged.
    """
    if variable is not None and "variable" in targets.columns:
        targets = targets.filter(F.col("variable") == variable)
    if depths is not None and "depth_m" in targets.columns:
        known = [d for d in depths if d is not None]
        targets = targets.filter(in_or_null(F.col("depth_m"), known) if None in depths else in_strict(F.col("depth_m"), known))
    kept = [c for c in targets.columns if c not in ("observation", "site_id", "datetime", "depth_m")]
    depth = [F.max("depth_m").alias("depth_m")] if "depth_m" in targets.columns else []
    return targets.groupBy("site_id", "datetime", *kept).agg(F.avg("observation").alias("observation"), *depth)


def standard_format(
    df: DataFrame,
    model_id: str,
    family: str,
    variable: str,
    depth: Column | None = None,
    duration: str = "P1D",
    project_id: str | None = None,
) -> DataFrame:
    """The shared forecast table; ``df`` brings datetime, reference_datetime, site_id, parameter, prediction."""
    if depth is None:
        depth = F.col("depth_m") if "depth_m" in df.columns else F.lit(None)
    return df.select(
        "datetime",
        "reference_datetime",
        F.lit(model_id).alias("model_id"),
        "site_id",
        F.col("parameter").cast("string").alias("parameter"),
        F.lit(family).alias("family"),
        F.col("prediction").cast("double").alias("prediction"),
        F.lit(variable).alias("variable"),
        depth.cast("double").alias("depth_m"),
        F.lit(duration).alias("duration"),
        F.lit(project_id).cast("string").alias("project_id"),
    )


def mu_sigma_rows(df: DataFrame) -> DataFrame:
    """One row for each parameter of a normal forecast."""
    pairs = F.array(
        F.struct(F.lit("mu").alias("parameter"), F.col("mu").alias("prediction")),
        F.struct(F.lit("sigma").alias("parameter"), F.col("sigma").alias("prediction")),
    )
    return df.withColumn("pair", F.explode(pairs)).select(
        *[c for c in df.columns if c not in ("mu", "sigma")], "pair.parameter", "pair.prediction"
    )


def default_depth(site: Column, focal: dict[str, float], otherwise: float | None = None) -> Column:
    """Depth of a site's focal sensor, from a small lookup of site to depth."""
    out = None
    for name, depth in focal.items():
        out = F.when(site == name, depth) if out is None else out.when(site == name, depth)
    return out.otherwise(otherwise) if out is not None else F.lit(otherwise)


def param_draw(j: int, site="site_id", ref="reference_datetime", member="member", seed="p") -> Column:
    """One draw of coefficient ``j``: independent normals around the estimate with its standard error, 0 where it was passed over, NULL without a fit."""
    noise = standard_normal(draw_key(F.col(site), F.col(ref), F.col(member), F.lit(f"{seed}{j}")))
    drawn = F.element_at("beta", j + 1) + F.element_at("se", j + 1) * noise
    return F.when(F.col("beta").isNotNull(), F.coalesce(drawn, F.lit(0.0)))


def param_ensemble(fits: DataFrame, coefficients: int, members: int = MEMBERS) -> DataFrame:
    """Coefficient draws: one row for each fit and member, an array in coefficient order."""
    return each_member(spread(fits, *SITE_REF), members).withColumn(
        "draw", F.array(*[param_draw(j) for j in range(coefficients)])
    )


def initial_draw(value: Column, sd: float = INITIAL_SD) -> Column:
    """Draw of the state on the reference date around its observation."""
    key = draw_key(F.col("site_id"), F.col("reference_datetime"), F.col("member"), F.lit("ic"))
    return value + sd * standard_normal(key)


def ic_ensemble(initial: DataFrame, value: str, members: int = MEMBERS, sd: float = INITIAL_SD) -> DataFrame:
    """Initial-condition ensemble from one observation for each (site, reference date)."""
    return each_member(initial, members).withColumn("state", initial_draw(F.col(value), sd))


def process_noise(sigma: Column) -> Column:
    """Draw of the process error of one member on one day."""
    key = draw_key(
        F.col("site_id"), F.col("reference_datetime"), F.col("member"), F.lit("proc"), F.col("horizon")
    )
    return sigma * standard_normal(key)


def driver_rows(drivers: DataFrame, variables: dict[str, str], *extra: DataFrame) -> DataFrame:
    """Driver ensemble, one row for each (site, reference date, member, day), one column a driver.

    ``variables`` maps output columns to variable names. Members are numbered from 1 whatever
    the source starts from. The rows are clustered by (site, reference date, member), which
    every later step of a model keeps.
    """
    rows = drivers
    for df in extra:
        rows = rows.unionByName(df, allowMissingColumns=True)
    values = [
        F.avg(F.when(F.col("variable") == name, F.col("prediction"))).alias(out)
        for out, name in variables.items()
    ]
    wanted = (
        rows.filter(F.col("variable").isin(*variables.values()))
        .withColumn("member", F.col("parameter").cast("int"))
        .withColumn("horizon", F.datediff("datetime", "reference_datetime"))
    )
    return (
        spread(wanted, "site_id", "reference_datetime", "member")
        .groupBy("site_id", "reference_datetime", "member", "datetime", "horizon")
        .agg(*values)
    )


def number_members_from_one(drivers: DataFrame, first: int) -> DataFrame:
    """Members of a source that counts from ``first`` renumbered from 1."""
    return drivers.withColumn("parameter", F.col("parameter").cast("int") + (1 - first))
