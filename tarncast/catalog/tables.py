"""Error, skill, season, coverage and observation tables."""

from pyspark.sql import functions as F

from tarncast import fixtures as fx
from tarncast.catalog.registry import query
from tarncast.catalog.roles import (
    MODELS,
    climatology_ctes,
    normal_scores,
    persistence_ctes,
    r,
    rs,
    with_,
)
from tarncast.functions import seasons
from tarncast.operators import daily, grid
from tarncast.plans import baselines, evaluation, scoring

MEASURES_SQL = """sqrt(avg((mean - observation) ^ 2)) as rmse, avg(abs(mean - observation)) as mae, avg(crps) as crps, avg(sd) as sd"""
CHALLENGERS = ["Shifted", "Blend"]
MONTH_SEASON = """case when month(datetime) in (3, 4, 5) then 'Spring' when month(datetime) in (6, 7, 8) then 'Summer'
    when month(datetime) in (9, 10, 11) then 'Fall' else 'Winter' end"""
DOY_SEASON = """case when dayofyear(datetime) between 54 and 68 then 'Spring' when dayofyear(datetime) between 69 and 307 then 'Summer'
    when dayofyear(datetime) between 308 and 353 then 'Fall' else 'Winter' end"""


def sites_and_pooled(keys: str, measures: str, source: str = "scored") -> str:
    """Measures for each site and pooled, as two plain aggregations."""
    return f"""(select site_id, {keys}, {measures} from {source} group by site_id, {keys}
        union all select 'Across sites', {keys}, {measures} from {source} group by {keys})"""


def on_models(final: str) -> str:
    return with_("refs_day", final, MODELS)


# --- flagship --------------------------------------------------------------------------------

SENSOR_WALK = [
    ("targets", "select event_type as site_id, cast(ts as date) as datetime, avg(value) as observation from events group by 1, 2"),
    ("span", "select site_id, min(datetime) as first_day, max(datetime) as last_day from targets group by site_id"),
    ("refs_day", "select site_id, cast(unnest(generate_series(first_day, last_day, interval 1 day)) as date) as reference_datetime from span"),
]


@query(with_("", f"""select site_id, horizon, {rs('rmse mae crps sd')} from {sites_and_pooled('horizon', MEASURES_SQL)}""",
    SENSOR_WALK + persistence_ctes() + [
        ("rows_", """select p.*, t.observation, p.datetime - p.reference_datetime as horizon from persistence p
            left join targets t on t.site_id = p.site_id and t.datetime = p.datetime"""),
        ("scored", normal_scores("rows_")),
    ]))
def flagship(spark, folder):
    """Raw readings to scored persistence forecasts for every day, by horizon, per site and pooled."""
    means = daily.daily_mean(fx.sensor(spark, folder), ["fdom"]).withColumnRenamed("fdom", "observation")
    walk = baselines.persistence(means, grid.issue_dates(means))
    wide = walk.join(means, ["site_id", "datetime"], "left").withColumn("family", F.lit("normal"))
    scored = scoring.with_summaries(scoring.score_parametric(wide, ["normal"]), ["normal"])
    table = evaluation.per_site_and_pooled(evaluation.with_horizon(scored), ["horizon"], evaluation.measures())
    return table.select("site_id", F.col("horizon").cast("long").alias("horizon"), "rmse", "mae", "crps", "sd")


# --- error and skill -------------------------------------------------------------------------


def wide_horizon(df):
    return df.withColumn("horizon", F.col("horizon").cast("long"))


@query(on_models(f"""select site_id, model_id, horizon, {rs('rmse mae crps sd')} from {sites_and_pooled('model_id, horizon', MEASURES_SQL)}"""))
def rmse_by_horizon(spark, folder):
    return wide_horizon(evaluation.error_by_horizon(fx.scored_models(spark, folder)))


@query(on_models(f"""select site_id, model_id, horizon, measure, {r('value')} from (
    unpivot (select * from {sites_and_pooled('model_id, horizon', MEASURES_SQL)}) on rmse, mae, crps, sd into name measure value value)"""))
def metrics_long(spark, folder):
    table = wide_horizon(evaluation.error_by_horizon(fx.scored_models(spark, folder)))
    return evaluation.measures_long(table, ["site_id", "model_id", "horizon"])


def skill_cases() -> str:
    columns = ", ".join(f"max(case when model_id = '{m}' then crps end) as \"{m}\"" for m in fx.MODELS)
    return f"(select reference_datetime, datetime, horizon, site_id, {columns} from scored group by 1, 2, 3, 4)"


def skill_union(source: str) -> str:
    return " union all ".join(
        f"select site_id, horizon, '{m}' as model_id, \"{m}\" as skill from {source}" for m in CHALLENGERS
    )


def crps_skill_sql(baseline: str) -> str:
    ratios = ", ".join(f"avg(1 - \"{m}\" / nullif(\"{baseline}\", 0)) as \"{m}\"" for m in CHALLENGERS)
    return skill_union(sites_and_pooled("horizon", ratios, skill_cases()))


def rmse_skill_sql(baseline: str, keys: str = "", error: str = "sqrt(avg((mean - observation) ^ 2))") -> str:
    table = sites_and_pooled(f"model_id, horizon{keys}", f"{error} as rmse")
    models = ", ".join(f"max(case when model_id = '{m}' then rmse end) as \"{m}\"" for m in fx.MODELS)
    ratios = ", ".join(f"1 - \"{m}\" / nullif(\"{baseline}\", 0) as \"{m}\"" for m in CHALLENGERS)
    wide = f"(select site_id, horizon{keys}, {models} from {table} group by site_id, horizon{keys})"
    source = f"(select site_id, horizon{keys}, {ratios} from {wide})"
    return " union all ".join(
        f"select site_id, horizon{keys}, '{m}' as model_id, \"{m}\" as skill from {source}" for m in CHALLENGERS
    )


@query(on_models(f"select site_id, horizon, model_id, {r('skill')} from ({crps_skill_sql('Persistence')})"))
def crps_skill(spark, folder):
    return wide_horizon(evaluation.crps_skill(fx.scored_models(spark, folder), CHALLENGERS, "Persistence"))


@query(on_models(f"select site_id, horizon, model_id, {r('skill')} from ({rmse_skill_sql('DOY')})"))
def rmse_skill(spark, folder):
    return wide_horizon(evaluation.rmse_skill(fx.scored_models(spark, folder), CHALLENGERS, "DOY"))


@query(on_models(f"""select site_id, horizon, season, model_id, {r('skill')} from (
    {rmse_skill_sql('Persistence', ', season').replace('from scored', f'from (select *, {MONTH_SEASON} as season from scored)')})"""))
def seasonal_skill(spark, folder):
    scored = fx.scored_models(spark, folder).withColumn("season", seasons.season_by_month(F.col("datetime")))
    return wide_horizon(evaluation.rmse_skill(scored, CHALLENGERS, "Persistence", extra=["season"]))


def skill_table_sql() -> str:
    parts = []
    for baseline in fx.BASELINES.values():
        for metric, sql in (("crps", crps_skill_sql(baseline)), ("rmse", rmse_skill_sql(baseline))):
            parts.append(f"select site_id, horizon, model_id, '{metric}' as metric, '{baseline}' as null_model, skill from ({sql})")
    return " union all ".join(parts)


@query(on_models(f"select site_id, horizon, model_id, metric, null_model, {r('skill')} from ({skill_table_sql()})"))
def skill_table(spark, folder):
    scored = fx.scored_models(spark, folder)
    return wide_horizon(evaluation.skill_table(scored, CHALLENGERS, fx.BASELINES)).drop("label")


ROUNDED_RMSE = "round(sqrt(avg((mean - observation) ^ 2)), 2)"


@query(on_models(f"select site_id, horizon, model_id, {r('skill')} from ({rmse_skill_sql('Persistence', error=ROUNDED_RMSE)})"))
def rmse_skill_rounded(spark, folder):
    """Skill from errors rounded to two places, as published tables have it."""
    return wide_horizon(evaluation.rmse_skill(fx.scored_models(spark, folder), CHALLENGERS, "Persistence", digits=2))


def seasonal_sql(season: str) -> str:
    source = f"(select *, {season} as season from scored)"
    return sites_and_pooled("model_id, horizon, season", "sqrt(avg((mean - observation) ^ 2)) as rmse", source)


def seasonal(spark, folder, season):
    scored = fx.scored_models(spark, folder).withColumn("season", season)
    rows = scored.filter(F.col("season").isNotNull())
    return wide_horizon(
        evaluation.per_site_and_pooled(rows, ["model_id", "horizon", "season"], [evaluation.rmse().alias("rmse")])
    )


@query(on_models(f"select site_id, model_id, horizon, season, {r('rmse')} from {seasonal_sql(MONTH_SEASON)}"))
def seasonal_rmse(spark, folder):
    return seasonal(spark, folder, seasons.season_by_month(F.col("datetime")))


@query(on_models(f"select site_id, model_id, horizon, season, {r('rmse')} from {seasonal_sql(DOY_SEASON)}"))
def doy_season_rmse(spark, folder):
    return seasonal(spark, folder, seasons.season_by_doy(F.col("datetime")))


TWO_SEASON = "case when month(datetime) in (7, 8, 9) then 'Summer' when month(datetime) in (11, 12, 1) then 'Winter' end"


@query(on_models(f"select site_id, model_id, horizon, season, {r('rmse')} from {seasonal_sql(TWO_SEASON)} where season is not null"))
def two_season_rmse(spark, folder):
    return seasonal(spark, folder, seasons.stratified_or_mixed(F.col("datetime")))


@query(on_models(f"""select site_id, season, horizon, {r('avg(rmse)', 'rmse')} from {seasonal_sql(MONTH_SEASON)} group by 1, 2, 3"""))
def model_average_by_season(spark, folder):
    table = seasonal(spark, folder, seasons.season_by_month(F.col("datetime")))
    return evaluation.mean_over_models(table, ["site_id", "season", "horizon"])


@query(on_models(f"""select model_id, site_id, horizon, cast(sum(case when observation between quantile02_5 and quantile97_5 then 1 else 0 end) as bigint) as inside,
    count(observation + sd) as observed,
    {r('cast(sum(case when observation between quantile02_5 and quantile97_5 then 1 else 0 end) as double) / nullif(count(observation + sd), 0)', 'share')}
    from scored group by 1, 2, 3"""))
def coverage95(spark, folder):
    return wide_horizon(evaluation.coverage(fx.scored_models(spark, folder)))


@query(on_models(f"""select site_id, horizon, first(model_id order by rmse, model_id) as best_model, {r('min(rmse)', 'best')},
    first(model_id order by rmse desc, model_id) as worst_model, {r('max(rmse)', 'worst')}
    from {sites_and_pooled('model_id, horizon', MEASURES_SQL)} group by 1, 2"""))
def best_worst_model(spark, folder):
    table = evaluation.error_by_horizon(fx.scored_models(spark, folder))
    return wide_horizon(evaluation.best_and_worst(table, ["site_id", "horizon"]))


@query(on_models(f"""select site_id, model_id, {', '.join(r(f'max(case when horizon = {h} then rmse end)', f'h{h}') for h in (1, 7, 14, 28))}
    from {sites_and_pooled('model_id, horizon', MEASURES_SQL)} group by 1, 2"""))
def horizon_table(spark, folder):
    return evaluation.horizon_table(evaluation.error_by_horizon(fx.scored_models(spark, folder)))


@query(on_models(f"""select site_id, model_id, {r('min(rmse)', 'min')}, {r('median(rmse)', 'median')}, {r('avg(rmse)', 'mean')},
    {r('max(rmse)', 'max')}, {r('max(rmse) - min(rmse)', 'range')} from {sites_and_pooled('model_id, horizon', MEASURES_SQL)} group by 1, 2"""))
def metric_range_table(spark, folder):
    table = evaluation.error_by_horizon(fx.scored_models(spark, folder))
    return evaluation.spread_table(table, ["site_id", "model_id"], "rmse", digits=None)


@query(on_models(f"""select model_id, site_id, horizon, datetime, {rs('observation mean quantile02_5 quantile97_5')}
    from scored where horizon in (1, 16, 34)"""))
def fixed_horizon_series(spark, folder):
    return wide_horizon(evaluation.fixed_horizon_series(fx.scored_models(spark, folder)))


@query(on_models(f"""select model_id, horizon, {DOY_SEASON} as season, {r('avg(observation - mean)', 'bias')},
    {r('stddev_samp(mean)', 'prediction_sd')} from scored group by 1, 2, 3"""))
def bias_by_season(spark, folder):
    scored = fx.scored_models(spark, folder)
    return wide_horizon(evaluation.bias_by_season(scored, seasons.season_by_doy(F.col("datetime"))))


@query(on_models(f"""select site_id, datetime, count(*) as forecasts from scored where observation is null group by 1, 2"""))
def missing_obs(spark, folder):
    return evaluation.missing_observations(fx.scored_models(spark, folder))


@query(on_models("select site_id, reference_datetime, cast(max(datetime - reference_datetime) as int) as max_horizon from model_rows group by 1, 2"))
def max_horizon(spark, folder):
    return evaluation.longest_horizon(fx.model_forecasts(spark, folder))


@query(on_models(f"""select site_id, model_id, horizon, count(*) as n, {r('avg(crps - m)', 'deviation')} from (
    select *, avg(crps) over (partition by site_id, model_id) as m from scored) group by 1, 2, 3"""))
def deviation_from_model_mean(spark, folder):
    rows = evaluation.with_model_mean(fx.scored_models(spark, folder), ["site_id", "model_id"], "crps")
    return wide_horizon(
        rows.groupBy("site_id", "model_id", "horizon").agg(
            F.count(F.lit(1)).alias("n"), F.avg(F.col("crps") - F.col("mean_crps")).alias("deviation")
        )
    )


@query(on_models(f"""select site_id, model_id, horizon, {r('sqrt(avg((mean - observation) ^ 2))', 'rmse')} from scored
    where model_id = case when site_id in ('1-URGENT', '2-HIGH') then 'Persistence' else 'DOY' end group by 1, 2, 3"""))
def best_model_rows(spark, folder):
    choice = {"1-URGENT": "Persistence", "2-HIGH": "Persistence"}
    rows = evaluation.best_model_rows(fx.scored_models(spark, folder), choice, "DOY")
    return wide_horizon(rows.groupBy("site_id", "model_id", "horizon").agg(evaluation.rmse().alias("rmse")))


@query(on_models(f"""select model_id, site_id, reference_datetime, datetime, {r('case when datetime <= date ' + chr(39) + '1998-07-15' + chr(39) + ' then observation end', 'observation')},
    {r('mean')} from (
    select model_id, site_id, reference_datetime, datetime, observation, mean from scored where reference_datetime = date '1998-07-15'
    union all select distinct model_id, site_id, null, datetime, observation, null from scored
      where datetime between date '1998-07-15' - 7 and date '1998-07-15')"""))
def example_forecast(spark, folder):
    out = evaluation.example_forecast(fx.scored_models(spark, folder), "1998-07-15")
    return out.select("model_id", "site_id", "reference_datetime", "datetime", "observation", "mean")


# --- observations ----------------------------------------------------------------------------


@query(with_("targets", f"""select site_id, season, {rs('low mid average high sd')} from (
    select site_id, {MONTH_SEASON} as season, min(observation) as low, median(observation) as mid, avg(observation) as average,
    max(observation) as high, stddev_samp(observation) as sd from targets group by 1, 2)"""))
def period_summary(spark, folder):
    rows = fx.targets(spark, folder).withColumn("season", seasons.season_by_month(F.col("datetime")))
    out = evaluation.observation_summary(rows, ["site_id", "season"], digits=None)
    return out.select(
        "site_id", "season", F.col("min").alias("low"), F.col("median").alias("mid"),
        F.col("mean").alias("average"), F.col("max").alias("high"), "sd",
    )


@query(with_("targets", """select site_id, range_text, cv_percent from (select site_id, concat_ws(' - ', cast(lo as varchar), cast(hi as varchar)) as range_text,
    round(round(sd / m, 2) * 100, 0) as cv_percent from (select site_id, round(min(observation), 1) as lo, round(max(observation), 1) as hi,
    round(stddev_samp(observation), 1) as sd, round(avg(observation), 1) as m from targets group by 1))"""))
def variation_table(spark, folder):
    out = evaluation.observation_summary(fx.targets(spark, folder), ["site_id"])
    return out.select("site_id", "range_text", "cv_percent")
