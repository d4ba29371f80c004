"""Regressions, ensembles of parameters and states, and the forecast models."""

from pyspark.sql import functions as F

from tarncast import fixtures as fx
from tarncast.catalog.registry import query
from tarncast.catalog.roles import (
    AR_XS,
    MET,
    RAIN,
    SITE_FRAME,
    ar_ctes,
    big,
    climatology_ctes,
    draw,
    fit_ctes,
    members_of,
    persistence_ctes,
    r,
    rs,
    with_,
    zkey,
)
from tarncast.operators import daily, records, regress
from tarncast.plans import baselines, common, neural, regressions


def calibration(spark, folder):
    return regressions.calibration_frame(fx.targets(spark, folder), fx.driver_history(spark, folder))


# --- regressions -----------------------------------------------------------------------------


@query(f"""select l_returnflag as site_id, cast(regr_count(l_extendedprice, l_quantity) as bigint) as n, {r('regr_slope(l_extendedprice, l_quantity)', 'slope')},
    {r('regr_intercept(l_extendedprice, l_quantity)', 'intercept', 4)}, {r('regr_r2(l_extendedprice, l_quantity)', 'r2')}
    from lineitem group by 1""")
def simple_ols(spark, folder):
    lines = fx.table(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("site_id"))
    out = lines.agg(*regress.simple_fit("l_extendedprice", "l_quantity"))
    return out.withColumn("intercept", F.round(F.col("intercept") + 1e-9, 4))


@query(with_("sensor", f"""select site_id, subset, {r('regr_slope(fdom, temp_c) / avg(fdom)', 'rho')} from (
    select *, 'all' as subset from sensor union all select *, 'cool' from sensor where temp_c > 10 and temp_c < 16
    union all select * exclude (row), 'rows' from (select *, row_number() over (partition by site_id, cast(datetime as date)
        order by datetime, event_id) as row from sensor) where row between 20 and 200) group by 1, 2"""))
def estimate_rho(spark, folder):
    from tarncast.operators.series import rows_between

    feed = fx.sensor(spark, folder)
    numbered = rows_between(feed.withColumn("day", F.to_date("datetime")), ["site_id", "day"], ["datetime", "event_id"], 20, 200)
    subsets = (
        feed.withColumn("subset", F.lit("all"))
        .unionByName(feed.filter("temp_c > 10 and temp_c < 16").withColumn("subset", F.lit("cool")))
        .unionByName(numbered.select(*feed.columns).withColumn("subset", F.lit("rows")))
    )
    return subsets.groupBy("site_id", "subset").agg((F.regr_slope("fdom", "temp_c") / F.avg("fdom")).alias("rho"))


@query(with_("sensor", f"""select site_id, count(*) as readings, {r('regr_slope(fdom, temp_c) / avg(fdom)', 'rho')} from (
    select *, row_number() over (partition by site_id order by datetime, event_id) as row from sensor) where row between 20 and 200 group by 1"""))
def estimate_rho_of_slice(spark, folder):
    """The temperature coefficient from rows 20 to 200 of each site's whole record."""
    rows = records.record_slice(fx.sensor(spark, folder), ["site_id"], ["datetime", "event_id"], 20, 200)
    return rows.groupBy("site_id").agg(F.count(F.lit(1)).alias("readings"), (F.regr_slope("fdom", "temp_c") / F.avg("fdom")).alias("rho"))


@query(with_("frame refs_day", f"""select site_id, reference_datetime, n, {r('slope')}, {r('intercept')}, {r('sigma')}
    from (select site_id, reference_datetime, cast(n as bigint) as n, slope, my - slope * mx as intercept,
          case when vy is not null then sqrt(greatest(vy - slope * cxy, 0)) end as sigma from (select * replace (case when n > 2 then slope end as slope, case when n > 2 then vy end as vy) from (
        select site_id, datetime as reference_datetime, count(x) over w as n, avg(x) over w as mx, avg(y) over w as my,
          covar_samp(x, y) over w as cxy, var_samp(x) over w as vx, var_samp(y) over w as vy,
          covar_samp(x, y) over w / var_samp(x) over w as slope from (
            select site_id, datetime, case when observation is not null then observation_lag1 end as x,
              case when observation_lag1 is not null then observation end as y from frame)
        window w as (partition by site_id order by datetime rows between unbounded preceding and 1 preceding))))"""))
def expanding_ols(spark, folder):
    fits = regressions.fits_for(calibration(spark, folder), fx.daily_refs(spark, folder), ["observation_lag1"])
    return fits.select(
        "site_id", "reference_datetime", "n", F.col("beta")[1].alias("slope"), F.col("beta")[0].alias("intercept"), "sigma"
    )


def coefficient_columns(k: int):
    return [F.col("beta")[j].alias(f"b{j}") for j in range(k + 1)] + [F.col("se")[j].alias(f"se{j}") for j in range(k + 1)]


def fit_columns(k: int) -> str:
    names = [f"b{j}" for j in range(k + 1)] + [f"se{j}" for j in range(k + 1)] + ["sigma"]
    return "site_id, reference_datetime, n, status, " + ", ".join(big(name, name, 6) for name in names)


@query(with_("frame refs_day", f"select {fit_columns(5)}, {r('r2')} from fit", fit_ctes(AR_XS)), large=True)
def multiple_ols(spark, folder):
    fits = regressions.fits_for(calibration(spark, folder), fx.daily_refs(spark, folder), regressions.AR_PREDICTORS)
    return fits.select("site_id", "reference_datetime", "n", "status", *coefficient_columns(5), "sigma", "r2")


@query(with_("frame refs_day", f"select {fit_columns(2)} from fit", fit_ctes(["observation_lag1", "shortwave"], days=30)), large=True)
def trailing_ols(spark, folder):
    fits = regressions.fits_for(
        calibration(spark, folder), fx.daily_refs(spark, folder), ["observation_lag1", "shortwave"], trailing_days=30
    )
    return fits.select("site_id", "reference_datetime", "n", "status", *coefficient_columns(2), "sigma")


COLLINEAR_XS = ["shortwave", "shortwave_twice", "rain"]


@query(with_("frame refs_day", f"select {fit_columns(3)}, rank from fit", [("twice", "select *, 2 * shortwave + 1 as shortwave_twice from frame")] + fit_ctes(COLLINEAR_XS, frame="twice")), large=True)
def collinear_ols(spark, folder):
    """One predictor repeats another: it has no coefficient and the fit goes on without it."""
    frame = calibration(spark, folder).withColumn("shortwave_twice", 2 * F.col("shortwave") + 1)
    fits = regressions.fits_for(frame, fx.daily_refs(spark, folder), COLLINEAR_XS)
    return fits.select("site_id", "reference_datetime", "n", "status", *coefficient_columns(3), "sigma", "rank")


@query(with_("frame", f"""select f.site_id, cast(count(*) as bigint) as n, {r('any_value(s.slope)', 'slope')}, {r('any_value(s.intercept)', 'intercept')},
    {r('any_value(s.r2)', 'r2')}, {r('avg(s.intercept + s.slope * f.shortwave - f.observation)', 'mean_error')},
    {r('sqrt(avg((s.intercept + s.slope * f.shortwave - f.observation) ^ 2))', 'rmse')}
    from frame f join (select site_id, regr_slope(observation, shortwave) as slope, regr_intercept(observation, shortwave) as intercept,
        regr_r2(observation, shortwave) as r2 from frame group by 1) s on s.site_id = f.site_id
    where f.observation is not null and f.shortwave is not null group by 1"""))
def fit_diagnostics(spark, folder):
    out = regressions.fit_diagnostics(calibration(spark, folder), ["site_id"], "observation", ["shortwave"])
    return out.select(
        "site_id", "n", F.col("beta")[1].alias("slope"), F.col("beta")[0].alias("intercept"), "r2", "mean_error", "rmse"
    )


@query(with_("frame", f"""select f.site_id, f.datetime, {r('s.intercept + s.slope * f.shortwave', 'fitted')},
    {r('s.intercept + s.slope * f.shortwave - f.observation', 'residual')}
    from frame f join (select site_id, regr_slope(observation, shortwave) as slope, regr_intercept(observation, shortwave) as intercept
        from frame group by 1) s on s.site_id = f.site_id
    where f.observation is not null and f.shortwave is not null"""))
def fitted_values(spark, folder):
    out = regressions.fitted_rows(calibration(spark, folder), ["site_id"], "observation", ["shortwave"])
    return out.select("site_id", "datetime", "fitted", "residual")


# --- draws -----------------------------------------------------------------------------------


MEMBER_ROWS = "(select f.*, cast(m.member as int) as member from fit f, (select unnest(range(1, 32)) as member) m)"


@query(with_("frame refs_day", f"""select x.site_id, x.reference_datetime, x.member, {big(draw(0).replace('f.', 'x.'), 'd0', 4)},
    {big(draw(1).replace('f.', 'x.'), 'd1', 4)} from {MEMBER_ROWS} x""", fit_ctes(["rain_10"])), digits=4, large=True)
def param_ensemble(spark, folder):
    fits = regressions.fits_for(
        calibration(spark, folder), fx.daily_refs(spark, folder), ["rain_10"]
    )
    out = common.param_ensemble(fits, 2)
    return out.select("site_id", "reference_datetime", "member", F.col("draw")[0].alias("d0"), F.col("draw")[1].alias("d1"))


@query(with_("targets", f"""select t.site_id, t.datetime as reference_datetime, cast(m.member as int) as member,
    {r('t.observation + 0.07 * ' + zkey('t.site_id', 't.datetime', 'm.member', chr(39) + 'ic' + chr(39)), 'state')}
    from targets t, (select unnest(range(1, 32)) as member) m"""))
def ic_ensemble(spark, folder):
    states = fx.targets(spark, folder).select("site_id", F.col("datetime").alias("reference_datetime"), "observation")
    return common.ic_ensemble(states, "observation").select("site_id", "reference_datetime", "member", "state")


# --- baselines -------------------------------------------------------------------------------


@query(with_("targets", f"""select site_id, cast(dayofyear(datetime) as int) as doy, {r('avg(observation)', 'clim_mean')},
    {r('stddev_samp(observation)', 'clim_sd')} from targets group by 1, 2"""))
def doy_statistics(spark, folder):
    return baselines.doy_statistics(fx.targets(spark, folder))


@query(with_("refs_day", f"select site_id, reference_datetime, datetime, {rs('mu sigma')} from climatology", climatology_ctes()))
def climatology(spark, folder):
    return baselines.climatology(fx.targets(spark, folder), fx.daily_refs(spark, folder))


@query(with_("refs_day", f"select site_id, reference_datetime, datetime, {rs('mu sigma')} from persistence", persistence_ctes()))
def persistence(spark, folder):
    return baselines.persistence(fx.targets(spark, folder), fx.daily_refs(spark, folder))


@query(with_("refs_day", f"select site_id, reference_datetime, datetime, {rs('mu sigma')} from persistence", persistence_ctes()))
def persistence_of_variable(spark, folder):
    """The same forecast from a table that also holds another variable and another depth."""
    own = fx.targets(spark, folder)
    other = own.withColumns({"variable": F.lit("other"), "observation": F.col("observation") * 10})
    deeper = own.withColumns({"depth_m": F.lit(9.0), "observation": F.col("observation") + 50})
    series = common.chosen_series(own.unionByName(other).unionByName(deeper), fx.VARIABLE, (1.5, 1.6, None))
    return baselines.persistence(series, fx.daily_refs(spark, folder))


PATHS = 200
BOOT_KEY = "concat_ws('|', w.site_id, w.reference_datetime, w.path, 'boot', w.step)"


@query(
    with_(
        "refs_month",
        f"""select site_id, reference_datetime, datetime, {r('avg(prediction)', 'mean', 4)}, {r('stddev_samp(prediction)', 'sd', 4)},
        count(*) as paths from (
          select w.site_id, w.reference_datetime, w.last_date + cast(w.step as int) as datetime,
            w.mu + sum(c.change) over (partition by w.site_id, w.reference_datetime, w.path order by w.step) as prediction
          from walks w join numbered c on c.site_id = w.site_id and c.pick = w.pick)
        where datetime > reference_datetime group by 1, 2, 3""",
        persistence_ctes("refs_month")
        + [
            (
                "numbered",
                """select site_id, row_number() over (partition by site_id order by datetime) as pick, change from changes
                where change is not null""",
            ),
            (
                "walks",
                f"""select *, floor((('0x' || substr(md5({BOOT_KEY}), 1, 8))::bigint + 0.5) / 4294967296.0 * changes) + 1 as pick
                from (select s.*, p.path, unnest(range(1, cast(reference_datetime - last_date + 35 as bigint))) as step
                      from state s, (select unnest(range(1, {PATHS + 1})) as path) p where changes > 0) w""",
            ),
        ],
    ),
    digits=4,
)
def persistence_bootstrap(spark, folder):
    paths = baselines.persistence_bootstrap(fx.targets(spark, folder), fx.monthly_refs(spark, folder), paths=PATHS)
    return paths.groupBy("site_id", "reference_datetime", "datetime").agg(
        F.avg("prediction").alias("mean"), F.stddev_samp("prediction").alias("sd"), F.count(F.lit(1)).alias("paths")
    )


# --- driver-based models ---------------------------------------------------------------------


def model_inputs(spark, folder):
    refs = fx.daily_refs(spark, folder)
    return (
        fx.targets(spark, folder),
        fx.driver_history(spark, folder),
        fx.weather(spark, folder, refs),
        fx.water_temperature(spark, folder, refs),
        refs,
    )


def by_case(forecast):
    """The members of each case: counted, known, lowest, the one in the middle, highest."""
    middle = F.max(F.when(F.col("parameter") == str(common.MEMBERS // 2 + 1), F.col("prediction")))
    return forecast.groupBy("site_id", "reference_datetime", "datetime").agg(
        F.count(F.lit(1)).alias("members"), F.count("prediction").alias("known"),
        F.min("prediction").alias("low"), middle.alias("middle"), F.max("prediction").alias("high"),
    )


@query(with_("frame drivers", members_of("met"), MET), digits=3, large=True)
def met_regression(spark, folder):
    targets, history, weather, _, refs = model_inputs(spark, folder)
    return by_case(regressions.met_regression(targets, history, weather, refs))


@query(with_("frame drivers", members_of("rain"), RAIN), digits=3, large=True)
def rain_lag(spark, folder):
    targets, history, weather, _, refs = model_inputs(spark, folder)
    return by_case(regressions.rain_lag(targets, history, weather, refs))


@query(with_("frame drivers", members_of("ar"), ar_ctes(True)), digits=3, large=True)
def ar_full(spark, folder):
    return by_case(regressions.ar_forecast(*model_inputs(spark, folder)))


@query(with_("frame drivers", members_of("ar"), ar_ctes(False)), digits=3, large=True)
def ar_driver_only(spark, folder):
    return by_case(regressions.ar_driver_only(*model_inputs(spark, folder)))


@query(with_("frame drivers", members_of("ar"), SITE_FRAME + ar_ctes(True, "site_frame")), digits=3, large=True)
def ar_site_history(spark, folder):
    """The autoregression on each site's own history, taken from the ensemble issued on every day."""
    targets, _, weather, water, refs = model_inputs(spark, folder)
    issued = fx.driver_ensemble(spark, folder, fx.daily_refs(spark, folder), horizon=0)
    history = daily.issue_day_history(issued, list(fx.DRIVER_NAMES.values())).withColumnsRenamed({v: k for k, v in fx.DRIVER_NAMES.items()})
    return by_case(regressions.ar_forecast(targets, history, weather, water, refs))


CHLA_XS = [*AR_XS, "chla_lag1"]


@query(with_("frame drivers", f"""select x.site_id, x.reference_datetime, x.datetime, cast(x.member as varchar) as parameter,
    {big(f'''{draw(0)} + {draw(1)} * (t.observation + 0.07 * {zkey('x.site_id', 'x.reference_datetime', 'x.member', chr(39) + 'ic' + chr(39))})
      + {draw(2)} * x.shortwave + {draw(3)} * x.rain + {draw(4)} * x.rain_lag1 + {draw(5)} * x.water_temp + {draw(6)} * c.chla
      + f.sigma * {zkey('x.site_id', 'x.reference_datetime', 'x.member', chr(39) + 'proc' + chr(39), 'x.horizon')}''', 'prediction')}
    from (select *, lag(rain) over (partition by site_id, reference_datetime, member order by horizon) as rain_lag1 from drivers) x
    join fit f on f.site_id = x.site_id and f.reference_datetime = x.reference_datetime
    left join targets t on t.site_id = x.site_id and t.datetime = x.reference_datetime
    left join chla c on c.site_id = x.site_id and c.datetime = x.reference_datetime
    where x.horizon = 1""",
    [("chla", """select o_orderpriority as site_id, cast(o_orderdate as date) as datetime, avg(o_custkey) / 100 as chla
        from orders group by 1, 2"""),
     ("chla_frame", """select f.*, lag(c.chla) over (partition by f.site_id order by f.datetime) as chla_lag1
        from frame f left join chla c on c.site_id = f.site_id and c.datetime = f.datetime""")]
    + fit_ctes(CHLA_XS, frame="chla_frame")), digits=3, large=True)
def ar_chlorophyll(spark, folder):
    targets, history, weather, water, refs = model_inputs(spark, folder)
    chla = (
        fx.table(spark, folder, "orders")
        .groupBy(F.col("o_orderpriority").alias("site_id"), F.to_date("o_orderdate").alias("datetime"))
        .agg((F.avg("o_custkey") / 100).alias("chla"))
    )
    return regressions.ar_next_day_with(targets, history, weather, water, refs, chla, "chla")


@query(with_("targets drivers", members_of("line"), [("line", """select d.site_id, d.reference_datetime, d.datetime, cast(d.member as varchar) as parameter,
    f.intercept + f.slope * (d.shortwave - 273.15) as prediction from drivers d join (
      select t.site_id, regr_slope(t.observation, h.shortwave - 273.15) as slope, regr_intercept(t.observation, h.shortwave - 273.15) as intercept
      from targets t join history h on h.datetime = t.datetime group by 1) f on f.site_id = d.site_id""")]), digits=3, large=True)
def linear_forecast(spark, folder):
    targets = fx.targets(spark, folder)
    history = fx.driver_history(spark, folder).select("datetime", (F.col("shortwave") - 273.15).alias("celsius"))
    future = fx.driver_ensemble(spark, folder, fx.daily_refs(spark, folder), ("shortwave",)).select(
        "site_id",
        "reference_datetime",
        "datetime",
        F.col("parameter").cast("string").alias("parameter"),
        (F.col("prediction") - 273.15).alias("celsius"),
    )
    out = regressions.linear_forecast(targets, history, future, "celsius", on=("datetime",))
    return by_case(out)


@query()
def neural_ar(spark, folder):
    """Every day an issue. Rows only: the network's training has no SQL twin."""
    out = neural.neural_ar(fx.targets(spark, folder), fx.daily_refs(spark, folder), flags=True)
    flags = out.groupBy("site_id", "reference_datetime").agg(F.max("order").alias("lags"), F.max("converged").alias("converged"))
    return by_case(out).join(flags, ["site_id", "reference_datetime"])

