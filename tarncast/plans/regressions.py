"""Regression forecasts: meteorology, rain sum, air temperature, and the recursive autoregression.

Every model fits on ``history`` (one row for each day and driver set, see ``issue_day_history``)
and runs on ``drivers``, the ensemble issued on each reference date. The reference date is a
column: one plan covers every issue date of every series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarncast.operators.grid import each_member
from tarncast.operators.regress import fit, fit_before, predict
from tarncast.operators.series import previous, rolling_sum, scaffold
from tarncast.plans.common import (
    INITIAL_SD,
    MEMBERS,
    SITE_REF,
    driver_rows,
    initial_draw,
    param_ensemble,
    process_noise,
)

DRIVER_COLUMNS = {
    "shortwave": "surface_downwelling_shortwave_flux_in_air",
    "rain": "precipitation_flux",
    "water_temp": "temperature",
}
TRAJECTORY = ["site_id", "reference_datetime", "member"]


def history_keys(history: DataFrame) -> list[str]:
    """A history of each site joins by site and day, one for all sites by day."""
    return [key for key in ("site_id", "datetime") if key in history.columns]


def calibration_frame(targets: DataFrame, history: DataFrame, start=None, on=None, by_row: bool = False) -> DataFrame:
    """Daily training rows: observation, its lag, drivers, lagged and 10-day rain.

    Lags are by calendar day; ``by_row`` makes them the previous recorded row instead, so a gap
    lets "yesterday" be an older day.
    """
    used = targets.select("site_id", "datetime", "observation")
    if start is not None:
        used = used.filter(F.col("datetime") >= F.lit(start).cast("date"))
    days = used if by_row else scaffold(used, ["site_id"], "observation")
    joined = days.join(history, list(on or history_keys(history)), "left")
    keys = ["site_id"]
    return joined.select(
        "*",
        previous("observation", keys).alias("observation_lag1"),
        previous("rain", keys).alias("rain_lag1"),
        rolling_sum("rain", keys, 10).alias("rain_10"),
    )


def fits_for(
    frame: DataFrame, refs: DataFrame, xs: list[str], trailing_days: int | None = None, min_rows: int | None = None
) -> DataFrame:
    """One fit for each (site, reference date); those of too few earlier rows have status ``short``."""
    return fit_before(frame, refs.select(*SITE_REF), ["site_id"], "observation", xs, trailing_days, min_rows)


def _with_draws(rows: DataFrame, fits: DataFrame, coefficients: int, members: int) -> DataFrame:
    """Rows of trajectories next to their member's coefficient draws and the fit's sigma."""
    draws = param_ensemble(fits, coefficients, members).select(*TRAJECTORY, "draw", "sigma")
    return rows.join(draws, TRAJECTORY)


def _members(df: DataFrame) -> DataFrame:
    return df.select(
        "site_id",
        "reference_datetime",
        "datetime",
        F.col("member").cast("string").alias("parameter"),
        "prediction",
    )


MET_PREDICTORS = ["shortwave", "rain", "rain_lag1"]


def met_regression(
    targets, history, drivers, refs, start=None, horizon: int = 35, members: int = MEMBERS, min_rows: int | None = None
) -> DataFrame:
    """Observation on shortwave, rain and yesterday's rain; no row on the day of issue, NULL predictions without a fit."""
    fits = fits_for(calibration_frame(targets, history, start), refs, MET_PREDICTORS, min_rows=min_rows)
    names = {k: DRIVER_COLUMNS[k] for k in ("shortwave", "rain")}
    path = W.partitionBy(*TRAJECTORY).orderBy("horizon")
    rows = driver_rows(drivers, names).withColumn(
        "rain_lag1", F.when(F.col("horizon") - F.lag("horizon").over(path) == 1, F.lag("rain").over(path))
    )
    value = predict(F.col("draw"), [F.col(x) for x in MET_PREDICTORS]) + process_noise(F.col("sigma"))
    ahead = rows.filter(F.col("horizon").between(1, horizon))
    return _members(_with_draws(ahead, fits, 4, members).withColumn("prediction", value))


def spliced_rain(history: DataFrame, rows: DataFrame, refs: DataFrame, members: int) -> DataFrame:
    """Each member's rain from ten days before issue on: recorded before, forecast from issue."""
    before = refs.select(*SITE_REF).withColumn("horizon", F.explode(F.sequence(F.lit(-10), F.lit(-1))))
    before = before.withColumn("datetime", F.expr("date_add(reference_datetime, horizon)"))
    on = history_keys(history)
    recorded = before.join(history.select(*on, "rain"), on, "left")
    columns = [*TRAJECTORY, "datetime", "horizon", "rain"]
    return each_member(recorded, members).select(*columns).unionByName(rows.select(*columns))


def rain_lag(
    targets, history, drivers, refs, start=None, horizon: int = 35, members: int = MEMBERS, min_rows: int | None = None
) -> DataFrame:
    """Observation on the rain of the last ten days, across the issue date; NULL predictions without a fit."""
    fits = fits_for(calibration_frame(targets, history, start), refs, ["rain_10"], min_rows=min_rows)
    rows = driver_rows(drivers, {"rain": DRIVER_COLUMNS["rain"]})
    window = W.partitionBy(*TRAJECTORY).orderBy("horizon").rangeBetween(-9, 0)
    summed = spliced_rain(history, rows, refs, members).withColumn(
        "rain_10", F.when(F.count("rain").over(window) == 10, F.sum("rain").over(window))
    )
    value = predict(F.col("draw"), [F.col("rain_10")]) + process_noise(F.col("sigma"))
    ahead = summed.filter(F.col("horizon").between(1, horizon))
    return _members(_with_draws(ahead, fits, 2, members).withColumn("prediction", value))


AR_PREDICTORS = ["observation_lag1", "shortwave", "rain", "rain_lag1", "water_temp"]
ALL_UNCERTAINTY = frozenset({"driver", "parameter", "process", "initial"})


def ar_forecast(
    targets: DataFrame,
    history: DataFrame,
    drivers: DataFrame,
    water_temp: DataFrame | None,
    refs: DataFrame,
    start=None,
    horizon: int = 34,
    initial_sd: float = INITIAL_SD,
    uncertainty=ALL_UNCERTAINTY,
    members: int = MEMBERS,
    min_rows: int | None = None,
) -> DataFrame:
    """Recursive autoregression: one row for each member and day, the day of issue included.

    y[h] = b0 + b1 y[h-1] + b2 shortwave[h] + b3 rain[h] + b4 rain[h-1] + b5 water temperature[h]
    + noise. Each trajectory becomes one row holding its drivers in date order (at most
    ``horizon + 1`` of them, by construction) and a fold over that array walks the recursion, so
    dates, sites and members all run in parallel. A missing driver day makes the rest NULL. An issue
    without a fit, or without an observation on its day, keeps its rows with NULL predictions.
    """
    fits = fits_for(calibration_frame(targets, history, start), refs, AR_PREDICTORS, min_rows=min_rows)
    extra = [water_temp] if water_temp is not None else []
    rows = driver_rows(drivers, DRIVER_COLUMNS, *extra).filter(F.col("horizon").between(0, horizon))
    step = F.struct(
        "horizon", "shortwave", "rain", "water_temp", process_noise(F.lit(1.0)).alias("noise")
    )
    paths = rows.groupBy(*TRAJECTORY).agg(F.sort_array(F.collect_list(step)).alias("found"))
    initial = targets.select("site_id", F.col("datetime").alias("reference_datetime"), "observation")
    by_day = F.map_from_entries(F.transform("found", lambda s: F.struct(s["horizon"], s)))
    complete = F.size("found") == horizon + 1
    filled = F.transform(F.sequence(F.lit(0), F.lit(horizon)), lambda h: F.try_element_at(by_day, h))
    state = initial_draw(F.col("observation"), initial_sd) if "initial" in uncertainty else F.col("observation")
    noise_scale = F.col("sigma") if "process" in uncertainty else F.lit(0.0)
    if "parameter" in uncertainty:
        drawn = _with_draws(paths, fits, 6, members)
    else:
        fixed = F.transform("beta", lambda b: F.coalesce(b, F.lit(0.0))).alias("draw")
        drawn = paths.join(fits.select(*SITE_REF, fixed, "sigma"), SITE_REF)
    ready = (
        drawn.join(initial, SITE_REF, "left")
        .withColumn("steps", F.when(complete, F.col("found")).otherwise(filled))
        .withColumn("state", state)
        .withColumn("scale", noise_scale)
        .select(*TRAJECTORY, "steps", "draw", "state", "scale")
    )

    def b(j):
        return F.element_at("draw", j + 1)

    def advance(track: Column, h: Column) -> Column:
        today, yesterday = F.element_at("steps", h + 1), F.element_at("steps", h)
        forced = (
            b(0)
            + b(2) * today["shortwave"]
            + b(3) * today["rain"]
            + b(4) * yesterday["rain"]
            + b(5) * today["water_temp"]
            + F.col("scale") * today["noise"]
        )
        return F.concat(track, F.array(forced + b(1) * F.element_at(track, -1)))

    track = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.array("state"), advance)
    walked = ready.select(*TRAJECTORY, F.posexplode(track).alias("horizon", "prediction"))
    return _members(walked.withColumn("datetime", F.expr("date_add(reference_datetime, horizon)")))


def ar_driver_only(targets, history, drivers, water_temp, refs, start=None, horizon: int = 34, min_rows=None) -> DataFrame:
    """The autoregression with fixed coefficients and state: members differ by their drivers only."""
    return ar_forecast(
        targets, history, drivers, water_temp, refs, start, horizon, uncertainty=frozenset({"driver"}), min_rows=min_rows
    )


def ar_next_day_with(
    targets: DataFrame, history: DataFrame, drivers: DataFrame, water_temp, refs, extra: DataFrame, name: str,
    start=None, initial_sd: float = INITIAL_SD, members: int = MEMBERS, min_rows: int | None = None,
) -> DataFrame:
    """Autoregression with one more lagged daily variable, for the first day ahead only.

    ``extra`` holds (site_id, datetime, ``name``). Its value is known on the day of issue and not
    after, which is why the forecast stops at one day. A value that is missing makes the prediction NULL.
    """
    lagged = f"{name}_lag1"
    frame = calibration_frame(targets, history, start).join(extra, ["site_id", "datetime"], "left")
    frame = frame.withColumn(lagged, previous(name, ["site_id"]))
    fits = fits_for(frame, refs, [*AR_PREDICTORS, lagged], min_rows=min_rows)
    more = [water_temp] if water_temp is not None else []
    path = W.partitionBy(*TRAJECTORY).orderBy("horizon")
    rows = (
        driver_rows(drivers, DRIVER_COLUMNS, *more)
        .filter(F.col("horizon").between(0, 1))
        .withColumn("rain_lag1", F.lag("rain").over(path))
        .filter(F.col("horizon") == 1)
    )
    state = targets.select("site_id", F.col("datetime").alias("reference_datetime"), "observation")
    seen = extra.select("site_id", F.col("datetime").alias("reference_datetime"), F.col(name).alias(lagged))
    terms = ["start_value", "shortwave", "rain", "rain_lag1", "water_temp", lagged]
    value = predict(F.col("draw"), [F.col(t) for t in terms]) + process_noise(F.col("sigma"))
    ready = (
        _with_draws(rows, fits, 7, members)
        .join(state, SITE_REF, "left")
        .join(seen, SITE_REF, "left")
        .withColumn("start_value", initial_draw(F.col("observation"), initial_sd))
    )
    return _members(ready.withColumn("prediction", value))


def linear_forecast(
    targets: DataFrame, history: DataFrame, future: DataFrame, x: str, keys=("site_id",), on=("site_id", "datetime")
) -> DataFrame:
    """Plain line from one driver: ``future`` rows with a prediction."""
    frame = targets.join(history, list(on))
    fitted = fit(frame, list(keys), "observation", [x]).select(*keys, "beta")
    return future.join(fitted, list(keys)).withColumn("prediction", predict(F.col("beta"), [F.col(x)]))


def fitted_rows(frame: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    """Training rows next to their fitted value and residual."""
    fitted = fit(frame, keys, y, xs).select(*keys, "beta")
    complete = frame.dropna(subset=[y, *xs])
    return (
        complete.join(fitted, keys)
        .withColumn("fitted", predict(F.col("beta"), [F.col(x) for x in xs]))
        .withColumn("residual", F.col("fitted") - F.col(y))
        .drop("beta")
    )


def fit_diagnostics(frame: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    """Coefficients, R2, mean error and RMSE of one fit for each group."""
    summary = fit(frame, keys, y, xs)
    errors = (
        fitted_rows(frame, keys, y, xs)
        .groupBy(*keys)
        .agg(
            F.avg("residual").alias("mean_error"),
            F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rmse"),
        )
    )
    return summary.join(errors, keys)
