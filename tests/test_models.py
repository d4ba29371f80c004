import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarncast.operators import grid, lookup, series
from tarncast.plans import baselines, neural, regressions

DAY = dt.date(2023, 1, 1)


def on(i):
    return DAY + dt.timedelta(days=i)


def targets_from(spark, values):
    """{site: {day offset: value}} as a daily table."""
    rows = [(s, on(i), None if v is None else float(v)) for s, days in values.items() for i, v in days.items()]
    return spark.createDataFrame(rows, "site_id string, datetime date, observation double")


def refs_at(spark, pairs):
    return spark.createDataFrame([(s, on(i)) for s, i in pairs], "site_id string, reference_datetime date")


# --- baselines -------------------------------------------------------------------------------


def test_persistence_walk_starts_at_the_last_known_value(spark):
    obs = targets_from(spark, {"a": {0: 1, 1: 3, 2: 2, 5: 10, 6: 11, 9: 99}, "b": {0: 7}})
    got = baselines.persistence(obs, refs_at(spark, [("a", 9), ("b", 5), ("b", 0)]), horizon=4).collect()
    a = sorted((r["datetime"], r["mu"], r["sigma"]) for r in got if r["site_id"] == "a")
    assert [d for d, _, _ in a] == [on(10), on(11), on(12)]
    assert {m for _, m, _ in a} == {11.0}
    variance = np.mean([4, 1, 1])  # changes across gaps do not count
    assert [s for _, _, s in a] == pytest.approx([math.sqrt(variance * k) for k in (4, 5, 6)])
    b = [r for r in got if r["site_id"] == "b"]
    assert len(b) == 3 and all(r["sigma"] is None and r["reference_datetime"] == on(5) for r in b)


def test_bootstrap_paths_resample_earlier_changes(spark):
    obs = targets_from(spark, {"a": {i: v for i, v in enumerate([0, 1, 3, 2, 2, 900])}})
    paths = baselines.persistence_bootstrap(obs, refs_at(spark, [("a", 5)]), horizon=6, paths=40)
    rows = paths.collect()
    assert len(rows) == 40 * 5 and {r["datetime"] for r in rows} == {on(i) for i in range(6, 11)}
    first = {r["prediction"] for r in rows if r["datetime"] == on(6)}
    steps = {1.0, 2.0, -1.0, 0.0}
    assert first <= {2 + a + b for a in steps for b in steps} and len(first) > 3
    assert {r["parameter"] for r in rows} == {str(i) for i in range(1, 41)}


def test_climatology_uses_earlier_years_only(spark):
    days = {}
    for year, value in ((0, 10), (365, 20), (730, 60)):  # 2023, 2024, 2025 (2024 is a leap year)
        for i in range(0, 60):
            days[year + i + (1 if year == 730 else 0)] = value + i
    obs = targets_from(spark, {"a": days})
    refs = refs_at(spark, [("a", 731 + 3)])  # 2025-01-04
    got = {r["datetime"]: r for r in baselines.climatology(obs, refs, horizon=10).collect()}
    assert len(got) == 10
    for i in range(4, 14):
        assert got[on(731 + i)]["mu"] == pytest.approx(15 + i)
    # The first days of 2025 are before the issue date, the forecast days are not.
    assert {round(r["sigma"], 9) for r in got.values()} == {round(math.sqrt(50), 9)}


def test_climatology_needs_three_days(spark):
    obs = targets_from(spark, {"a": {i: 1 for i in (1, 2, 366, 367)}})
    assert baselines.climatology(obs, refs_at(spark, [("a", 365)]), horizon=10).count() == 0
    assert baselines.climatology(obs, refs_at(spark, [("a", 365)]), horizon=10, min_dates=1).count() == 2
    full = {i: i for i in range(40)}
    issued = baselines.climatology(targets_from(spark, {"a": full}), refs_at(spark, [("a", 365)]), 10, inclusive_end=True)
    assert issued.count() == 11


# --- driver models ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def world(spark):
    """Two sites, 120 days of drivers and observations, two issues of a three-member ensemble."""
    rng = np.random.default_rng(11)
    n, horizon = 120, 12
    sw, rain, temp = rng.normal(200, 30, n + 40), rng.gamma(1, 2, n + 40), rng.normal(12, 3, n + 40)
    obs = {}
    for s, b in (("a", 0.5), ("b", 0.8)):
        y = [10.0]
        for i in range(1, n):
            y.append(1 + b * y[-1] + 0.01 * sw[i] + 0.2 * rain[i] + 0.1 * rain[i - 1] + 0.05 * temp[i] + rng.normal(0, 0.3))
        obs[s] = dict(enumerate(y))
    history = spark.createDataFrame(
        [(on(i), float(rain[i]), float(sw[i]), float(temp[i])) for i in range(n)],
        "datetime date, rain double, shortwave double, water_temp double",
    )
    issues = [("a", 100), ("b", 110)]
    rows = []
    for s, ref in issues:
        for m in (1, 2, 3):
            for h in range(0, horizon + 1):
                for name, values in zip(
                    ("surface_downwelling_shortwave_flux_in_air", "precipitation_flux", "temperature"), (sw, rain, temp)
                ):
                    rows.append((s, on(ref), on(ref + h), name, m, float(values[ref + h] + 0.1 * m * h)))
    drivers = spark.createDataFrame(
        rows, "site_id string, reference_datetime date, datetime date, variable string, parameter int, prediction double"
    ).cache()
    return {
        "targets": targets_from(spark, obs), "history": history.cache(), "drivers": drivers, "refs": refs_at(spark, issues),
        "obs": obs, "arrays": (sw, rain, temp), "issues": issues, "horizon": horizon,
    }


def driver_value(rows, s, ref, m, name, h):
    return rows[s, on(ref), m, name, on(ref + h)]


def as_dict(df):
    return {(r["site_id"], r["reference_datetime"], r["datetime"], r["parameter"]): r["prediction"] for r in df.collect()}


def test_recursion_matches_a_plain_loop(spark, world):
    got = as_dict(
        regressions.ar_driver_only(
            world["targets"], world["history"], world["drivers"], None, world["refs"], horizon=world["horizon"]
        )
    )
    sw, rain, temp = world["arrays"]
    drivers = {
        (r["site_id"], r["reference_datetime"], r["parameter"], r["variable"], r["datetime"]): r["prediction"]
        for r in world["drivers"].collect()
    }
    for s, ref in world["issues"]:
        y = np.array([world["obs"][s][i] for i in range(ref)])
        x = np.column_stack([np.ones(ref - 1), y[:-1], sw[1:ref], rain[1:ref], rain[: ref - 1], temp[1:ref]])
        b = np.linalg.lstsq(x, y[1:], rcond=None)[0]
        for m in (1, 2, 3):
            state = world["obs"][s][ref]
            assert got[s, on(ref), on(ref), str(m)] == pytest.approx(state)

            def d(name, h):
                return driver_value(drivers, s, ref, m, name, h)

            for h in range(1, world["horizon"] + 1):
                state = (
                    b[0] + b[1] * state + b[2] * d("surface_downwelling_shortwave_flux_in_air", h)
                    + b[3] * d("precipitation_flux", h) + b[4] * d("precipitation_flux", h - 1) + b[5] * d("temperature", h)
                )
                assert got[s, on(ref), on(ref + h), str(m)] == pytest.approx(state, rel=1e-9)


def test_missing_driver_day_stops_the_trajectory(spark, world):
    gap = world["drivers"].filter(~((F.col("parameter") == 2) & (F.datediff("datetime", "reference_datetime") == 5)))
    out = regressions.ar_forecast(world["targets"], world["history"], gap, None, world["refs"], horizon=world["horizon"])
    rows = out.withColumn("h", F.datediff("datetime", "reference_datetime")).collect()
    assert len(rows) == 2 * 3 * 13
    for r in rows:
        assert (r["prediction"] is None) == (r["parameter"] == "2" and r["h"] >= 5)


def test_forecasts_do_not_depend_on_partitioning(spark, world):
    def run():
        return as_dict(
            regressions.ar_forecast(world["targets"], world["history"], world["drivers"], None, world["refs"], horizon=12)
        )

    first = run()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        second = run()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert first.keys() == second.keys()
    assert all(second[k] == pytest.approx(v, rel=1e-9) for k, v in first.items())


def test_no_issue_is_left_out(spark, world):
    """Issues without a fit, or without an observation on their day, keep every row of every member."""
    refs = refs_at(spark, [("a", 100), ("b", 110)])
    early = world["targets"].filter("site_id <> 'a' or datetime < '" + str(on(4)) + "'")
    late = world["targets"].filter(F.col("datetime") != on(110))
    for targets, empty in ((early, "a"), (late, "b")):
        out = regressions.ar_forecast(targets, world["history"], world["drivers"], None, refs, horizon=12, members=3)
        counts = {r["site_id"]: (r["rows"], r["known"]) for r in out.groupBy("site_id").agg(F.count("*").alias("rows"), F.count("prediction").alias("known")).collect()}
        assert counts[empty] == (39, 0) and counts[{"a": "b", "b": "a"}[empty]] == (39, 39)
    for out in (regressions.met_regression(early, world["history"], world["drivers"], refs, horizon=12, members=3), regressions.rain_lag(early, world["history"], world["drivers"], refs, horizon=12, members=3)):
        assert out.filter("site_id = 'a' and prediction is null").count() == 36 and out.filter("site_id = 'b' and prediction is not null").count() == 36


def test_rain_lag_sums_across_the_issue_date(spark, world):
    rows = regressions.driver_rows(world["drivers"], {"rain": "precipitation_flux"})
    spliced = regressions.spliced_rain(world["history"], rows, world["refs"], 3).collect()
    sw, rain, temp = world["arrays"]
    one = {r["horizon"]: r["rain"] for r in spliced if r["site_id"] == "a" and r["member"] == 2}
    assert sorted(one) == list(range(-10, 13))
    assert one[-10] == pytest.approx(rain[90]) and one[0] == pytest.approx(rain[100]) and one[4] == pytest.approx(rain[104] + 0.8)
    out = as_dict(regressions.rain_lag(world["targets"], world["history"], world["drivers"], world["refs"], horizon=12, members=3))
    assert len(out) == 2 * 3 * 12 and all(v is not None for v in out.values())


def test_met_regression_has_no_value_on_the_issue_day(spark, world):
    out = regressions.met_regression(world["targets"], world["history"], world["drivers"], world["refs"], horizon=12)
    days = [r["datetime"] for r in out.filter("site_id = 'a'").collect()]
    assert min(days) == on(101) and len(days) == 36


def test_calibration_lag_by_day_or_by_row(spark, world):
    gappy = world["targets"].filter("site_id = 'a'").filter((F.col("datetime") != on(50)))
    by_day = regressions.calibration_frame(gappy, world["history"]).filter(F.col("datetime") == on(51)).first()
    by_row = regressions.calibration_frame(gappy, world["history"], by_row=True).filter(F.col("datetime") == on(51)).first()
    assert by_day["observation_lag1"] is None
    assert by_row["observation_lag1"] == pytest.approx(world["obs"]["a"][49])


def test_calibration_start(spark, world):
    frame = regressions.calibration_frame(world["targets"], world["history"], start=str(on(30)))
    assert frame.agg(F.min("datetime")).first()[0] == on(30)
    first = frame.filter(F.col("datetime") == on(30)).first()
    assert first["observation_lag1"] is None


def test_neural_paths(spark, world):
    refs = refs_at(spark, [("a", 100), ("b", 110), ("a", 10)])
    out = neural.neural_ar(world["targets"], refs, horizon=5, members=8, networks=2)
    rows = out.collect()
    assert {(r["site_id"], r["reference_datetime"]) for r in rows} == {("a", on(100)), ("b", on(110)), ("a", on(10))}
    assert len(rows) == 3 * 8 * 6
    short = [r["prediction"] for r in rows if r["reference_datetime"] == on(10)]
    assert all(p is None for p in short) or all(p is not None for p in short)
    values = [r["prediction"] for r in rows if r["site_id"] == "a" and r["reference_datetime"] == on(100)]
    seen = list(world["obs"]["a"].values())
    assert min(seen) - 5 < np.median(values) < max(seen) + 5
    later = targets_from(spark, {s: {i: v if i <= 100 else 1e6 for i, v in d.items()} for s, d in world["obs"].items()})
    again = neural.neural_ar(later, refs_at(spark, [("a", 100)]), horizon=5, members=8, networks=2).collect()
    assert sorted(r["prediction"] for r in again) == pytest.approx(sorted(values))


def test_a_singular_system_is_a_rejected_step():
    """Training on constant lags meets singular systems and must end."""
    steps = neural._solve(np.stack([np.zeros((3, 3)), np.eye(3)]), np.ones((2, 3)))
    assert np.isnan(steps[0]).all() and steps[1].tolist() == [1, 1, 1]
    x, y = np.ones((2, 4, 20)), np.zeros((2, 20))
    weights, _ = neural.train(x, y, np.ones((2, 20), dtype=bool), np.random.default_rng(0).uniform(-0.7, 0.7, (2, 19)), 3, rounds=200)
    assert np.isfinite(weights).all()


def record(n, seed=3):
    """An autoregression of order two around 10."""
    rng, y = np.random.default_rng(seed), [0.0, 0.0]
    for _ in range(n + 50):
        y.append(1.1 * y[-1] - 0.5 * y[-2] + rng.normal(0, 0.1))
    return 10 * np.exp(np.array(y[-n:]))


@pytest.mark.parametrize("lags", [None, (1, 2, 3, 7)])
def test_networks_do_not_depend_on_what_they_are_trained_beside(lags):
    def issues():
        return [neural.Issue(record(300)[:n], n, lags, 10) for n in (12, 60, 150, 151, 152, 180, 299, 300)]

    alone, together = ([one.paths(w, 20, 9) for one, (w, _) in zip(own, neural.train_issues(own, 3, cells), strict=True)] for cells, own in ((1, issues()), (1 << 22, issues())))
    assert all((a == b).all() and np.isfinite(a).all() for a, b in zip(alone, together, strict=True))
    mixed = issues()[::-1]
    again = [one.paths(w, 20, 9) for one, (w, _) in zip(mixed, neural.train_issues(mixed, 3), strict=True)][::-1]
    assert all((a == b).all() for a, b in zip(alone, again, strict=True))


def test_training_fits_and_says_whether_it_converged():
    one = neural.Issue(record(400), 1, None, 10)
    (weights, converged), = neural.train_issues([one], 4)
    x, y = neural.lag_matrix(one.y, one.lags), one.y[max(one.lags) :]
    lines = np.column_stack([np.ones(len(y)), x])
    linear = ((y - lines @ np.linalg.lstsq(lines, y, rcond=None)[0]) ** 2).sum()
    losses = [((neural._forward(x.T[None], w[None], one.hidden)[1][0] - y) ** 2).sum() for w in weights]
    assert converged == 4 and max(losses) < 1.05 * linear
    start = neural.Issue(record(400), 1, None, 10).starts(1)
    _, done = neural.train(x.T[None], y[None], np.ones((1, len(y)), dtype=bool), start, one.hidden, rounds=1)
    assert not done.any()


def test_gradient_of_the_network_by_differences():
    """One damped step is the solution of the system built from numerical derivatives."""
    rng = np.random.default_rng(2)
    x, w, hidden = rng.normal(size=(1, 2, 30)), rng.uniform(-0.7, 0.7, (1, 13)), 3
    y = neural._forward(x, w + rng.normal(0, 0.02, (1, 13)), hidden)[1]  # near enough for the first step to be taken
    base = neural._forward(x, w, hidden)[1][0]
    slopes = np.column_stack([(neural._forward(x, w + 1e-6 * np.eye(13)[at], hidden)[1][0] - base) / 1e-6 for at in range(13)])
    square, gradient = slopes.T @ slopes, slopes.T @ (base - y[0])
    want = w[0] - np.linalg.solve(square + 1e-2 * np.diag(np.diag(square)), gradient)
    got, _ = neural.train(x, y, np.ones((1, 30), dtype=bool), w, hidden, rounds=1)
    assert got[0] == pytest.approx(want, rel=1e-3, abs=1e-4)


def test_order_by_yule_walker_is_the_best_by_aic():
    y = np.log(record(500))
    centered, scores = y - y.mean(), []
    moments = np.array([centered[: 500 - lag] @ centered[lag:] / 500 for lag in range(9)])
    for order in range(1, 9):
        system = np.array([[moments[abs(i - j)] for j in range(order)] for i in range(order)])
        phi = np.linalg.solve(system, moments[1 : order + 1])
        scores.append(500 * np.log(moments[0] - phi @ moments[1 : order + 1]) + 2 * (order + 1))
    assert neural.yule_walker_order(y, 8) == int(np.argmin(scores)) + 1 >= 2
    assert neural.yule_walker_order(np.ones(20), 8) == 1 and neural.yule_walker_order(np.arange(3.0), 8) == 1


def test_neural_flags(spark, world):
    out = neural.neural_ar(world["targets"], refs_at(spark, [("a", 100), ("a", 1)]), horizon=3, members=2, networks=2, flags=True)
    rows = {r["reference_datetime"]: r for r in out.collect()}
    assert rows[on(1)]["order"] is None and rows[on(1)]["converged"] is None and rows[on(1)]["prediction"] is None
    assert rows[on(100)]["order"] >= 1 and rows[on(100)]["converged"] is not None


# --- series ----------------------------------------------------------------------------------


def test_interpolation_of_leading_interior_and_trailing_gaps(spark):
    df = targets_from(spark, {"a": {0: None, 1: 2, 2: None, 4: 8, 6: None}, "b": {0: 1}})
    got = {(r["site_id"], r["datetime"]): r["observation"] for r in series.interpolate(df, ["site_id"], "observation").collect()}
    assert [got["a", on(i)] for i in (0, 1, 2, 4, 6)] == pytest.approx([2, 2, 4, 8, 8])


def test_rolling_sum_needs_a_full_window(spark):
    df = targets_from(spark, {"a": {i: (None if i == 12 else 1) for i in range(24)}})
    out = df.withColumn("s", series.rolling_sum("observation", ["site_id"], 10)).orderBy("datetime").collect()
    known = [i for i, r in enumerate(out) if r["s"] is not None]
    assert known == [9, 10, 11, 22, 23]


def test_last_before_is_strict_unless_inclusive(spark):
    obs = targets_from(spark, {"a": {0: 1, 3: None, 5: 2}})
    refs = refs_at(spark, [("a", 5), ("a", 0), ("a", 9)])

    def run(inclusive):
        out = lookup.last_before(obs, refs, ["site_id"], "observation", inclusive).collect()
        return {(r["reference_datetime"] - DAY).days: r["last_value"] for r in out}

    assert run(False) == {0: None, 5: 1.0, 9: 2.0}
    assert run(True) == {0: 1.0, 5: 2.0, 9: 2.0}


def test_scaffold_and_issue_dates(spark):
    obs = targets_from(spark, {"a": {0: None, 2: 1, 4: 3}, "b": {40: 1}})
    days = series.scaffold(obs, ["site_id"], "observation", F.lit(on(6))).filter("site_id = 'a'").orderBy("datetime").collect()
    assert [(r["datetime"] - DAY).days for r in days] == [2, 3, 4, 5, 6]
    assert [r["observation"] for r in days] == [1, None, 3, None, None]
    assert grid.issue_dates(obs, "month").filter("site_id = 'b'").collect()[0][1] == dt.date(2023, 2, 1)


def test_upsert_can_set_a_value_to_missing(spark):
    base = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "k int, v double")
    new = spark.createDataFrame([(1, 9.0), (2, None), (7, 7.0)], "k int, v double")
    got = {r["k"]: r["v"] for r in lookup.upsert(base, new, ["k"], "v").collect()}
    assert got == {1: 9.0, 2: None, 3: 3.0}
