import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarncast.functions import incomplete
from tarncast.plans import scoring


def brute_crps(x, y):
    x = np.asarray(x, float)
    return np.abs(x - y).mean() - np.abs(x[:, None] - x[None, :]).mean() / 2


def brute_logs(x, y):
    x = np.asarray(x, float)
    q75, q25 = np.quantile(x, [0.75, 0.25])
    h = 1.06 * min(x.std(ddof=1), (q75 - q25) / 1.34) * len(x) ** -0.2
    e = -0.5 * ((x - y) / h) ** 2
    top = e.max()
    return -(top + math.log(np.exp(e - top).mean()) - math.log(h) - 0.5 * math.log(2 * math.pi))


def ensembles(spark, rng):
    groups = {"a": rng.normal(3, 2, 31), "b": np.round(rng.normal(0, 1, 400), 1), "c": rng.gamma(2, 1, 7), "d": np.array([5.0])}
    truth = {"a": 4.5, "b": -0.3, "c": 60.0, "d": 7.0}
    rows = [(k, float(v), truth[k]) for k, xs in groups.items() for v in xs]
    return groups, truth, spark.createDataFrame(rows, "g string, prediction double, observation double")


@pytest.mark.parametrize("bounded", [True, False])
def test_sample_scores_match_brute_force(spark, bounded):
    """The same answers whether groups are arrays or cut into slices."""
    groups, truth, df = ensembles(spark, np.random.default_rng(1))
    got = {r["g"]: r for r in scoring.score_samples(df, ["g"], bounded=bounded).collect()}
    for g, x in groups.items():
        assert got[g]["crps"] == pytest.approx(brute_crps(x, truth[g]), rel=1e-9)
        assert got[g]["mean"] == pytest.approx(x.mean())
        assert got[g]["median"] == pytest.approx(np.median(x), abs=1e-12)
        for name, p in {"quantile97_5": 0.975, "quantile02_5": 0.025, "q95": 0.95, "q05": 0.05}.items():
            assert got[g][name] == pytest.approx(np.quantile(x, p), abs=1e-12)
        if len(x) > 1:
            assert got[g]["sd"] == pytest.approx(x.std(ddof=1), rel=1e-9)
            assert got[g]["logs"] == pytest.approx(brute_logs(x, truth[g]), rel=1e-9)
    assert got["d"]["sd"] is None and got["d"]["logs"] is None
    assert got["d"]["crps"] == pytest.approx(2.0)


def test_spread_of_large_values(spark):
    """Members near a billion: the spread must not cancel, and one shape of ranks serves every group."""
    values = [1e9 + v for v in np.random.default_rng(4).normal(0, 1, 40)]
    df = spark.createDataFrame([("a", float(v), 1e9) for v in values], "g string, prediction double, observation double")
    rows = [scoring.score_samples(df, ["g"], bounded=bounded).first() for bounded in (True, False)]
    for row in rows:
        assert row["sd"] == pytest.approx(np.std(values, ddof=1), rel=1e-6)
        assert row["logs"] == pytest.approx(brute_logs(np.array(values), 1e9), rel=1e-5)


def test_missing_key_values_are_groups(spark):
    df = spark.createDataFrame(
        [("m", None, 1.0, 2.0), ("m", None, 3.0, 2.0), ("m", 1.5, 2.0, 2.0)],
        "model_id string, depth_m double, prediction double, observation double",
    )
    for bounded in (True, False):
        got = scoring.score_samples(df, ["model_id", "depth_m"], logs=False, bounded=bounded).collect()
        assert {(r["depth_m"], round(r["crps"], 6)) for r in got} == {(None, 0.5), (1.5, 0.0)}


def integrate(cdf, y, low, high, n=400001):
    x = np.linspace(low, high, n)
    f = cdf(x) - (x >= y)
    return np.trapezoid(f * f, x)


def test_special_families_by_integration(spark):
    cases = {
        "gamma": [(2.5, 3.0, 1.2), (30.0, 2.0, 0.25), (0.1, 0.7, 0.5)],
        "beta": [(0.3, 2.0, 5.0), (0.95, 0.8, 1.4), (0.5, 6.0, 6.0)],
    }
    rows = [("gamma", y, a, b, None, None, None) for y, a, b in cases["gamma"]]
    rows += [("beta", y, None, None, a, b, None) for y, a, b in cases["beta"]]
    rows += [("gamma", 1.0, -1.0, 1.0, None, None, None)]
    schema = "family string, observation double, shape double, rate double, shape1 double, shape2 double, `lambda` double"
    got = scoring.score_parametric(spark.createDataFrame(rows, schema)).collect()
    for r in got:
        if r["shape"] is not None and r["shape"] > 0:
            want = integrate(lambda x: incomplete.gamma_cdf(r["shape"], r["rate"] * x), r["observation"], 0, 120)
            assert r["crps"] == pytest.approx(want, rel=2e-3, abs=1e-4)
        elif r["shape1"] is not None:
            want = integrate(lambda x: incomplete.beta_cdf(r["shape1"], r["shape2"], x), r["observation"], 0, 1)
            assert r["crps"] == pytest.approx(want, rel=2e-3, abs=1e-5)
        else:
            assert r["crps"] is None and r["logs"] is None


def test_unsettled_fractions_have_no_value():
    """A fraction whose terms end too early is NaN, so its score is NULL; the settled ones beside it keep their value."""
    parts = np.array([1.0, 1e9])
    got = incomplete._continued_fraction(parts, ((np.ones(2), parts) for _ in range(8)))
    assert np.isnan(got[0]) and got[1] == pytest.approx(1e9)
    got = incomplete._continued_fraction(parts, ((np.ones(2), parts) for _ in range(80)))
    assert got == pytest.approx([(1 + math.sqrt(5)) / 2, 1e9], rel=1e-14)


def test_poisson_by_summation(spark):
    rows = [("poisson", y, lam) for y in (0.0, 3.0, 20.0) for lam in (0.5, 4.0, 150.0)]
    got = scoring.score_parametric(spark.createDataFrame(rows, "family string, observation double, `lambda` double"))
    for r in got.collect():
        k = np.arange(0, 600)
        mass = np.exp(k * math.log(r["lambda"]) - r["lambda"] - np.array([math.lgamma(v + 1) for v in k]))
        want = np.sum((np.cumsum(mass) - (k >= r["observation"])) ** 2)
        assert r["crps"] == pytest.approx(want, rel=1e-9)


def test_normal_score_is_the_limit_of_samples(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(10, 2, 20000)
    df = spark.createDataFrame([("g", float(v), 11.0) for v in x], "g string, prediction double, observation double")
    sampled = scoring.score_samples(df, ["g"], logs=False).first()["crps"]
    normal = spark.createDataFrame([("normal", 11.0, 10.0, 2.0)], "family string, observation double, mu double, sigma double")
    assert sampled == pytest.approx(scoring.score_parametric(normal, ["normal"]).first()["crps"], rel=0.02)


def test_unusable_parameters_give_null(spark):
    rows = [("normal", 1.0, 0.0, 0.0), ("normal", 1.0, 0.0, -1.0), ("normal", None, 0.0, 1.0), ("cauchy", 1.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "family string, observation double, mu double, sigma double")
    assert all(r["crps"] is None and r["logs"] is None for r in scoring.score_parametric(df).collect())


def test_score_keeps_unobserved_forecasts_and_all_families(spark):
    rows = [("2024-01-02", "mu", "normal", 5.0), ("2024-01-02", "sigma", "normal", 2.0), ("2024-01-03", "mu", "normal", 5.0),
            ("2024-01-03", "sigma", "normal", 3.0)] + [("2024-01-02", str(i), "ensemble", float(i)) for i in range(1, 11)]
    forecast = spark.createDataFrame(rows, "d string, parameter string, family string, prediction double").select(
        F.to_date("d").alias("datetime"), F.lit("2024-01-01").cast("date").alias("reference_datetime"), F.lit("s").alias("site_id"),
        F.lit("m").alias("model_id"), "parameter", "family", "prediction", F.lit("v").alias("variable"),
    )
    target = spark.createDataFrame([("s", "v", 6.0)], "site_id string, variable string, observation double").withColumn(
        "datetime", F.lit("2024-01-02").cast("date")
    )
    got = {(str(r["datetime"]), r["family"]): r for r in scoring.score(forecast, target).collect()}
    assert len(got) == 3
    assert got["2024-01-03", "normal"]["crps"] is None and got["2024-01-03", "normal"]["sd"] == 3.0
    assert got["2024-01-02", "sample"]["crps"] == pytest.approx(brute_crps(range(1, 11), 6.0))
    short = scoring.score(forecast, target, summaries=False)
    assert "median" not in short.columns and short.count() == 3
    old = scoring.interval_names(scoring.score(forecast, target))
    assert {"quantile90", "quantile10"} <= set(old.columns)
    assert scoring.summarize(forecast).count() == 3


@pytest.mark.parametrize("bounded", [True, False])
def test_a_missing_member_leaves_the_ensemble_unscored(spark, bounded):
    rows = [("a", float(i), 2.0) for i in range(8)] + [("a", None, 2.0)] + [("b", float(i), 2.0) for i in range(8)] + [("c", None, 2.0)]
    df = spark.createDataFrame(rows, "g string, prediction double, observation double")
    got = {r["g"]: r for r in scoring.score_samples(df, ["g"], bounded=bounded).collect()}
    assert set(got) == {"a", "b", "c"}
    for g in ("a", "c"):
        assert got[g]["observation"] == 2.0
        assert all(got[g][c] is None for c in ("crps", "logs", "mean", "median", "sd", "q95"))
    assert got["b"]["crps"] == pytest.approx(brute_crps(range(8), 2.0))
