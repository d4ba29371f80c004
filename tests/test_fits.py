import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tarncast.operators import regress

XS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    rows = []
    for site, n in (("x", 60), ("y", 45)):
        x = rng.normal([1000, 0.01, -5], [3, 0.002, 20], (n, 3))
        y = 4 + x @ [0.3, 150, -0.02] + rng.normal(0, 0.5, n)
        rows += [(site, i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "site_id string, i int, a double, b double, c double, y double")
    return df.withColumn("datetime", F.expr("date_add(date'2024-01-01', i)")).cache()


def least_squares(pdf):
    x = np.column_stack([np.ones(len(pdf)), pdf[XS].to_numpy()])
    y = pdf["y"].to_numpy()
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    left = y - x @ beta
    se = np.sqrt(left @ left / (len(y) - 4) * np.diag(np.linalg.inv(x.T @ x)))
    return beta, se, left


def test_fit_matches_least_squares(spark, data):
    got = {r["site_id"]: r for r in regress.fit(data, ["site_id"], "y", XS).collect()}
    for site, pdf in data.toPandas().groupby("site_id"):
        beta, se, left = least_squares(pdf)
        assert got[site]["beta"] == pytest.approx(list(beta), rel=1e-7)
        assert got[site]["se"] == pytest.approx(list(se), rel=1e-7)
        assert got[site]["sigma"] == pytest.approx(left.std(ddof=1), rel=1e-9)
        assert abs(left.sum()) < 1e-6


def test_fit_matches_spark_ml(spark, data):
    one = data.filter("site_id = 'x'")
    model = LinearRegression(featuresCol="v", labelCol="y", solver="normal").fit(
        VectorAssembler(inputCols=XS, outputCol="v").transform(one)
    )
    got = regress.fit(one, ["site_id"], "y", XS).first()
    assert got["beta"] == pytest.approx([model.intercept, *model.coefficients], rel=1e-6)
    errors = model.summary.coefficientStandardErrors
    assert got["se"] == pytest.approx([errors[-1], *errors[:-1]], rel=1e-6)
    assert got["r2"] == pytest.approx(model.summary.r2, rel=1e-9)


@pytest.mark.parametrize("days", [None, 20])
def test_fit_before_uses_only_earlier_days(spark, data, days):
    refs = spark.createDataFrame([("x", "2024-02-01"), ("y", "2024-02-10"), ("x", "2024-01-03")], "site_id string, d string")
    refs = refs.select("site_id", F.to_date("d").alias("reference_datetime"))
    got = {(r["site_id"], str(r["reference_datetime"])): r for r in regress.fit_before(data, refs, ["site_id"], "y", XS, days).collect()}
    short = got.pop(("x", "2024-01-03"))
    assert short["n"] == 2 and short["status"] == "short" and short["beta"] is None
    assert set(got) == {("x", "2024-02-01"), ("y", "2024-02-10")}
    pdf = data.toPandas()
    for (site, ref), row in got.items():
        part = pdf[(pdf.site_id == site) & (pdf.datetime.astype(str) < ref)]
        if days:
            part = part.tail(days)
        assert row["n"] == len(part)
        assert row["beta"] == pytest.approx(list(least_squares(part)[0]), rel=1e-6)


def test_a_collinear_predictor_is_passed_over(spark, data):
    """The later one of two collinear predictors has no coefficient, and the others are those of the fit without it."""
    twin = data.withColumn("b", 2 * F.col("a") + 1)
    got = {r["site_id"]: r for r in regress.fit(twin, ["site_id"], "y", XS).collect()}
    without = {r["site_id"]: r for r in regress.fit(data, ["site_id"], "y", ["a", "c"]).collect()}
    assert set(got) == {"x", "y"}
    for site, row in got.items():
        want = without[site]
        assert row["status"] == "collinear" and row["rank"] == 2 and row["beta"][2] is None and row["se"][2] is None
        for name in ("beta", "se"):
            assert [v for v in row[name] if v is not None] == pytest.approx(want[name], rel=1e-6)
        assert (row["sigma"], row["rss"], row["r2"]) == pytest.approx((want["sigma"], want["rss"], want["r2"]), rel=1e-9)
    constant = regress.fit(data.withColumn("a", F.lit(3.0)), ["site_id"], "y", XS).first()
    assert constant["status"] == "collinear" and constant["beta"][1] is None and constant["beta"][2] is not None


def test_short_groups_keep_their_row(spark, data):
    rows = regress.fit(data.filter("i < 4"), ["site_id"], "y", XS).collect()
    assert [(r["n"], r["status"], r["beta"], r["rank"]) for r in rows] == [(4, "short", None, None)] * 2
    assert {r["status"] for r in regress.fit(data, ["site_id"], "y", XS).collect()} == {"ok"}
    value = regress.predict(F.col("beta"), [F.col(x) for x in XS])
    twin = regress.fit(data.withColumn("b", 2 * F.col("a") + 1), ["site_id"], "y", XS).select("beta", F.lit(1.0).alias("a"), F.lit(3.0).alias("b"), F.lit(2.0).alias("c"))
    assert all(r["v"] is not None for r in twin.select(value.alias("v")).collect())


def test_incomplete_rows_are_left_out(spark, data):
    holes = data.withColumn("b", F.when(F.col("i") % 7 != 0, F.col("b")))
    got = regress.fit(holes, ["site_id"], "y", XS).filter("site_id = 'x'").first()
    pdf = data.toPandas()
    part = pdf[(pdf.site_id == "x") & (pdf.i % 7 != 0)]
    assert got["n"] == len(part)
    assert got["beta"] == pytest.approx(list(least_squares(part)[0]), rel=1e-6)
