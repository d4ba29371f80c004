import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarncast.functions import noise, optics, seasons, special


def column(spark, values, expr):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    return [row[0] for row in df.select(expr(F.col("x"))).collect()]


def test_normal_cdf(spark):
    xs = [-38, -9, -7.1, -3, -1.5, -1e-9, 0, 0.3, 1, 2.5, 7.05, 7.08, 9]
    for x, got in zip(xs, column(spark, xs, special.normal_cdf)):
        assert got == pytest.approx(math.erfc(-x / math.sqrt(2)) / 2, rel=1e-12, abs=1e-15)


def test_log_gamma(spark):
    xs = [0.1, 0.5, 1, 1.5, 2, 10, 123.4, 1e4]
    for x, got in zip(xs, column(spark, xs, special.log_gamma)):
        assert got == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-12)


def test_published_compensation_curve(spark):
    """Seven readings of one concentration at seven temperatures flatten after compensation."""
    curve = list(zip([5, 10, 15, 20, 25, 30, 35], [1275, 1225, 1150, 1100, 1050, 1000, 950]))
    df = spark.createDataFrame([(float(t), float(f)) for t, f in curve], "t double, f double")
    got = [r[0] for r in df.select(optics.compensate(F.col("f"), F.col("t"))).collect()]
    for (t, f), g in zip(curve, got):
        assert g == pytest.approx(f / (1 - 0.01 * (t - 20)))
    assert (max(got) - min(got)) / 1100 < 0.05 < (1275 - 950) / 1100
    back = df.select(optics.uncompensate(optics.compensate(F.col("f"), F.col("t")), F.col("t"))).collect()
    assert [r[0] for r in back] == pytest.approx([float(f) for _, f in curve])


def test_seasons(spark):
    dates = ["2024-02-22", "2024-02-23", "2024-03-08", "2024-03-09", "2024-11-02", "2024-11-03", "2024-12-18", "2024-12-19"]
    df = spark.createDataFrame([(d,) for d in dates], "d string").select(F.to_date("d").alias("d"))
    got = [r[0] for r in df.select(seasons.season_by_doy(F.col("d"))).collect()]
    assert got == ["Winter", "Spring", "Spring", "Summer", "Summer", "Fall", "Fall", "Winter"]
    pair = [r[0] for r in df.select(seasons.stratified_or_mixed(F.col("d"))).collect()]
    assert pair == [None] * 4 + ["Winter"] * 4


def test_noise_is_standard_normal_and_keyed(spark):
    df = spark.range(20000).select(
        noise.standard_normal(noise.draw_key(F.col("id"), F.lit("a"))).alias("z"),
        noise.standard_normal(noise.draw_key(F.col("id"), F.lit("b"))).alias("w"),
    )
    row = df.agg(F.avg("z"), F.stddev("z"), F.corr("z", "w"), F.skewness("z"), F.kurtosis("z")).first()
    assert abs(row[0]) < 0.03 and abs(row[1] - 1) < 0.03 and abs(row[2]) < 0.03 and abs(row[3]) < 0.1 and abs(row[4]) < 0.2
    again = df.repartition(3).agg(F.sum("z")).first()[0]
    assert again == pytest.approx(df.agg(F.sum("z")).first()[0])


@settings(max_examples=5, deadline=None)
@given(st.integers(min_value=1, max_value=50))
def test_index_draws_stay_in_range(spark, size):
    df = spark.range(500).select(noise.uniform_index(noise.draw_key(F.col("id")), F.lit(size)).alias("i"))
    low, high = df.agg(F.min("i"), F.max("i")).first()
    assert 1 <= low and high <= size
