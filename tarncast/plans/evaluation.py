"""Error, skill, coverage and observation tables over scored forecasts.

A table shown for each site and pooled over sites is one aggregation with two grouping sets: the
forecasts are read and shuffled once, and the pooled row is over rows, not over site values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarncast.operators.reshape import lengthen, recode, split_label, transpose, widen

POOLED = "Across sites"
MEASURES = ["rmse", "mae", "crps", "sd"]
REPORT_HORIZONS = [1, 7, 14, 28]


def with_horizon(scored: DataFrame, first: int = 1, last: int = 34) -> DataFrame:
    """Horizon in days, kept inside the reported range."""
    days = F.datediff("datetime", "reference_datetime")
    return scored.withColumn("horizon", days).filter(F.col("horizon").between(first, last))


def with_model_type(scored: DataFrame, baselines) -> DataFrame:
    kind = F.when(F.col("model_id").isin(*baselines), "Baseline").otherwise("Data Driven")
    return scored.withColumn("model_type", kind)


def _rounded(column: Column, digits: int | None) -> Column:
    return column if digits is None else F.round(column, digits)


def rmse(digits: int | None = None) -> Column:
    error = F.col("mean") - F.col("observation")
    return _rounded(F.sqrt(F.avg(error * error)), digits)


def measures(digits: int | None = None) -> list[Column]:
    return [
        rmse(digits).alias("rmse"),
        F.avg(F.abs(F.col("mean") - F.col("observation"))).alias("mae"),
        F.avg("crps").alias("crps"),
        F.avg("sd").alias("sd"),
    ]


def per_site_and_pooled(df: DataFrame, keys: list[str], aggregates: list[Column], pooled: str = POOLED) -> DataFrame:
    """Aggregates for each site and for all sites together."""
    site, rest = F.col("site_id"), [F.col(k) for k in keys]
    grouped = df.groupingSets([[site, *rest], rest], site, *rest).agg(
        F.grouping("site_id").alias("is_pooled"), *aggregates
    )
    label = F.when(F.col("is_pooled") == 1, pooled).otherwise(F.col("site_id"))
    return grouped.withColumn("site_id", label).drop("is_pooled")


def error_by_horizon(scored: DataFrame, digits: int | None = None, extra=()) -> DataFrame:
    return per_site_and_pooled(scored, ["model_id", "horizon", *extra], measures(digits))


def measures_long(table: DataFrame, ids: list[str]) -> DataFrame:
    return lengthen(table, ids, MEASURES, "measure", "value")


def mean_over_models(table: DataFrame, keys: list[str], value: str = "rmse") -> DataFrame:
    """Unweighted mean over models of an already aggregated measure."""
    return table.groupBy(*keys).agg(F.avg(value).alias(value))


def spread_table(table: DataFrame, keys: list[str], value: str, digits: int | None = 1) -> DataFrame:
    """Minimum, median, mean, maximum and range; the range is of the rounded ends."""
    return (
        table.groupBy(*keys)
        .agg(
            _rounded(F.min(value), digits).alias("min"),
            _rounded(F.median(value), digits).alias("median"),
            _rounded(F.avg(value), digits).alias("mean"),
            _rounded(F.max(value), digits).alias("max"),
        )
        .withColumn("range", _rounded(F.col("max") - F.col("min"), digits))
    )


def at_horizons(table: DataFrame, horizons=REPORT_HORIZONS) -> DataFrame:
    return table.filter(F.col("horizon").isin(*horizons))


def horizon_table(table: DataFrame, value: str = "rmse", horizons=REPORT_HORIZONS) -> DataFrame:
    """One column for each reported horizon."""
    wide = widen(at_horizons(table, horizons), ["site_id", "model_id"], "horizon", value, list(horizons))
    return wide.withColumnsRenamed({str(h): f"h{h}" for h in horizons})


def fixed_horizon_series(scored: DataFrame, horizons=(1, 16, 34)) -> DataFrame:
    """Forecast, bounds and observation at a few horizons, over the whole period."""
    return at_horizons(scored, horizons).select(
        "model_id", "site_id", "horizon", "datetime", "observation", "mean", "quantile02_5", "quantile97_5"
    )


CASE = ["reference_datetime", "datetime", "horizon", "site_id"]


def crps_skill(scored: DataFrame, models: list[str], baseline: str, extra=()) -> DataFrame:
    """Mean over forecasts of 1 - crps / baseline crps, per site and pooled.

    The models of one case meet in one aggregation; no self-join of the score table.
    """
    cases = scored.groupBy(*CASE, *extra).agg(
        *[F.max(F.when(F.col("model_id") == m, F.col("crps"))).alias(m) for m in [*models, baseline]]
    )
    base = F.when(F.col(baseline) != 0, F.col(baseline))
    ratios = cases.select(*CASE, *extra, *[(1 - F.col(m) / base).alias(f"skill_{m}") for m in models])
    means = [F.avg(f"skill_{m}").alias(m) for m in models]
    table = per_site_and_pooled(ratios, ["horizon", *extra], means)
    return lengthen(table, ["site_id", "horizon", *extra], models, "model_id", "skill")


def rmse_skill(scored: DataFrame, models: list[str], baseline: str, digits: int | None = None, extra=()) -> DataFrame:
    """1 - RMSE / baseline RMSE, per site and pooled: a ratio of aggregates, not a mean of ratios."""
    table = per_site_and_pooled(scored, ["model_id", "horizon", *extra], [rmse(digits).alias("rmse")])
    wide = widen(table, ["site_id", "horizon", *extra], "model_id", "rmse", [*models, baseline])
    base = F.when(F.col(baseline) != 0, F.col(baseline))
    ratios = wide.select(
        "site_id", "horizon", *extra, *[(1 - F.col(m) / base).alias(f"skill_{m}") for m in models]
    ).withColumnsRenamed({f"skill_{m}": m for m in models})
    return lengthen(ratios, ["site_id", "horizon", *extra], models, "model_id", "skill")


def skill_table(
    scored: DataFrame, models: list[str], baselines: dict[str, str], digits: int | None = None, extra=()
) -> DataFrame:
    """Both skill measures against every baseline, labelled skill_model_metric_null and split again.

    One pass: a case carries the crps and the squared errors of every model, one aggregate with two grouping sets
    gives the mean ratios to every baseline and every RMSE, and each of its rows opens into its skills.
    """
    known = list(dict.fromkeys([*models, *baselines.values()]))
    error = F.col("mean") - F.col("observation")
    of = lambda m, value: F.when(F.col("model_id") == m, value)
    cases = scored.groupBy(*CASE, *extra).agg(
        *[F.max(of(m, F.col("crps"))).alias(f"crps_{m}") for m in known],
        *[F.sum(of(m, error * error)).alias(f"squares_{m}") for m in known],
        *[F.count(of(m, error)).alias(f"errors_{m}") for m in known],
    )
    pairs = [(m, short, baseline) for short, baseline in baselines.items() for m in models]
    gain = lambda value, base: 1 - value / F.when(base != 0, base)
    ratios = [
        F.avg(gain(F.col(f"crps_{m}"), F.col(f"crps_{baseline}"))).alias(f"crps_{m}_{short}") for m, short, baseline in pairs
    ]
    errors = {m: (F.sum(f"squares_{m}"), F.sum(f"errors_{m}")) for m in known}
    roots = [_rounded(F.sqrt(squares / F.when(n != 0, n)), digits).alias(f"rmse_{m}") for m, (squares, n) in errors.items()]
    table = per_site_and_pooled(cases, ["horizon", *extra], [*ratios, *roots])
    skills = []
    for m, short, baseline in pairs:
        for metric, skill in (
            ("crps", F.col(f"crps_{m}_{short}")),
            ("rmse", gain(F.col(f"rmse_{m}"), F.col(f"rmse_{baseline}"))),
        ):
            skills.append(F.struct(F.lit(f"Skill_{m}_{metric}_{short}").alias("label"), skill.alias("skill")))
    out = table.select("site_id", "horizon", *extra, F.inline(F.array(*skills)))
    split = split_label(out, "label", ["kind", "model_id", "metric", "null_model"], "_")
    return split.withColumn("null_model", recode(F.col("null_model"), baselines)).drop("kind")


def coverage(scored: DataFrame) -> DataFrame:
    """Share of observations inside the 95% interval."""
    inside = F.col("observation").between(F.col("quantile02_5"), F.col("quantile97_5"))
    return (
        scored.groupBy("model_id", "site_id", "horizon")
        .agg(F.sum(inside.cast("int")).alias("inside"), F.count(inside).alias("observed"))
        .withColumn("share", F.col("inside") / F.col("observed"))
    )


def best_and_worst(table: DataFrame, keys: list[str], value: str = "rmse") -> DataFrame:
    """Model with the least and the greatest error; ties go to the first name."""
    last_name = F.struct(F.col(value), F.col("model_id"))
    return table.groupBy(*keys).agg(
        F.min_by("model_id", last_name).alias("best_model"),
        F.min(value).alias("best"),
        F.min_by("model_id", F.struct(-F.col(value), F.col("model_id"))).alias("worst_model"),
        F.max(value).alias("worst"),
    )


def with_model_mean(scored: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Group mean next to each row, as an aggregate joined back: no group is gathered in one task."""
    means = scored.groupBy(*keys).agg(F.avg(value).alias(f"mean_{value}"))
    return scored.join(means, keys)


def best_model_rows(scored: DataFrame, choice: dict[str, str], otherwise: str) -> DataFrame:
    """Each site's chosen model only."""
    return scored.filter(F.col("model_id") == recode(F.col("site_id"), choice, F.lit(otherwise)))


def residuals(scored: DataFrame) -> DataFrame:
    return scored.withColumn("residual", F.col("observation") - F.col("mean"))


def bias_by_season(scored: DataFrame, season: Column) -> DataFrame:
    """Mean residual and spread of the predictions by horizon and season."""
    return (
        residuals(scored)
        .withColumn("season", season)
        .groupBy("model_id", "horizon", "season")
        .agg(F.avg("residual").alias("bias"), F.stddev_samp("mean").alias("prediction_sd"))
    )


def missing_observations(scored: DataFrame) -> DataFrame:
    """Dates with forecasts but no observation, and how many forecasts that concerns."""
    return (
        scored.filter(F.col("observation").isNull())
        .groupBy("site_id", "datetime")
        .agg(F.count(F.lit(1)).alias("forecasts"))
    )


def longest_horizon(forecast: DataFrame) -> DataFrame:
    """Greatest horizon of each issue: a completeness check of a forecast archive."""
    days = F.datediff("datetime", "reference_datetime")
    return forecast.groupBy("site_id", "reference_datetime").agg(F.max(days).alias("max_horizon"))


def example_forecast(scored: DataFrame, ref, context_days: int = 7) -> DataFrame:
    """One issue next to the observations of the week before it; later observations are hidden."""
    day = F.lit(ref).cast("date")
    before = (
        scored.filter(F.col("datetime").between(F.date_sub(day, context_days), day))
        .select("datetime", "observation", "model_id", "site_id")
        .distinct()
    )
    shown = scored.filter(F.col("reference_datetime") == day).unionByName(before, allowMissingColumns=True)
    return shown.withColumn("observation", F.when(F.col("datetime") <= day, F.col("observation")))


def observation_summary(targets: DataFrame, keys: list[str], digits: int | None = 1) -> DataFrame:
    """Statistics of the observations, the range as text and the coefficient of variation in percent.

    As published, the range and the variation are taken from the rounded statistics.
    """
    table = targets.groupBy(*keys).agg(
        _rounded(F.min("observation"), digits).alias("min"),
        _rounded(F.median("observation"), digits).alias("median"),
        _rounded(F.avg("observation"), digits).alias("mean"),
        _rounded(F.max("observation"), digits).alias("max"),
        _rounded(F.stddev_samp("observation"), digits).alias("sd"),
    )
    return (
        table.withColumn("range", _rounded(F.col("max") - F.col("min"), digits))
        .withColumn("range_text", F.concat_ws(" - ", F.col("min").cast("string"), F.col("max").cast("string")))
        .withColumn("cv_percent", F.round(F.round(F.col("sd") / F.col("mean"), 2) * 100, 0))
    )


def season_columns(summary: DataFrame, values: list[str], seasons=("Winter", "Spring", "Summer", "Fall")) -> DataFrame:
    """Seasons across, statistics down."""
    return transpose(summary, ["site_id"], values, "season", list(seasons))


def lagged_correlation(daily: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Correlation of two daily variables on the same day and with the second one a row earlier."""
    w = W.partitionBy(*keys).orderBy("datetime")
    lagged = daily.withColumn("b_lag1", F.lag(b).over(w)).filter(F.col(a).isNotNull() & F.col("b_lag1").isNotNull())
    return lagged.groupBy(*keys).agg(
        F.corr(a, b).alias("same_day"), F.corr(a, "b_lag1").alias("one_day_lag"), F.count(F.lit(1)).alias("days")
    )
