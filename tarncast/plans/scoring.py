"""Scores and summaries of ensemble and parametric forecasts."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarncast.functions import incomplete, scores
from tarncast.functions.special import Z_95, Z_975, normal_cdf
from tarncast.operators.ranks import quantile, rank_in_slices, weighted_mean
from tarncast.operators.reshape import parameters_wide, present

# The column, parameter and family names of the forecast tables.
GROUPING = [
    "datetime", "reference_datetime", "site_id", "model_id", "family", "variable", "pubDate", "pub_datetime",
]
PARAMETERS = [
    "mu", "sigma", "prob", "min", "max", "shape", "shape1", "shape2", "rate", "location", "scale", "lambda",
]
FAMILIES = (
    "normal", "lognormal", "logistic", "exponential", "uniform", "bernoulli", "gamma", "beta", "poisson",
)
SCORES = ["crps", "logs"]
SALT_ROWS = 100_000
# q95 and q05 bound the central 90% interval; some tables call them quantile90 and quantile10.
SUMMARIES = ["mean", "median", "sd", "quantile97_5", "quantile02_5", "q95", "q05"]
LEVELS = {"median": 0.5, "quantile97_5": 0.975, "quantile02_5": 0.025, "q95": 0.95, "q05": 0.05}


def as_sample(forecast: DataFrame) -> DataFrame:
    """The ``ensemble`` family under its scoring name."""
    family = F.when(F.col("family") == "ensemble", "sample").otherwise(F.col("family"))
    return forecast.withColumn("family", family)


def standard_target(target: DataFrame, extra_groups=()) -> DataFrame:
    """The target columns that scoring joins on, and the observation."""
    return target.select(*present(target, ["datetime", "site_id", "variable", *extra_groups]), "observation")


def group_keys(forecast: DataFrame, extra_groups=()) -> list[str]:
    return present(forecast, [*GROUPING, *extra_groups])


def attach_observation(forecast: DataFrame, target: DataFrame, extra_groups=()) -> DataFrame:
    """Each forecast row with its observation; extra keys match missing to missing."""
    obs = standard_target(target, extra_groups)
    on = [c for c in obs.columns if c != "observation"]
    side = obs.select(*[F.col(c).alias(f"obs_{c}") for c in on], "observation")
    same = [
        F.col(c).eqNullSafe(F.col(f"obs_{c}")) if c in extra_groups else F.col(c) == F.col(f"obs_{c}")
        for c in on
    ]
    return forecast.join(side, same, "left").drop(*[f"obs_{c}" for c in on])


def single_observation_violations(forecast: DataFrame, target: DataFrame, extra_groups=()) -> DataFrame:
    """Forecast groups that would meet more than one observation; empty for a sound target table."""
    keys = group_keys(forecast, extra_groups)
    one = forecast.select(*keys).distinct()
    return (
        attach_observation(one, target, extra_groups)
        .groupBy(*keys)
        .agg(F.count_distinct("observation").alias("observations"))
        .filter(F.col("observations") > 1)
    )


# --- ensembles -------------------------------------------------------------------------------


# An ensemble that its producer bounds is one sorted array: one shuffle, then expressions over it.


def _array_quantile(p: float) -> Column:
    """Interpolated (type 7) quantile of the sorted array ``xs``."""
    position = (F.col("n") - 1) * F.lit(p)
    low = F.floor(position).cast("int")
    at_low, at_high = F.get("xs", low), F.get("xs", F.least(low + 1, F.col("n") - 1))
    return at_low + (at_high - at_low) * (position - low)


def _array_crps(y: str) -> Column:
    """Sorted form of E|X - y| - E|X - X'| / 2, linear in the members."""
    terms = f"transform(xs, (x, i) -> (x - {y}) * (if(x > {y}, n, 0) - i - 0.5D))"
    total = F.expr(f"aggregate({terms}, 0D, (a, v) -> a + v)")
    return 2 * total / F.col("n") / F.col("n")


def _kernel_score(near: Column, kernels: Column, width: Column, size: Column) -> Column:
    """Log score of a Gaussian kernel density whose largest kernel has been factored out.

    Factoring it out keeps the score finite for an observation far from every member.
    """
    relative = near / width
    return relative * relative / 2 - F.ln(kernels / size) + F.ln(width) + 0.5 * math.log(2 * math.pi)


def _bandwidth(sd: Column, iqr: Column, size: Column) -> Column:
    """Rule-of-thumb kernel width; NULL where the ensemble has no spread."""
    width = 1.06 * F.least(sd, iqr / 1.34) * F.pow(size, F.lit(-0.2))
    return F.when(width > 0, width)


def _pack(rows: DataFrame, keys: list[str], value: str, y: str | None) -> DataFrame:
    """One row for each ensemble: its sorted members, size, mean and spread, and ``y`` if the rows have it.

    All are NULL where a member is missing.
    """
    observed = [F.max(y).alias(y)] if y else []
    whole = F.count(value) == F.count(F.lit(1))
    members = {
        "xs": F.sort_array(F.collect_list(value)),
        "n": F.count(value).cast("int"),
        "mean": F.avg(value),
        "sd": F.stddev_samp(value),
    }
    return rows.groupBy(*keys).agg(*[F.when(whole, c).alias(name) for name, c in members.items()], *observed)


def _score_packed(packed: DataFrame, keys: list[str], y: str | None, summaries: bool, logs: bool) -> DataFrame:
    df, out = packed, list(keys)
    if y:
        df = df.withColumn("crps", _array_crps(y))
        out += [y, "crps"]
    if logs:
        df = df.withColumns(
            {
                "width": _bandwidth(F.col("sd"), _array_quantile(0.75) - _array_quantile(0.25), F.col("n")),
                "near": F.array_min(F.transform("xs", lambda x: F.abs(x - F.col(y)))),
            }
        )
        kernels = F.expr(
            f"aggregate(xs, 0D, (a, x) -> a + exp((near * near - (x - {y}) * (x - {y})) / (2 * width * width)))"
        )
        out.append(_kernel_score(F.col("near"), kernels, F.col("width"), F.col("n")).alias("logs"))
    if summaries:
        out += ["mean", "sd", *[_array_quantile(p).alias(name) for name, p in LEVELS.items()]]
    return df.select(*out)


# An ensemble of any size is spread over many tasks as ranked slices; every step is a mergeable aggregate.


def _slice_crps(value: str, y: str) -> Column:
    d = F.col(value) - F.col(y)
    rank_sum = F.col("copies") * (F.col("rank_lo") + F.col("rank_hi") - 1) / 2
    above = F.sum(F.greatest(d, F.lit(0.0)) * F.col("copies"))
    n = F.max("n")
    return 2 * (n * above - F.sum(d * rank_sum)) / n / n


def _slice_sd(value: str) -> Column:
    """Sample standard deviation over rows that stand for several equal values."""
    off, c = F.col(value) - F.col("center"), F.col("copies")
    spread = F.sum(off * off * c) - F.sum(off * c) * F.sum(off * c) / F.sum(c)
    return F.when(F.sum(c) > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (F.sum(c) - 1)))


def _score_slices(ranked: DataFrame, keys: list[str], value: str, y: str | None, summaries: bool, logs: bool) -> DataFrame:
    columns = [weighted_mean(value).alias("mean"), _slice_sd(value).alias("sd"), F.max("n").alias("n"), F.max("missing").alias("missing")]
    columns += [quantile(value, p).alias(name) for name, p in LEVELS.items()]
    columns.append((quantile(value, 0.75) - quantile(value, 0.25)).alias("iqr"))
    if y:
        columns += [
            F.max(y).alias(y),
            _slice_crps(value, y).alias("crps"),
            F.min(F.abs(F.col(value) - F.col(y))).alias("near"),
        ]
    stats = ranked.groupBy(*keys).agg(*columns)
    scores = ["crps"] if y else []
    if logs:
        stats = stats.withColumn("width", _bandwidth(F.col("sd"), F.col("iqr"), F.col("n")))
        kernels = _slice_kernels(ranked, stats, keys, value, y)
        same = [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys]
        stats = stats.join(kernels, same, "left").withColumn(
            "logs", _kernel_score(F.col("near"), F.col("kernels"), F.col("width"), F.col("n"))
        )
        scores.append("logs")
    whole = [F.when(F.col("missing") == 0, F.col(c)).alias(c) for c in [*scores, *(SUMMARIES if summaries else [])]]
    return stats.select(*keys, *([y] if y else []), *whole)


def _slice_kernels(ranked: DataFrame, stats: DataFrame, keys: list[str], value: str, y: str) -> DataFrame:
    """Kernel sums of groups, which meet their bandwidth through a copy of it for every SALT_ROWS members."""
    salts = F.ceil(F.col("n") / F.lit(SALT_ROWS)).cast("int")
    side = stats.select(*[F.col(k).alias(f"k_{k}") for k in keys], "width", "near", salts.alias("salts")).withColumn(
        "k_salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
    )
    rows = ranked.withColumn("salt", F.pmod(F.xxhash64(value), salts).cast("int"))
    same = [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys] + [F.col("salt") == F.col("k_salt")]
    d, w = F.col(value) - F.col(y), F.col("width")
    relative = F.exp((F.col("near") * F.col("near") - d * d) / (2 * w * w))
    sums = rows.join(side, same).groupBy(*[F.col(f"k_{k}") for k in keys])
    return sums.agg(F.sum(relative * F.col("copies")).alias("kernels"))


def score_samples(
    rows: DataFrame,
    keys: list[str],
    value: str = "prediction",
    y: str | None = "observation",
    summaries: bool = True,
    logs: bool = True,
    bounded: bool = False,
    attach: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """CRPS, log score and summaries of ensembles of any size; one row for each group.

    ``y`` must be constant inside a group. Where the rows do not have it yet, ``attach`` adds it:
    after packing, so the join sees one row for each ensemble instead of one for each member.
    An ensemble with a missing member keeps its row, unscored. ``bounded`` says that the producer
    bounds the group, as the forecast models do with their members: each is then one array.
    """
    carried = y if y and attach is None else None
    used = rows.select(*keys, *([carried] if carried else []), value)
    logs = logs and y is not None
    if bounded:
        packed = _pack(used, keys, value, carried)
        return _score_packed(attach(packed) if attach else packed, keys, y, summaries, logs)
    rows = attach(used) if attach else used
    ranks = rank_in_slices(rows, keys, value, [y] if y else [], gaps=True)
    return _score_slices(ranks, keys, value, y, summaries, logs)


# --- parametric families ---------------------------------------------------------------------


def _by_family(choices: dict[str, Callable[[], Column]], families, kind: str = "double") -> Column:
    """One value for each family; a family that is not listed gives NULL."""
    out = F.lit(None).cast(kind)
    for family, value in choices.items():
        if family in families:
            out = F.when(F.col("family") == family, value()).otherwise(out)
    return out


def _parameter(name: str) -> Column:
    return F.col(f"`{name}`")


# Columns that hold what the closed scores use again and again.
STEPS = ["std__z", "std__below"]


def _with_steps(wide: DataFrame, families) -> DataFrame:
    """``wide`` with each row's standard observation, 0 where it has none, and the normal probabilities that its score needs.

    Spark writes an expression out wherever it is used, and the JVM does not compile methods as long as that makes;
    columns of a step before are computed once, and the probabilities of a row share one function over an array.
    """
    y, p = F.col("observation"), _parameter
    z, sigma = F.col("std__z"), p("sigma")
    standard = {
        "normal": lambda: F.when(sigma > 0, (y - p("mu")) / sigma),
        "lognormal": lambda: F.when(sigma > 0, (F.ln(y) - p("mu")) / sigma),
        "logistic": lambda: F.when(p("scale") > 0, (y - p("location")) / p("scale")),
    }
    points = {"normal": lambda: F.array(z), "lognormal": lambda: F.array(z, z - sigma, sigma / math.sqrt(2))}
    with_z = wide.withColumn("std__z", F.coalesce(_by_family(standard, families), F.lit(0.0)))
    of_family = _by_family(points, families, "array<double>")
    return with_z.withColumn("std__below", F.transform(of_family, normal_cdf))


def _closed_scores(families) -> dict[str, Column]:
    y, p = F.col("observation"), _parameter
    z, below = F.col("std__z"), F.col("std__below")
    first, shifted, half = (F.get(below, F.lit(at)) for at in range(3))
    crps = {
        "normal": lambda: scores.crps_normal(y, p("mu"), p("sigma"), z, first),
        "lognormal": lambda: scores.crps_lognormal(y, p("mu"), p("sigma"), first, shifted, half),
        "logistic": lambda: scores.crps_logistic(y, p("location"), p("scale"), z),
        "exponential": lambda: scores.crps_exponential(y, p("rate")),
        "uniform": lambda: scores.crps_uniform(y, p("min"), p("max")),
        "bernoulli": lambda: scores.crps_bernoulli(y, p("prob")),
    }
    logs = {
        "normal": lambda: scores.logs_normal(y, p("mu"), p("sigma"), z),
        "lognormal": lambda: scores.logs_lognormal(y, p("mu"), p("sigma"), z),
        "logistic": lambda: scores.logs_logistic(y, p("location"), p("scale"), z),
        "exponential": lambda: scores.logs_exponential(y, p("rate")),
        "uniform": lambda: scores.logs_uniform(y, p("min"), p("max")),
        "bernoulli": lambda: scores.logs_bernoulli(y, p("prob")),
        "poisson": lambda: scores.logs_poisson(y, p("lambda")),
        "gamma": lambda: scores.logs_gamma(y, p("shape"), p("rate")),
        "beta": lambda: scores.logs_beta(y, p("shape1"), p("shape2")),
    }
    return {"crps": _by_family(crps, families), "logs": _by_family(logs, families)}


def _summary_columns(families) -> dict[str, Column]:
    """Closed-form summaries; NULL where a family has no closed form."""
    c = _parameter
    z = {"quantile97_5": Z_975, "quantile02_5": -Z_975, "q95": Z_95, "q05": -Z_95}

    def log_mean():
        return F.exp(c("mu") + c("sigma") * c("sigma") / 2)

    def total():
        return c("shape1") + c("shape2")

    mean = {
        "normal": lambda: c("mu"),
        "lognormal": log_mean,
        "logistic": lambda: c("location"),
        "exponential": lambda: 1 / c("rate"),
        "uniform": lambda: (c("min") + c("max")) / 2,
        "bernoulli": lambda: c("prob"),
        "poisson": lambda: c("lambda"),
        "gamma": lambda: c("shape") / c("rate"),
        "beta": lambda: c("shape1") / total(),
    }
    sd = {
        "normal": lambda: c("sigma"),
        "lognormal": lambda: log_mean() * F.sqrt(F.expm1(c("sigma") * c("sigma"))),
        "logistic": lambda: c("scale") * (math.pi / math.sqrt(3)),
        "exponential": lambda: 1 / c("rate"),
        "uniform": lambda: (c("max") - c("min")) / math.sqrt(12),
        "bernoulli": lambda: F.sqrt(c("prob") * (1 - c("prob"))),
        "poisson": lambda: F.sqrt(c("lambda")),
        "gamma": lambda: F.sqrt(c("shape")) / c("rate"),
        "beta": lambda: F.sqrt(c("shape1") * c("shape2") / (total() + 1)) / total(),
    }
    out = {"mean": _by_family(mean, families), "sd": _by_family(sd, families)}
    for name, p in LEVELS.items():

        def normal(name=name):
            return c("mu") + z[name] * c("sigma") if name in z else c("mu")

        quantiles = {
            "normal": normal,
            "lognormal": lambda: F.exp(normal()),
            "logistic": lambda p=p: c("location") + math.log(p / (1 - p)) * c("scale"),
            "exponential": lambda p=p: -math.log(1 - p) / c("rate"),
            "uniform": lambda p=p: c("min") + p * (c("max") - c("min")),
            "bernoulli": lambda p=p: F.when(1 - c("prob") >= p, 0.0).otherwise(1.0),
        }
        out[name] = _by_family(quantiles, families)
    return out


def _with_parameters(wide: DataFrame) -> DataFrame:
    missing = [name for name in PARAMETERS if name not in wide.columns]
    return wide.withColumns({name: F.lit(None).cast("double") for name in missing}) if missing else wide


def with_summaries(wide: DataFrame, families=FAMILIES) -> DataFrame:
    """Add the distribution summaries to rows holding a family and its parameters."""
    return _with_parameters(wide).withColumns(_summary_columns(families))


def score_parametric(wide: DataFrame, families=FAMILIES) -> DataFrame:
    """Add ``crps`` and ``logs`` to rows holding an observation, a family and its parameters.

    ``families`` names the families to score; any other row stays unscored. Gamma, beta and
    Poisson CRPS go through Arrow batches, and only rows of those families do.
    """
    closed = _with_steps(_with_parameters(wide), families).withColumns(_closed_scores(families)).drop(*STEPS)
    y, p = F.col("observation"), _parameter
    special = {
        "gamma": lambda: incomplete.crps_gamma(y, p("shape"), p("rate")),
        "beta": lambda: incomplete.crps_beta(y, p("shape1"), p("shape2")),
        "poisson": lambda: incomplete.crps_poisson(y, p("lambda")),
    }
    chosen = [name for name in special if name in families]
    if not chosen:
        return closed
    parts = [closed.filter(~F.col("family").isin(*chosen))]
    parts += [closed.filter(F.col("family") == name).withColumn("crps", special[name]()) for name in chosen]
    return reduce(lambda a, b: a.unionByName(b), parts)


# --- both ------------------------------------------------------------------------------------


def score(
    forecast: DataFrame,
    target: DataFrame,
    extra_groups=(),
    summaries: bool = True,
    families=FAMILIES,
    bounded: bool = False,
) -> DataFrame:
    """CRPS and log score of every forecast in a long table, all families and models in one pass.

    Naming the parametric ``families`` that occur keeps the plan to what is needed.
    """
    long = as_sample(forecast)
    keys = group_keys(long, extra_groups)
    names = [*keys, "observation", *SCORES, *(SUMMARIES if summaries else [])]
    parametric = parameters_wide(long.filter(F.col("family") != "sample"), keys, PARAMETERS)
    scored = score_parametric(attach_observation(parametric, target, extra_groups), families)
    if summaries:
        scored = with_summaries(scored, families)
    sampled = score_samples(
        long.filter(F.col("family") == "sample"),
        keys,
        summaries=summaries,
        bounded=bounded,
        attach=lambda df: attach_observation(df, target, extra_groups),
    )
    return scored.select(*names).unionByName(sampled.select(*names))


def summarize(
    forecast: DataFrame, extra_groups=(), families=FAMILIES, bounded: bool = False
) -> DataFrame:
    """Distribution summaries without observations."""
    long = as_sample(forecast)
    keys = group_keys(long, extra_groups)
    parametric = parameters_wide(long.filter(F.col("family") != "sample"), keys, PARAMETERS)
    rows = long.filter(F.col("family") == "sample")
    sampled = score_samples(rows, keys, y=None, logs=False, bounded=bounded)
    return (
        with_summaries(parametric, families)
        .select(*keys, *SUMMARIES)
        .unionByName(sampled.select(*keys, *SUMMARIES))
    )


def normal_interval(mu: Column, sigma: Column) -> tuple[Column, Column]:
    """Central 95% interval of a normal forecast."""
    return mu - Z_975 * sigma, mu + Z_975 * sigma


def interval_names(scored: DataFrame) -> DataFrame:
    """The 90% bounds under the names some published tables use."""
    return scored.withColumnsRenamed({"q95": "quantile90", "q05": "quantile10"})
