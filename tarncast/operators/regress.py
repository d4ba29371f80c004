"""Ordinary least squares as relational algebra.

Fitting needs only counts, means and covariances. For one fit for each group these are plain
aggregates; for one fit for each (series, reference date) they are running aggregates over the
daily series. The k x k solve then works on one small row for each fit and stays a column
expression.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A pivot below this share of its variance means a predictor adds nothing new.
SINGULAR = 1e-12


def simple_fit(y: str, x: str) -> list[Column]:
    """Aggregates of a one-predictor fit."""
    return [
        F.regr_count(y, x).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    ]


def _pairs(k: int):
    return [(i, j) for i in range(k) for j in range(i, k)]


def _complete(y: str, xs: list[str]) -> list[Column]:
    """The variables of a fit, NULL unless all of them are known."""
    names = [*xs, y]
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in names])
    return [F.when(complete, F.col(c)).cast("double").alias(f"f{i}") for i, c in enumerate(names)]


def _moments(variables: int, over: str = "") -> list[Column]:
    """Count, means and covariances of f0.., as aggregates or over a window."""
    out = [F.expr(f"count(f0) {over}").alias("n")]
    out += [F.expr(f"avg(f{i}) {over}").alias(f"m{i}") for i in range(variables)]
    out += [F.expr(f"covar_samp(f{i}, f{j}) {over}").alias(f"c{i}_{j}") for i, j in _pairs(variables)]
    return out


def solve(moments: DataFrame, k: int, min_rows: int | None = None) -> DataFrame:
    """Add ``beta`` and ``se`` (intercept first), ``sigma``, ``rss``, ``r2``, ``rank`` and ``status`` to rows of moments.

    The covariance matrix of predictors and response, one flat array, is swept on each predictor:
    what remains is the inverse, the slopes and the residual variance. One fold over an array
    keeps the plan as small for twenty predictors as for two. Predictors are taken in order; one of which the
    earlier ones leave no more than ``SINGULAR`` of its variance is passed over: its entries of ``beta`` and ``se``
    are NULL, ``rank`` does not count it, and the fit goes on (status ``collinear``). Every group keeps its row: one of
    fewer than ``min_rows`` rows (at least two more than predictors) has status ``short`` and no fit.
    """
    keep = [c for c in moments.columns if c != "n" and not _is_moment(c)]
    m = k + 1
    flat = F.array(*[F.col(f"c{min(i, j)}_{max(i, j)}") for i in range(m) for j in range(m)])
    means = F.array(*[F.col(f"m{i}") for i in range(m)])
    row, col, pivot = f"cast(t div {m} as int)", f"cast(t % {m} as int)", f"s.a[p * {m} + p]"
    sweep = f"""
        aggregate(sequence(0, {k - 1}), named_struct('a', cov, 'used', cast(array() as array<boolean>)), (s, p) ->
            if(coalesce({pivot} > {SINGULAR} * cov[p * {m} + p], false),
               named_struct('a', transform(s.a, (v, t) ->
                    case when {row} = p and {col} = p then 1 / {pivot}
                         when {row} = p then v / {pivot}
                         when {col} = p then -v / {pivot}
                         else v - s.a[{row} * {m} + p] * s.a[p * {m} + {col}] / {pivot} end),
                    'used', concat(s.used, array(true))),
               named_struct('a', s.a, 'used', concat(s.used, array(false)))))"""
    swept = moments.select(*keep, "n", means.alias("mean"), flat.alias("cov")).withColumn("s", F.expr(sweep))
    n, rank = F.col("n"), F.size(F.filter(F.col("s.used"), lambda u: u))
    long = n >= max(min_rows or 0, k + 2)

    def s(i, j):
        return F.col("s.a")[i * m + j]

    def mean(i):
        return F.col("mean")[i]

    def used(*js):
        return reduce(lambda a, b: a & b, [F.col("s.used")[j] for j in js])

    def total(terms):
        return reduce(lambda a, b: a + b, terms)

    spread = F.greatest(s(k, k), F.lit(0.0))
    intercept = mean(k) - total([F.when(used(j), s(j, k) * mean(j)).otherwise(0.0) for j in range(k)])
    lever = total([F.when(used(i, j), mean(i) * s(i, j) * mean(j)).otherwise(0.0) for i in range(k) for j in range(k)])
    s2 = spread * (n - 1) / (n - rank - 1)
    errors = [F.sqrt(s2 * (1 / n + lever / (n - 1))), *[F.when(used(j), F.sqrt(s2 * s(j, j) / (n - 1))) for j in range(k)]]
    return swept.select(
        *keep,
        "n",
        F.when(long, F.array(intercept, *[F.when(used(j), s(j, k)) for j in range(k)])).alias("beta"),
        F.when(long, F.array(*errors)).alias("se"),
        F.when(long, F.sqrt(spread)).alias("sigma"),
        F.when(long, spread * (n - 1)).alias("rss"),
        F.when(long, 1 - spread / F.col("cov")[m * m - 1]).alias("r2"),
        F.when(long, rank).alias("rank"),
        F.when(~long, "short").when(rank < k, "collinear").otherwise("ok").alias("status"),
    )


def _is_moment(name: str) -> bool:
    head, _, tail = name[1:].partition("_")
    return name[0] in "mc" and head.isdigit() and (tail == "" or tail.isdigit())


def fit(df: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    """One multiple regression for each group; the moments are mergeable aggregates."""
    rows = df.select(*keys, *_complete(y, xs))
    grouped = rows.groupBy(*keys) if keys else rows
    return solve(grouped.agg(*_moments(len(xs) + 1)), len(xs))


def fit_before(
    daily: DataFrame, refs: DataFrame, keys: list[str], y: str, xs: list[str], trailing_days: int | None = None,
    min_rows: int | None = None,
) -> DataFrame:
    """One regression for each (series, reference date) on the days strictly before it; every reference date keeps its row.

    A single ordered pass over days and reference dates of a series gives the moments of all its
    fits: the record is never re-filtered for each date. With ``trailing_days`` only that many
    days before the reference date are used.
    """
    m = len(xs) + 1
    days = daily.select(
        *keys, F.unix_date("datetime").alias("day"), F.lit(None).cast("date").alias("reference_datetime"), *_complete(y, xs)
    )
    asks = refs.select(
        *keys,
        F.unix_date("reference_datetime").alias("day"),
        "reference_datetime",
        *[F.lit(None).cast("double").alias(f"f{i}") for i in range(m)],
    )
    first = "unbounded preceding" if trailing_days is None else f"{trailing_days} preceding"
    series = ", ".join(f"`{k}`" for k in keys)
    over = f"over (partition by {series} order by day range between {first} and 1 preceding)"
    moments = days.unionByName(asks).select(*keys, "reference_datetime", *_moments(m, over))
    return solve(moments.filter(F.col("reference_datetime").isNotNull()), len(xs), min_rows)


def predict(beta: Column, xs: list[Column]) -> Column:
    """Fitted value from a coefficient array, intercept first; a coefficient that was passed over adds nothing."""
    return reduce(
        lambda a, item: a + F.coalesce(F.element_at(beta, item[0] + 2), F.lit(0.0)) * item[1], enumerate(xs), F.element_at(beta, 1)
    )
