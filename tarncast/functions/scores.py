"""CRPS and logarithmic score of the parametric families, as column expressions.

Every builder takes the observation and the parameters as columns. Parameters outside their
range give NULL: a forecast that cannot be scored is kept, unscored.

What a score repeats many times may be handed in as columns of their own (``z``, never NULL, and normal
probabilities): written out in full it makes methods that the JVM does not compile.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarncast.functions.special import log_beta, log_gamma, normal_cdf, normal_pdf

INFINITY = float("inf")


def crps_normal(y: Column, mu: Column, sigma: Column, z: Column | None = None, below: Column | None = None) -> Column:
    z = (y - mu) / sigma if z is None else z
    below = normal_cdf(z) if below is None else below
    value = sigma * (z * (2 * below - 1) + 2 * normal_pdf(z) - 1 / math.sqrt(math.pi))
    return F.when((sigma > 0) & y.isNotNull() & mu.isNotNull(), value)


def logs_normal(y: Column, mu: Column, sigma: Column, z: Column | None = None) -> Column:
    z = (y - mu) / sigma if z is None else z
    value = F.ln(sigma) + 0.5 * math.log(2 * math.pi) + z * z / 2
    return F.when((sigma > 0) & y.isNotNull() & mu.isNotNull(), value)


def crps_lognormal(
    y: Column, mu: Column, sigma: Column, below: Column | None = None, shifted: Column | None = None, half: Column | None = None
) -> Column:
    z = (F.ln(y) - mu) / sigma
    below = normal_cdf(z) if below is None else below
    shifted = normal_cdf(z - sigma) if shifted is None else shifted
    half = normal_cdf(sigma / math.sqrt(2)) if half is None else half
    spread = F.when(y > 0, shifted).otherwise(0.0) + half - 1
    return F.when(sigma > 0, y * (2 * F.when(y > 0, below).otherwise(0.0) - 1) - 2 * F.exp(mu + sigma * sigma / 2) * spread)


def logs_lognormal(y: Column, mu: Column, sigma: Column, z: Column | None = None) -> Column:
    return F.when(sigma > 0, F.when(y > 0, logs_normal(F.ln(y), mu, sigma, z) + F.ln(y)).otherwise(INFINITY))


def crps_logistic(y: Column, location: Column, scale: Column, z: Column | None = None) -> Column:
    a = F.abs((y - location) / scale if z is None else z)
    return F.when((scale > 0) & y.isNotNull() & location.isNotNull(), scale * (a + 2 * F.log1p(F.exp(-a)) - 1))


def logs_logistic(y: Column, location: Column, scale: Column, z: Column | None = None) -> Column:
    a = F.abs((y - location) / scale if z is None else z)
    return F.when((scale > 0) & y.isNotNull() & location.isNotNull(), F.ln(scale) + a + 2 * F.log1p(F.exp(-a)))


def crps_exponential(y: Column, rate: Column) -> Column:
    below = F.when(y > 0, 1 - F.exp(-rate * y)).otherwise(0.0)
    return F.when(rate > 0, F.abs(y) - (2 * below - 0.5) / rate)


def logs_exponential(y: Column, rate: Column) -> Column:
    return F.when(rate > 0, F.when(y >= 0, rate * y - F.ln(rate)).otherwise(INFINITY))


def crps_uniform(y: Column, low: Column, high: Column) -> Column:
    w = (y - low) / (high - low)
    inside = F.least(F.greatest(w, F.lit(0.0)), F.lit(1.0))
    return F.when(high > low, (high - low) * (F.abs(w - inside) + inside * inside - inside + 1 / 3))


def logs_uniform(y: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, F.when(y.between(low, high), F.ln(high - low)).otherwise(INFINITY))


def crps_bernoulli(y: Column, prob: Column) -> Column:
    return F.when(prob.between(0, 1) & y.isin(0.0, 1.0), (y - prob) * (y - prob))


def logs_bernoulli(y: Column, prob: Column) -> Column:
    hit = F.when(y == 1, prob).otherwise(1 - prob)
    score = F.when(hit > 0, -F.ln(hit)).otherwise(INFINITY)
    return F.when(prob.between(0, 1), F.when(y.isin(0.0, 1.0), score).otherwise(INFINITY))


def logs_poisson(y: Column, rate: Column) -> Column:
    mass = rate - y * F.ln(rate) + log_gamma(y + 1)
    return F.when((rate > 0) & y.isNotNull(), F.when((y >= 0) & (y == F.floor(y)), mass).otherwise(INFINITY))


def logs_gamma(y: Column, shape: Column, rate: Column) -> Column:
    density = shape * F.ln(rate) + (shape - 1) * F.ln(y) - rate * y - log_gamma(shape)
    return F.when((shape > 0) & (rate > 0) & y.isNotNull(), F.when(y > 0, -density).otherwise(INFINITY))


def logs_beta(y: Column, a: Column, b: Column) -> Column:
    density = (a - 1) * F.ln(y) + (b - 1) * F.ln(1 - y) - log_beta(a, b)
    return F.when((a > 0) & (b > 0) & y.isNotNull(), F.when((y > 0) & (y < 1), -density).otherwise(INFINITY))
