"""Special functions that Spark lacks, as column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart's rational approximation of the normal tail, highest power first.
TAIL_NUMERATOR = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
TAIL_DENOMINATOR = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
TAIL_SWITCH = 7.07106781186547
# Beyond it x + 1/(x + 2/(x + 3/(x + 4/(x + 0.65)))), as a ratio of polynomials, and where exp(-x * x / 2) is 0.
FAR_NUMERATOR = (1.0, 0.65, 10.0, 3.9, 15.0, 1.95)
FAR_DENOMINATOR = (1.0, 0.65, 9.0, 3.25, 8.0)
FAR = 40.0
SQRT_2PI = 2.506628274631

# Lanczos coefficients for g = 7.
LANCZOS_G = 7.0
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
    -176.61502916214059, 12.507343278686905, -0.13857109526572012,
    9.9843695780195716e-6, 1.5056327351493116e-7,
)

# Standard normal quantiles of the central 95% and 90% intervals.
Z_975 = 1.959963984540054
Z_95 = 1.644853626951472


def horner(x: Column, coefficients) -> Column:
    return reduce(lambda acc, c: acc * x + c, coefficients[1:], F.lit(coefficients[0]))


def normal_pdf(z: Column) -> Column:
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def normal_cdf(z: Column) -> Column:
    """Double-precision normal distribution function."""
    a = F.abs(z)
    e = F.exp(-a * a / 2)
    far = F.least(a, F.lit(FAR))
    tail = F.when(a < TAIL_SWITCH, e * horner(a, TAIL_NUMERATOR) / horner(a, TAIL_DENOMINATOR)).otherwise(
        e * horner(far, FAR_DENOMINATOR) / (horner(far, FAR_NUMERATOR) * SQRT_2PI)
    )
    return F.when(z > 0, 1 - tail).otherwise(tail)


def log_gamma(x: Column) -> Column:
    """Log of the gamma function for positive arguments."""
    s = x - 1
    series = reduce(
        lambda acc, item: acc + item[1] / (s + item[0]),
        enumerate(LANCZOS[1:], start=1),
        F.lit(LANCZOS[0]),
    )
    t = s + LANCZOS_G + 0.5
    return 0.5 * math.log(2 * math.pi) + (s + 0.5) * F.ln(t) - t + F.ln(series)


def log_beta(a: Column, b: Column) -> Column:
    return log_gamma(a) + log_gamma(b) - log_gamma(a + b)
