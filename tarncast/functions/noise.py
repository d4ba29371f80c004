"""Reproducible random draws.

A draw is a pure function of a text key, so a lost task recomputes the same value, the
partition count does not matter, and any SQL engine with md5 can reproduce it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def draw_key(*parts) -> Column:
    """Join key parts (columns or literals) with ``|``."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def uniform(key: Column) -> Column:
    """Uniform draw in (0, 1) from the first 32 bits of the key's md5."""
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") + 0.5) / TWO_32


def standard_normal(key: Column) -> Column:
    """Standard normal draw by the Box-Muller transform of two uniforms."""
    radius = F.sqrt(-2 * F.ln(uniform(F.concat(key, F.lit("A")))))
    return radius * F.cos(2 * math.pi * uniform(F.concat(key, F.lit("B"))))


#: A prime below 2**31, so that a product of two remainders fits a long.
PRIME = 2147483647


def mixed(key: Column) -> Column:
    """Uniform draw with mean 0 and variance 1 from a whole number, by two quadratic steps: cheap enough for large fixtures."""
    for _ in range(2):
        key = (key % PRIME * (key % PRIME + 12345)) % PRIME
    return (key / PRIME - 0.5) * math.sqrt(12)


def uniform_index(key: Column, size: Column) -> Column:
    """Uniform draw from 1..size."""
    return (F.floor(uniform(key) * size) + 1).cast("int")
