"""Registration of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: From here on a settled value keeps six significant digits, and beyond the second bound it is that bound.
LARGE, BEYOND = 1e4, 1e15


def query(sql: str | None = None, digits: int = 6, large: bool = False):
    """Register a function of (spark, folder); floats of the result are settled to ``digits`` decimals.

    With ``large``, values of 10,000 or more to six significant digits: forecasts drawn from a fit on few days may diverge.
    """

    def register(run):
        name = run.__name__

        def settled(spark, folder):
            return settle(run(spark, folder), digits, large)

        QUERIES[name] = settled
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def settle(df: DataFrame, digits: int, large: bool = False) -> DataFrame:
    """Round floats away from binary ties; the SQL twins do the same with ``r`` and ``big``."""

    def settled(name):
        value = F.col(f"`{name}`")
        if not large:
            return F.round(value + 1e-9, digits) + 0.0
        value = F.greatest(F.least(value, F.lit(BEYOND)), F.lit(-BEYOND))
        scale = F.when(F.abs(value) < LARGE, 1.0).otherwise(F.pow(F.lit(10.0), F.floor(F.log10(F.abs(value))) - 2))
        return F.when(F.col(f"`{name}`").isNotNull(), F.round(value / scale + 1e-9, digits) * scale + 0.0)

    return df.select(*[settled(name).alias(name) if kind in ("double", "float") else F.col(f"`{name}`") for name, kind in df.dtypes])
