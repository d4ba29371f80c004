"""Long and wide forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def widen(df: DataFrame, ids: list[str], names: str, value: str, into: list) -> DataFrame:
    """Long to wide with a given list of names, so no pass is spent on finding them."""
    return df.groupBy(*ids).pivot(names, into).agg(F.first(value, ignorenulls=True))


def lengthen(df: DataFrame, ids: list[str], values: list[str], name="name", value="value") -> DataFrame:
    """Wide to long."""
    return df.unpivot(ids, values, name, value)


def transpose(df: DataFrame, ids: list[str], values: list[str], across: str, into: list[str]) -> DataFrame:
    """Statistics in rows, the values of ``across`` in columns; all as text."""
    texts = df.select(*ids, across, *[F.col(v).cast("string").alias(v) for v in values])
    return widen(lengthen(texts, [*ids, across], values, "statistic", "text"), [*ids, "statistic"], across, "text", into)


def split_label(df: DataFrame, column: str, into: list[str], sep: str) -> DataFrame:
    """One label into several columns."""
    pieces = F.split(F.col(column), sep)
    return df.withColumns({name: F.get(pieces, i) for i, name in enumerate(into)})


def parameters_wide(forecast: DataFrame, ids: list[str], parameters=("mu", "sigma")) -> DataFrame:
    """One row for each forecast with its distribution parameters as columns."""
    return forecast.groupBy(*ids).agg(
        *[F.max(F.when(F.col("parameter") == p, F.col("prediction"))).alias(p) for p in parameters]
    )


def explode_members(df: DataFrame, draws: str, ids: list[str]) -> DataFrame:
    """List column of draws to one row for each member, numbered from 1 as text."""
    return df.select(*ids, F.posexplode(draws).alias("position", "prediction")).select(
        *ids, (F.col("position") + 1).cast("string").alias("parameter"), F.col("prediction").cast("double")
    )


def models_wide(df: DataFrame, ids: list[str], models: list[str], values: list[str]) -> DataFrame:
    """One column for each (statistic, model): the n-way full join of model tables in one pass."""
    return df.groupBy(*ids).agg(
        *[
            F.max(F.when(F.col("model_id") == m, F.col(v))).alias(f"{v}_{m}")
            for m in models
            for v in values
        ]
    )


def recode(column: Column, mapping: dict, default: Column | None = None) -> Column:
    """Replace listed values; others stay, or take ``default``."""
    out = None
    for old, new in mapping.items():
        out = F.when(column == old, new) if out is None else out.when(column == old, new)
    return out.otherwise(column if default is None else default)


def present(df: DataFrame, names) -> list[str]:
    """The listed columns that exist, in the listed order."""
    return [n for n in names if n in df.columns]


def summarize_columns(df: DataFrame, keys: list[str], columns: list[str], how=F.avg) -> DataFrame:
    """One aggregate over many columns."""
    return df.groupBy(*keys).agg(*[how(c).alias(c) for c in columns])


def by_position(df: DataFrame, positions: list[int]) -> DataFrame:
    """Columns by 1-based position."""
    return df.select(*[df.columns[i - 1] for i in positions])
