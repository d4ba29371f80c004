"""Readers. All are lazy: filters and columns reach the files through Catalyst."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType


def open_dataset(
    spark: SparkSession, path: str, where: list[Column] = (), columns: list[str] | None = None, base: str | None = None
) -> DataFrame:
    """Parquet dataset, optionally one sub-tree of a partitioned one.

    ``base`` names the root, so key=value folders above ``path`` still become columns.
    """
    reader = spark.read.option("basePath", base) if base else spark.read
    df = reduce(lambda d, cond: d.filter(cond), where, reader.parquet(path))
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path, schema: StructType, missing: str = "NA") -> DataFrame:
    """Delimited text with a header and a declared schema.

    ``path`` may be a file, a folder, a glob or a list of them, compressed or not: many files
    are one scan, not a union of reads.
    """
    return spark.read.schema(schema).option("header", True).option("nullValue", missing).csv(path)


def read_csv_dataset(
    spark: SparkSession, path, schema: StructType, where: list[Column] = (), missing: str = "NA"
) -> DataFrame:
    """Delimited dataset with declared names: the header line is skipped, whatever it says."""
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("nullValue", missing)
        .csv(path)
    )
    return reduce(lambda d, cond: d.filter(cond), where, df)


def with_file(df: DataFrame, name: str = "file") -> DataFrame:
    """The file each row came from."""
    return df.withColumn(name, F.input_file_name())


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).distinct()


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, missing values, mean and extremes of numeric columns, one row each.

    All columns are profiled in one pass over the source.
    """
    stats = []
    for c in columns:
        stats += [
            F.count(c).alias(f"{c}#rows"),
            F.sum(F.col(c).isNull().cast("long")).alias(f"{c}#missing"),
            F.avg(c).alias(f"{c}#mean"),
            F.min(c).cast("double").alias(f"{c}#low"),
            F.max(c).cast("double").alias(f"{c}#high"),
        ]
    fields = ("rows", "missing", "mean", "low", "high")
    entries = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}#{f}`").alias(f) for f in fields]) for c in columns
    ]
    return df.agg(*stats).select(F.inline(F.array(*entries)))


# --- mergeable profiles ------------------------------------------------------------------------

SKETCH = ["rows", "missing", "total", "low", "high", "values", "members"]
QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def sketch(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """Counts, extremes and sketches of columns, one row each (and for each group ``by``): sketches can be stored and merged.

    All columns go through one pass. ``values`` is a quantile sketch of a numeric column (NULL for others), ``members`` a sketch of
    its distinct values. NaN counts as missing. Dates, texts and flags have distinct counts only.
    """
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)}
    stats, entries = [], []
    for i, c in enumerate(columns):
        value = F.col(f"`{c}`")
        known = value
        if c in numeric:
            number = value.cast("double")
            known = F.when(~F.isnan(number), number + F.lit(0.0))  # 0 and -0 are one value
        figures = {"rows": F.count(F.lit(1)), "missing": F.count(F.lit(1)) - F.count(known), "members": F.hll_sketch_agg(known.cast("string"))}
        if c in numeric:
            figures |= {"total": F.sum(known), "low": F.min(known), "high": F.max(known), "values": F.kll_sketch_agg_double(known)}
        stats += [figure.alias(f"{i}#{name}") for name, figure in figures.items()]
        blank = {"total": "double", "low": "double", "high": "double", "values": "binary"}
        fields = [F.col(f"`{i}#{f}`").alias(f) if f in figures else F.lit(None).cast(blank[f]).alias(f) for f in SKETCH]
        entries.append(F.struct(F.lit(c).alias("column"), *fields))
    return df.groupBy(*by).agg(*stats).select(*by, F.inline(F.array(*entries)))


def merge_sketches(sketches: DataFrame, by: list[str] = ()) -> DataFrame:
    """Sketches of parts of a source (files, days, sites) into those of the whole."""
    return sketches.groupBy(*by, "column").agg(
        *[F.sum(c).alias(c) for c in ("rows", "missing", "total")],
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.kll_merge_agg_double("values").alias("values"),
        F.hll_union_agg("members").alias("members"),
    )


def read_sketches(sketches: DataFrame) -> DataFrame:
    """Mean, extremes, quartiles and number of distinct values of sketched columns.

    A quartile is off by about 1.5% of the ranks, a distinct count by about 2%; small columns are exact.
    A column without known values has NULL figures and no distinct value.
    """
    known = F.col("rows") - F.col("missing")
    numeric = (known > 0) & F.col("low").isNotNull()
    quartiles = [F.when(numeric, F.kll_sketch_get_quantile_double("values", F.lit(p))).alias(name) for name, p in QUARTILES.items()]
    rest = [c for c in sketches.columns if c not in SKETCH]
    return sketches.select(
        *rest, "rows", "missing", (F.col("total") / F.when(known > 0, known)).alias("mean"), "low", *quartiles, "high",
        F.when(known > 0, F.hll_sketch_estimate("members")).otherwise(F.lit(0)).cast("bigint").alias("distinct_values"),
    )


def summary(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """Profile with quartiles and distinct counts, in one pass."""
    return read_sketches(sketch(df, columns, by))


def preview(df: DataFrame, order: list[str], rows: int = 6) -> DataFrame:
    """The first rows in a given order; every task keeps no more than ``rows``."""
    return df.orderBy(*order).limit(rows)
