"""Exact ranks inside groups of any size.

Equal values of a group collapse to one row with a count. Groups are cut into ordered slices by
Spark's range partitioner, ranked slice by slice and shifted by the number of rows in the slices
below, so one group may hold any share of the table. Every group takes this path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarncast.session import durable


def ranked(df: DataFrame, keys: list[str], value: str, carry: list[str] = ()) -> DataFrame:
    """Rank ``value`` inside ``keys``: keys, carried columns, value, copies, rank_lo, rank_hi, n, center.

    ``carry`` columns must be constant inside a group. A row stands for ``copies`` equal values;
    ``center`` is the mean of the group.
    """
    return rank_in_slices(df.select(*keys, *carry, value), keys, value, list(carry))


def rank_in_slices(rows: DataFrame, keys: list[str], value: str, carry: list[str], gaps: bool = False) -> DataFrame:
    """Ranks over slices of the groups; see ``ranked``.

    With ``gaps``, missing values stay, as one row of a group, and ``missing`` counts them in each row of the
    group; where there are any, the group's other figures mean nothing.
    """
    if not gaps:
        rows = rows.filter(F.col(value).isNotNull())
    # Equal values collapse first, so a heavily repeated value is one row, not one long slice.
    values = rows.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("copies"), *[F.max(c).alias(c) for c in carry]
    )
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The slice number is a property of this one shuffle: keep it in a reliable checkpoint.
    cut = durable(
        values.repartitionByRange(slices, *keys, value).withColumn("slice", F.spark_partition_id())
    )
    per_slice = cut.groupBy(*keys, "slice").agg(
        F.sum("copies").alias("slice_rows"),
        F.sum(F.col(value) * F.col("copies")).alias("slice_sum"),
        F.sum(F.when(F.col(value).isNull(), F.col("copies")).otherwise(0)).alias("slice_missing"),
    )
    group = W.partitionBy(*keys)
    below = group.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_slice.select(
        *[F.col(k).alias(f"cut_{k}") for k in keys],
        F.col("slice").alias("cut_slice"),
        F.coalesce(F.sum("slice_rows").over(below), F.lit(0)).alias("below"),
        F.sum("slice_rows").over(group).alias("n"),
        F.sum("slice_missing").over(group).alias("missing"),
        (F.sum("slice_sum").over(group) / F.sum("slice_rows").over(group)).alias("center"),
    )
    same = [F.col(k).eqNullSafe(F.col(f"cut_{k}")) for k in keys] + [F.col("slice") == F.col("cut_slice")]
    running = W.partitionBy(*keys, "slice").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        cut.join(offsets, same)
        .withColumn("rank_hi", F.col("below") + F.sum("copies").over(running))
        .withColumn("rank_lo", F.col("rank_hi") - F.col("copies") + 1)
        .select(*keys, *carry, value, "copies", "rank_lo", "n", "rank_hi", "center", *(["missing"] if gaps else []))
    )


def quantile(value: str, p: float) -> Column:
    """Interpolated (type 7) quantile over ranked rows, as a plain mergeable aggregate."""
    position = (F.col("n") - 1) * F.lit(p)
    low = F.floor(position) + 1
    high = F.least(low + 1, F.col("n"))
    fraction = position - F.floor(position)

    def at(rank):
        return F.sum(F.when(rank.between(F.col("rank_lo"), F.col("rank_hi")), F.col(value)))

    # low, high and fraction are constant inside a group, so max() only picks them up.
    return at(low) * (1 - F.max(fraction)) + at(high) * F.max(fraction)


def weighted_mean(value: str) -> Column:
    return F.sum(F.col(value) * F.col("copies")) / F.sum("copies")
