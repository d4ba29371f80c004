"""Positions in a whole record, for series of any size.

Rows are cut into ordered slices by Spark's range partitioner and numbered where they lie; a count
for each (series, slice) gives every slice its offset. No window runs over raw rows, so one series
may hold any share of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarncast.session import durable

#: Bits that ``monotonically_increasing_id`` keeps for the place inside a partition.
PLACE_BITS = 33


def numbered(df: DataFrame, keys: list[str], order: list[str], slices: int | None = None) -> DataFrame:
    """``df`` with ``row``: the position, from 1, of each row in the recorded order of its series.

    NULLs sort first, as a key too. Rows that tie in ``order`` are numbered in any order among
    themselves; name enough columns to settle it. A column ``row`` is replaced. An empty table gives no rows.
    """
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Where a row lies is a property of this one shuffle: keep it in a reliable checkpoint.
    cut = durable(
        df.repartitionByRange(slices, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", PLACE_BITS)
    # A slice holds whole series but for its first and last one: about one row for each series and slice.
    counts = cut.groupBy(*keys, part.alias("_slice")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    below = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(f"`{k}`").alias(f"_cut_{k}") for k in keys],
        "_slice",
        (F.coalesce(F.sum("_rows").over(below), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    )
    # Keyed by slice first: a long series is spread over its slices.
    same = [part == F.col("_slice")] + [F.col(f"`{k}`").eqNullSafe(F.col(f"`_cut_{k}`")) for k in keys]
    placed = cut.join(offsets, same)
    return placed.select(*[F.col(f"`{c}`") for c in df.columns if c != "row"], (F.col("_at") + F.col("_shift")).alias("row"))


def record_slice(df: DataFrame, keys: list[str], order: list[str], first: int, last: int, slices: int | None = None) -> DataFrame:
    """Rows ``first`` to ``last`` of each whole record, with their position ``row``."""
    return numbered(df, keys, order, slices).filter(F.col("row").between(first, last))
