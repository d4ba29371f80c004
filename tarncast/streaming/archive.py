"""An archive of arrived forecasts, in folders by model and period, that a micro-batch reads and rewrites only in part.

A folder (model, period) holds two slots. The live one is the slot with the highest version; a batch writes the live
rows and its own into the other slot, under its batch number as version. So a folder is one merged set of rows, never a
pile of small batches, and at most two copies of a row are stored. A batch that dies half-way leaves the live slots
as they were, and when it is repeated it takes only versions below its own: nothing is lost or doubled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarncast.sources.sinks import replace_partitions

FOLDER = ["of_model", "of_period"]
PLACE = "of_model string, of_period date, slot int"


def with_folder(forecasts: DataFrame, unit: str) -> DataFrame:
    """The folder of each row; a missing and an empty model share one, and rows keep their own columns."""
    model = F.col("model_id").cast("string")
    return forecasts.withColumns(
        {"of_model": F.when(model != "", model), "of_period": F.to_date(F.date_trunc(unit, "datetime"))}
    )


def open_archive(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """Both slots of every folder, with ``version``; None before the first batch. ``schema`` is that of the forecasts."""
    whole = reduce(lambda s, field: s.add(field), StructType.fromDDL(f"version bigint, {PLACE}").fields, StructType(list(schema.fields)))
    try:
        return spark.read.schema(whole).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def inside(folders: list[tuple]) -> Column:
    """Rows of these folders, as a condition on partition columns alone: other folders are not opened."""
    by_model: dict = {}
    for model, period in folders:
        by_model.setdefault(model, []).append(period)
    chosen = F.lit(False)
    for model, periods in by_model.items():
        known = [p for p in periods if p is not None]
        period = F.col("of_period").isin(known) if known else F.lit(False)
        if len(known) < len(periods):
            period = period | F.col("of_period").isNull()
        chosen = chosen | (F.col("of_model").eqNullSafe(F.lit(model)) & period)
    return chosen


def live_folders(archive: DataFrame, touched: list[tuple], before: int) -> dict[tuple, int]:
    """The live slot of each touched folder, among versions below ``before``; one column of these folders is read."""
    slots = archive.filter(inside(touched) & (F.col("version") < before))
    live = slots.groupBy(*FOLDER).agg(F.max_by("slot", "version").alias("slot"))
    return {(row.of_model, row.of_period): row.slot for row in live.collect()}


def in_slot(live: dict[tuple, int], slot: int) -> Column:
    return inside([folder for folder, own in live.items() if own == slot])


def live_rows(archive: DataFrame, live: dict[tuple, int], before: int) -> DataFrame:
    """The rows of the live slots, with their folder."""
    chosen = reduce(lambda a, b: a | b, [in_slot(live, slot) & (F.col("slot") == slot) for slot in (0, 1)])
    return archive.filter(chosen & (F.col("version") < before)).drop("version", "slot")


def merge_batch(batch: DataFrame, number: int, path: str, unit: str = "day") -> DataFrame | None:
    """Add a batch to the archive; returns all archived forecasts of the folders that it touches, None for an empty batch.

    The names of the touched folders pass through the driver, as they do whenever it lists files; rows do not.
    """
    spark = batch.sparkSession
    rows = with_folder(batch, unit)
    touched = [tuple(row) for row in rows.select(*FOLDER).distinct().collect()]
    if not touched:
        return None
    archive = open_archive(spark, path, batch.schema)
    live = {} if archive is None else live_folders(archive, touched, number)
    if live:
        rows = live_rows(archive, live, number).unionByName(rows)
    written = rows.withColumns({"version": F.lit(number).cast("bigint"), "slot": F.when(in_slot(live, 0), 1).otherwise(0)})
    replace_partitions(written, path, [*FOLDER, "slot"])
    stored = open_archive(spark, path, batch.schema)
    return stored.filter(inside(touched) & (F.col("version") == number)).select(*batch.columns)
