"""Streaming roll-ups of an appended sensor feed.

Each micro-batch writes its changed rows below its own batch number, replacing them if the
batch is retried, and the table is read as the newest version of every key. Nothing passes
through the driver, and a lost executor or a restarted query repeats a batch, not a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tarncast.streaming.archive import merge_batch


def read_feed(spark: SparkSession, path: str, schema: StructType, pattern: str = "*.parquet", files: int | None = None):
    """Appended Parquet files as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path)


def daily_stream(feed: DataFrame, value: str, keys=("site_id",), time="datetime", lateness="1 day") -> DataFrame:
    """Tumbling one-day means; a late row updates its day until the watermark has passed it.

    Event time is a timestamp and days are UTC days: run with ``spark.sql.session.timeZone=UTC``.
    """
    return (
        feed.withWatermark(time, lateness)
        .groupBy(*keys, F.window(time, "1 day").alias("day"))
        .agg(F.avg(value).alias(value), F.count(value).alias("readings"))
        .select(*keys, F.to_date("day.start").alias("datetime"), value, "readings")
    )


def latest_stream(feed: DataFrame, value: str, keys=("site_id",), time="datetime") -> DataFrame:
    """Latest known value of each series: the state a persistence forecast starts from."""
    return (
        feed.filter(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(F.max_by(value, F.struct(time, value)).alias("last_value"), F.max(time).alias("last_time"))
    )


def run_updates(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived, writing changed rows of each batch to ``table``."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return (
        stream.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_append(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived, appending only the days the watermark has closed."""
    return (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(table)
    )


def read_updates(spark: SparkSession, table: str, keys: list[str]) -> DataFrame:
    """Newest version of every key written by ``run_updates``."""
    rows = spark.read.parquet(table)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = F.max_by(F.struct(*values), "batch").alias("newest")
    return rows.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"newest.{v}").alias(v) for v in values])


def score_arrivals(
    arrivals: DataFrame, checkpoint: str, score_batch: Callable[[DataFrame], object], archive: str, unit: str = "day"
) -> StreamingQuery:
    """Run the incremental scorer on every batch of newly arrived forecasts.

    The scorer replaces the stored scores of a group (model and ``unit`` of forecast dates), so it is given all archived
    forecasts of the groups that the batch touches: a group may arrive in any number of batches. Only the folders of
    these groups are read and rewritten; see ``archive``.
    """

    def on_batch(batch: DataFrame, number: int) -> None:
        due = merge_batch(batch, number, archive, unit)
        if due is not None:
            score_batch(due)

    return (
        arrivals.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
