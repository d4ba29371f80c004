"""Scoring only what is new: content ids of forecast groups, a log, and partition replacement."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarncast import schemas
from tarncast.plans.scoring import FAMILIES, score
from tarncast.sources.sinks import append, replace_partitions


def collapse(column: Column) -> Column:
    """Distinct values in order, as one comma-separated text."""
    return F.array_join(F.sort_array(F.collect_set(column)), ",")


def period(unit: str = "day", column: str = "datetime") -> Column:
    """First day of the scoring period a forecast date falls in."""
    return F.to_date(F.date_trunc(unit, column))


def forecast_groups(forecasts: DataFrame, unit: str = "day") -> DataFrame:
    """One row for each (model, period of forecast dates) with the issues and publications that feed it.

    Repeats are dropped before collecting, so a set holds one entry for each distinct date,
    whatever the number of forecast rows behind it.
    """
    distinct = forecasts.select(
        "model_id",
        period(unit).alias("date"),
        F.col("reference_datetime").cast("string").alias("reference_date"),
        F.col("pub_datetime").cast("string").alias("pub_date"),
    ).distinct()
    return distinct.groupBy("model_id", "date").agg(
        collapse(F.col("reference_date")).alias("reference_date"), collapse(F.col("pub_date")).alias("pub_date")
    )


def content_sums(columns: list[str]) -> list[Column]:
    """Two sums of independent 64-bit numbers of the rows; they merge in any order."""
    values = [F.struct(F.col(c).isNull(), F.col(c)) for c in columns]
    return [F.sum(F.xxhash64(F.lit(seed), *values).cast("decimal(38,0)")).alias(f"target_sum{seed}") for seed in (1, 2)]


def target_fingerprint(targets: DataFrame, unit: str = "day") -> DataFrame:
    """One fingerprint for each period of targets, over all their columns.

    The rows of a period are combined by a count and sums: nothing is collected or sorted.
    """
    return targets.groupBy(period(unit).alias("date")).agg(
        F.count(F.lit(1)).alias("target_rows"), *content_sums(sorted(targets.columns))
    )


def group_ids(forecasts: DataFrame, targets: DataFrame, unit: str = "day") -> DataFrame:
    """Groups with an id that changes when their forecasts, issues, publications or targets do; a group may have no targets."""
    content = forecasts.groupBy("model_id", period(unit).alias("date")).agg(
        F.count(F.lit(1)).alias("rows"), *[c.alias(f"sum{i}") for i, c in enumerate(content_sums(sorted(forecasts.columns)))]
    )
    groups = forecast_groups(forecasts, unit).join(content, ["model_id", "date"]).join(target_fingerprint(targets, unit), "date", "left")
    parts = ["model_id", "date", "reference_date", "pub_date", "rows", "sum0", "sum1", "target_rows", "target_sum1", "target_sum2"]
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in parts])
    return groups.withColumn("new_id", F.sha2(text, 256))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The provenance log; empty before the first run."""
    try:
        return spark.read.schema(schemas.PROVENANCE).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.PROVENANCE)


def incremental_score(
    forecasts: DataFrame,
    targets: DataFrame,
    scores_path: str,
    log_path: str,
    as_of,
    past_days: int = 365,
    extra_groups=(),
    bounded: bool = False,
    families=FAMILIES,
    unit: str = "day",
) -> int:
    """Score the groups whose id is not in the log; returns how many there were.

    ``unit`` is the period of forecast dates that is scored, logged and stored together: days, as
    a daily run wants them, or months, which keeps a small archive from turning into tiny files.

    Scores replace whole (model, date) partitions and the log is appended after them, so a run
    that dies in between is repeated without harm. The new groups are written before they are
    used, so scores and log describe the same set. Ids tell contents apart to the last bit: hand in
    stored forecasts and targets, not averages that every run computes anew in another order.
    """
    spark = forecasts.sparkSession
    today = F.lit(as_of).cast("date")
    recent = forecasts.filter(
        (F.to_date("datetime") > F.date_sub(today, past_days)) & (F.to_date("datetime") <= today)
    )
    seen = read_log(spark, log_path).select("new_id")
    pending_path = f"{scores_path.rstrip('/')}_pending"
    group_ids(recent, targets, unit).join(seen, "new_id", "left_anti").write.mode("overwrite").parquet(pending_path)
    pending = spark.read.parquet(pending_path)
    count = pending.count()
    if count == 0:
        return 0
    due = recent.withColumn("date", period(unit)).join(
        pending.select("model_id", "date"), ["model_id", "date"], "left_semi"
    )
    averaged = due.groupBy(*[c for c in due.columns if c not in ("prediction", "date")]).agg(
        F.avg("prediction").alias("prediction")
    )
    scored = score(averaged, targets, extra_groups, families=families, bounded=bounded)
    replace_partitions(scored.withColumn("date", period(unit)), scores_path, ["model_id", "date"])
    entries = pending.select(today.alias("date"), "new_id", "model_id", "reference_date", "pub_date")
    append(entries, log_path)
    return count
