"""Streaming roll-ups and incremental scoring."""

from pyspark.sql import functions as F

from tarncast import fixtures as fx
from tarncast.catalog.registry import query
from tarncast.catalog.roles import climatology_ctes, persistence_ctes, r, with_
from tarncast.operators.grid import issue_dates
from tarncast.plans import baselines, provenance
from tarncast.plans.common import standard_format
from tarncast.session import work_path
from tarncast.sources.sinks import write_table
from tarncast.streaming import feeds, walks


def sensor_feed(spark, folder):
    schema = fx.table(spark, folder, "events").schema
    events = feeds.read_feed(spark, folder, schema, "events.parquet")
    return events.select(
        F.col("event_type").alias("site_id"), F.col("ts").cast("timestamp").alias("datetime"), F.col("value").alias("fdom")
    )


@query(with_("sensor", f"""select site_id, cast(datetime as date) as datetime, {r('avg(fdom)', 'fdom')}, count(fdom) as readings
    from sensor group by 1, 2"""))
def stream_daily(spark, folder):
    """Every day with its latest mean, open days included."""
    table, state = work_path(spark, "daily"), work_path(spark, "daily-state")
    stream = feeds.daily_stream(sensor_feed(spark, folder), "fdom")
    feeds.run_updates(stream, table, state).awaitTermination()
    return feeds.read_updates(spark, table, ["site_id", "datetime"])


@query(with_("sensor", f"""select site_id, cast(datetime as date) as datetime, {r('avg(fdom)', 'fdom')}, count(fdom) as readings
    from sensor where cast(datetime as date) + interval 1 day <= (select max(ts) - interval 1 day from events) group by 1, 2"""))
def stream_closed_days(spark, folder):
    """Only the days the watermark has closed."""
    table, state = work_path(spark, "closed"), work_path(spark, "closed-state")
    stream = feeds.daily_stream(sensor_feed(spark, folder), "fdom")
    feeds.run_append(stream, table, state).awaitTermination()
    return spark.read.parquet(table)


@query(with_("sensor", """select site_id, arg_max(fdom, (datetime, fdom)) as last_value, max(datetime) as last_time
    from sensor where fdom is not null group by 1"""))
def stream_latest(spark, folder):
    table, state = work_path(spark, "latest"), work_path(spark, "latest-state")
    stream = feeds.latest_stream(sensor_feed(spark, folder), "fdom")
    feeds.run_updates(stream, table, state).awaitTermination()
    latest = feeds.read_updates(spark, table, ["site_id"])
    return latest.withColumn("last_time", F.col("last_time").cast("timestamp_ntz"))


@query(with_("sensor", f"""select site_id, datetime, {r('fdom', 'mu')}, {r('avg(change * change) over w', 'step_variance')}, count(change) over w as changes, false as ended
    from (select *, case when datetime - lag(datetime) over (partition by site_id order by datetime) = 1
          then fdom - lag(fdom) over (partition by site_id order by datetime) end as change
        from (select site_id, cast(datetime as date) as datetime, avg(fdom) as fdom from sensor
          where cast(datetime as date) + interval 1 day <= (select max(ts) - interval 1 day from events)
          group by 1, 2 having avg(fdom) is not null))
    window w as (partition by site_id order by datetime)"""))
def stream_walk(spark, folder):
    """The random walk of each site after every day that the watermark has closed, from keyed state."""
    closed, table = work_path(spark, "closed"), work_path(spark, "walk")
    feeds.run_append(feeds.daily_stream(sensor_feed(spark, folder), "fdom"), closed, work_path(spark, "closed-state")).awaitTermination()
    days = feeds.read_feed(spark, closed, spark.read.parquet(closed).schema)
    feeds.run_append(walks.walk_stream(days, "fdom"), table, work_path(spark, "walk-state")).awaitTermination()
    return spark.read.parquet(table)


def stored_targets(spark, folder):
    """The targets as a file. An average that is computed anew may differ in its last bits, and then so does its fingerprint."""
    path = work_path(spark, "targets")
    write_table(fx.targets(spark, folder), path)
    return spark.read.parquet(path)


def published_forecasts(targets):
    """Both baselines in the shared long table, each published on its day of issue."""
    refs = issue_dates(targets, "day")

    def rows(model, forecast):
        return standard_format(baselines.normal_rows(forecast), model, "normal", fx.VARIABLE)

    both = rows("Persistence", baselines.persistence(targets, refs)).unionByName(
        rows("DOY", baselines.climatology(targets, refs))
    )
    return both.withColumn("pub_datetime", F.col("reference_datetime"))


AS_OF, LOOK_BACK = "2001-12-31", 10000

INCREMENTAL = persistence_ctes("refs_day") + climatology_ctes("refs_day") + [
    (
        "forecast_days",
        """select 'Persistence' as model_id, site_id, reference_datetime, datetime, mu from persistence
        union all select 'DOY', site_id, reference_datetime, datetime, mu from climatology""",
    ),
    (
        "groups_",
        "select distinct model_id, date_trunc('month', datetime) as month from forecast_days",
    ),
    (
        "rows_",
        """select f.model_id, count(*) as forecasts, count(t.observation) as observed from forecast_days f
        join groups_ g on g.model_id = f.model_id and g.month = date_trunc('month', f.datetime)
        left join targets t on t.site_id = f.site_id and t.datetime = f.datetime group by 1""",
    ),
]


@query(with_("refs_day targets", """select model_id, forecasts, observed, (select count(*) from groups_ x where x.model_id = r.model_id) as groups,
    0::bigint as second_run from rows_ r""", INCREMENTAL))
def incremental_score(spark, folder):
    """Score everything once; a second run over the same tables must find nothing to do."""
    scores_path, log_path = work_path(spark, "scores"), work_path(spark, "log")
    stored = work_path(spark, "published")
    targets = stored_targets(spark, folder)
    write_table(published_forecasts(targets), stored)
    forecasts = spark.read.parquet(stored)

    def run():
        return provenance.incremental_score(
            forecasts, targets, scores_path, log_path, AS_OF, LOOK_BACK, families=["normal"], unit="month"
        )

    run()
    second = run()
    scored = spark.read.parquet(scores_path).groupBy("model_id").agg(
        F.count(F.lit(1)).alias("forecasts"), F.count("observation").alias("observed")
    )
    groups = provenance.read_log(spark, log_path).groupBy("model_id").agg(F.count(F.lit(1)).alias("groups"))
    return scored.join(groups, "model_id").withColumn("second_run", F.lit(second).cast("long"))


@query(with_("refs_day targets", "select model_id, forecasts, observed from rows_", INCREMENTAL))
def stream_scores(spark, folder):
    """Forecasts scored as they arrive, in micro-batches of files."""
    scores_path, log_path, state = (work_path(spark, n) for n in ("scores", "log", "scoring-state"))
    arrived = work_path(spark, "arrivals")
    targets = stored_targets(spark, folder)
    # One file for each model, site and parameter: the sites and parameters of a group come in different batches.
    published = published_forecasts(targets).withColumns({"from_site": F.col("site_id"), "part": F.col("parameter")})
    published.repartition("model_id", "from_site", "part").write.partitionBy("model_id", "from_site", "part").parquet(arrived)
    schema = spark.read.parquet(arrived).schema
    stream = feeds.read_feed(spark, arrived, schema, files=8).drop("from_site", "part")

    def score_batch(batch):
        provenance.incremental_score(
            batch, targets, scores_path, log_path, AS_OF, LOOK_BACK, families=["normal"], unit="month"
        )

    feeds.score_arrivals(stream, state, score_batch, work_path(spark, "archive"), "month").awaitTermination()
    return spark.read.parquet(scores_path).groupBy("model_id").agg(
        F.count(F.lit(1)).alias("forecasts"), F.count("observation").alias("observed")
    )
