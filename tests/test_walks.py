import datetime as dt
import math
import random

from pyspark.sql import functions as F

from tarncast.plans import baselines
from tarncast.streaming import feeds, walks

SCHEMA = "site_id string, datetime timestamp, fdom double"
START = dt.datetime(2024, 1, 1)


def arrivals():
    """Four files of ten days each: two sites, a site that falls silent, missing values and days, a file's end mixed into the next."""
    pick, files = random.Random(8), []
    for file in range(4):
        rows = []
        for day in range(10 * file, 10 * file + 10):
            for site in ("a", "b", "quiet"):
                if day in (4, 17, 23) and site == "b" or site == "quiet" and 8 < day < 31:
                    continue
                for hour in (1, 9, 20):
                    value = None if site == "a" and day == 6 else pick.gauss(10, 3)
                    rows.append((site, START + dt.timedelta(days=day, hours=hour), value))
        files.append(rows)
    late = (files[1][0][0], files[1][0][1], 500.0)  # of a day closed long before the fourth file
    return files, late


def run(spark, files, folder, **options):
    """One run of both streams for each file, as if they had been stopped and started in between."""
    feed, closed, table = (str(folder / name) for name in ("feed", "closed", "table"))
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("append").parquet(feed)
        daily = feeds.daily_stream(feeds.read_feed(spark, feed, spark.read.parquet(feed).schema), "fdom")
        feeds.run_append(daily, closed, str(folder / "closed-state")).awaitTermination()
        days = feeds.read_feed(spark, closed, daily.schema)
        feeds.run_append(walks.walk_stream(days, "fdom", **options), table, str(folder / "state")).awaitTermination()
    return spark.read.parquet(table)


def closed_targets(spark, files):
    """Daily means of the days that are closed when all files are read."""
    readings = spark.createDataFrame([row for rows in files for row in rows], SCHEMA)
    last = max(row[1] for rows in files for row in rows) - dt.timedelta(days=1)
    daily = readings.groupBy("site_id", F.to_date("datetime").alias("datetime")).agg(F.avg("fdom").alias("observation"))
    return daily.filter(F.date_add("datetime", 1).cast("timestamp") <= F.lit(last))


def test_equals_persistence_and_drops_late_rows(spark, tmp_path):
    files, late = arrivals()
    got = run(spark, [*files[:3], [*files[3], late]], tmp_path)
    targets = closed_targets(spark, files)
    known = targets.filter("observation is not null")
    assert sorted((row.site_id, row.datetime) for row in got.collect()) == sorted((row.site_id, row.datetime) for row in known.collect())
    refs = known.select("site_id", F.date_add("datetime", 1).alias("reference_datetime"))
    wanted = baselines.persistence(targets, refs, horizon=5)
    forecast = walks.walk_forecast(got, horizon=5)
    assert forecast.columns == wanted.columns

    def rows(df):
        return {tuple(row)[:3]: (row.mu, row.sigma) for row in df.collect()}

    one, two = rows(forecast), rows(wanted)
    assert one.keys() >= two.keys() and len(two) > 300
    for key, (mu, sigma) in two.items():
        assert math.isclose(one[key][0], mu, rel_tol=1e-12)
        assert one[key][1] is None and sigma is None or math.isclose(one[key][1], sigma, rel_tol=1e-9), key


def test_a_silent_series_is_forgotten(spark, tmp_path):
    files, _ = arrivals()
    got = run(spark, files, tmp_path, idle_days=7)
    quiet = sorted((row.datetime, row.ended, row.changes) for row in got.filter("site_id = 'quiet'").collect())
    day = lambda n: START.date() + dt.timedelta(days=n)
    assert quiet[:9] == [(day(n), False, n) for n in range(9)]
    assert quiet[9] == (day(8), True, 8)  # its last state, once
    assert quiet[10][:2] == (day(31), False) and quiet[10][2] == 0  # starts anew
    assert got.filter("ended").count() == 1


def test_nothing(spark, tmp_path):
    got = run(spark, [[("a", START, None), ("a", None, 1.0), (None, START + dt.timedelta(days=9), 2.0)]], tmp_path)
    assert got.count() == 0  # no day with a value is closed
