import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tarncast.operators import records

SCHEMA = "site_id string, datetime timestamp, event_id bigint, fdom double"


def readings():
    """One site with a third of all rows, many small ones, one without a name, ties in time, gaps in value."""
    pick = random.Random(4)
    start, out = dt.datetime(2024, 1, 1), []
    for number in range(900):
        site = "hot" if number % 3 == 0 else None if number % 41 == 0 else f"s{pick.randrange(25)}"
        at = None if number == 17 else start + dt.timedelta(minutes=5 * pick.randrange(300))
        out.append((site, at, number, None if number % 7 == 0 else pick.random()))
    return out


@pytest.mark.parametrize("slices", [1, 3, 40])
def test_rows_of_the_whole_record(spark, slices):
    rows = readings()
    expected, seen = [], {}
    for site, _, event, _ in sorted(rows, key=lambda row: (row[0] or "", row[1] or dt.datetime.min, row[2])):
        seen[site] = seen.get(site, 0) + 1
        if 20 <= seen[site] <= 200:
            expected.append((event, seen[site]))
    feed = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = records.record_slice(feed, ["site_id"], ["datetime", "event_id"], 20, 200, slices)
    assert got.columns == ["site_id", "datetime", "event_id", "fdom", "row"]
    assert sorted((row["event_id"], row["row"]) for row in got.collect()) == sorted(expected)
    assert got.filter("site_id = 'hot'").count() == 181


def test_no_window_over_raw_rows(spark):
    feed = spark.createDataFrame(readings(), SCHEMA)
    plan = records.numbered(feed, ["site_id"], ["datetime", "event_id"], 8)._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window") :]
    assert plan.count("Window") == 1 and "Aggregate" in window  # it runs over the counts


def test_ties_repeats_and_nothing(spark):
    feed = spark.createDataFrame([("a", None, 1, 1.0)] * 4 + [("b", None, 1, 1.0)], SCHEMA).withColumn("_slice_of", F.lit(9))
    got = records.numbered(feed, ["site_id"], ["datetime", "event_id"], 3).groupBy("site_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    assert {row["site_id"]: row["rows"] for row in got.collect()} == {"a": [1, 2, 3, 4], "b": [1]}
    assert records.numbered(feed.limit(0), ["site_id"], ["datetime"]).count() == 0
