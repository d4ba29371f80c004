import datetime as dt
import gzip

import pytest
from pyspark.sql import functions as F

from tarncast import schemas
from tarncast.operators import reshape
from tarncast.plans import provenance
from tarncast.sources import scan, sinks
from tarncast.streaming import feeds


def test_csv_with_declared_schema(spark, tmp_path):
    text = "when,where,deep,what,value\n2024-01-01,a,1.5,v,NA\n2024-01-02,a,NA,v,2.5\n"
    (tmp_path / "one.csv").write_text(text)
    with gzip.open(tmp_path / "two.csv.gz", "wt") as f:
        f.write(text.replace(",a,", ",b,"))
    df = scan.read_csv_dataset(spark, str(tmp_path), schemas.TARGETS, [F.col("depth_m").isNull()])
    rows = sorted((r["site_id"], r["datetime"], r["observation"]) for r in df.collect())
    assert rows == [("a", dt.date(2024, 1, 2), 2.5), ("b", dt.date(2024, 1, 2), 2.5)]
    assert df.schema == schemas.TARGETS
    assert scan.with_file(df).select("file").distinct().count() == 2


def test_pushdown_and_partition_pruning(spark, tmp_path):
    path = str(tmp_path / "d")
    df = spark.range(1000).select(
        F.concat(F.lit("s"), F.col("id") % 4).alias("site_id"),
        F.expr("date_add(date'2024-01-01', cast(id % 5 as int))").alias("reference_datetime"),
        F.col("id").cast("double").alias("prediction"),
        F.lit("x").alias("variable"),
    )
    sinks.write_dataset(df, path, spread=2)
    out = scan.open_dataset(
        spark, path, [F.col("site_id") == "s1", F.col("prediction") > 500], ["site_id", "prediction"]
    )
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(site_id" in plan and "GreaterThan(prediction,500.0)" in plan
    assert "variable" not in plan.split("ReadSchema")[1]
    assert out.count() == sum(1 for i in range(1000) if i % 4 == 1 and i > 500)
    below = scan.open_dataset(spark, f"{path}/reference_datetime=2024-01-02", base=path)
    assert below.select("reference_datetime").distinct().collect()[0][0] == dt.date(2024, 1, 2)


def test_replacing_partitions_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.createDataFrame([("m", "a", 1), ("m", "b", 2), ("n", "a", 3)], "model_id string, k string, v int")
    sinks.replace_partitions(df, path, ["model_id", "k"])
    sinks.replace_partitions(df.filter("k = 'a' and model_id = 'm'").withColumn("v", F.lit(9)), path, ["model_id", "k"])
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [2, 3, 9]


def forecasts_for(spark, refs, sites=("a", "b")):
    rows = []
    for ref in refs:
        for s in sites:
            for h in (1, 2, 3):
                day = dt.date(2024, 1, ref) + dt.timedelta(days=h)
                rows += [(day, dt.date(2024, 1, ref), "m", s, "mu", 5.0 + h), (day, dt.date(2024, 1, ref), "m", s, "sigma", 1.0)]
    df = spark.createDataFrame(
        rows, "datetime date, reference_datetime date, model_id string, site_id string, parameter string, prediction double"
    )
    return df.withColumn("family", F.lit("normal")).withColumn("variable", F.lit("v")).withColumn(
        "pub_datetime", F.col("reference_datetime")
    )


def targets_for(spark, value=6.0):
    rows = [(dt.date(2024, 1, d), s, "v", value if d == 4 else 6.0) for d in range(1, 20) for s in ("a", "b")]
    return spark.createDataFrame(rows, "datetime date, site_id string, variable string, observation double")


def test_only_new_or_changed_groups_are_scored(spark, tmp_path):
    scores, log = str(tmp_path / "scores"), str(tmp_path / "log")

    def run(forecasts, targets, as_of="2024-01-31", days=365):
        return provenance.incremental_score(forecasts, targets, scores, log, as_of, days, families=["normal"])

    assert run(forecasts_for(spark, [1, 2]), targets_for(spark)) == 4  # days 2 to 5
    assert run(forecasts_for(spark, [1, 2]), targets_for(spark)) == 0
    assert spark.read.parquet(scores).count() == 12
    assert run(forecasts_for(spark, [1, 2]), targets_for(spark, 7.5)) == 1  # one day's target changed
    changed = spark.read.parquet(scores).filter("date = date'2024-01-04'").collect()
    assert len(changed) == 4 and {r["observation"] for r in changed} == {7.5}
    assert run(forecasts_for(spark, [1, 2, 3]), targets_for(spark, 7.5)) == 3  # a new issue touches days 4 to 6
    assert spark.read.parquet(scores).count() == 18
    assert run(forecasts_for(spark, [10]), targets_for(spark, 7.5), "2024-01-12") == 2  # day 13 is not over
    assert provenance.read_log(spark, log).count() == 4 + 1 + 3 + 2


def test_group_id_ignores_row_order(spark):
    f, t = forecasts_for(spark, [1, 2]), targets_for(spark)
    one = {r["new_id"] for r in provenance.group_ids(f, t).collect()}
    two = {r["new_id"] for r in provenance.group_ids(f.orderBy(F.rand(1)).repartition(5), t.repartition(3)).collect()}
    assert one == two and len(one) == 4


def test_late_readings_update_their_day(spark, tmp_path):
    schema = "site_id string, datetime timestamp, fdom double"
    source = str(tmp_path / "in")

    def arrive(rows):
        df = spark.createDataFrame([(s, dt.datetime.fromisoformat(t), v) for s, t, v in rows], schema)
        df.coalesce(1).write.mode("append").parquet(source)

    table, state = str(tmp_path / "out"), str(tmp_path / "state")

    def drain():
        feed = feeds.read_feed(spark, source, spark.read.parquet(source).schema)
        feeds.run_updates(feeds.daily_stream(feed, "fdom"), table, state).awaitTermination()
        rows = feeds.read_updates(spark, table, ["site_id", "datetime"]).collect()
        return {(r["site_id"], str(r["datetime"])): (r["fdom"], r["readings"]) for r in rows}

    arrive([("a", "2024-01-01T05:00:00", 1.0), ("a", "2024-01-02T05:00:00", 4.0)])
    assert drain() == {("a", "2024-01-01"): (1.0, 1), ("a", "2024-01-02"): (4.0, 1)}
    arrive([("a", "2024-01-01T23:00:00", 3.0), ("b", "2024-01-05T00:00:00", 8.0)])
    assert drain()["a", "2024-01-01"] == (2.0, 2)
    arrive([("a", "2024-01-01T12:00:00", 500.0), ("a", "2024-01-05T12:00:00", 9.0)])  # past the watermark
    last = drain()
    assert last["a", "2024-01-01"] == (2.0, 2) and last["a", "2024-01-05"] == (9.0, 1)


def test_small_helpers(spark):
    df = spark.createDataFrame([("x_y", 1.0, None)], "label string, v double, w double")
    assert reshape.by_position(df, [2]).columns == ["v"]
    assert reshape.present(df, ["w", "zz"]) == ["w"]
    assert reshape.split_label(df, "label", ["p", "q", "r"], "_").first()[-3:] == ("x", "y", None)
    profile = {r["column"]: r for r in scan.profile(df, ["v", "w"]).collect()}
    assert profile["w"]["missing"] == 1 and profile["v"]["high"] == pytest.approx(1.0)
