"""The archive of arrived forecasts: folders, versions, repeats."""

import datetime as dt

from pyspark.sql import functions as F

from tarncast.streaming import archive

SCHEMA = "model_id string, site_id string, datetime timestamp_ntz, prediction double"


def rows(spark, *entries):
    return spark.createDataFrame([(m, s, None if d is None else dt.datetime(2020, *d), p) for m, s, d, p in entries], SCHEMA)


def as_set(df):
    return sorted(((r.model_id or f"-{r.model_id}", r.site_id, str(r.datetime), r.prediction) for r in df.collect()))


def stored(spark, path, df):
    """Everything that is live, as a reader after the last batch sees it."""
    table = archive.open_archive(spark, path, df.schema)
    folders = [tuple(r) for r in table.select(*archive.FOLDER).distinct().collect()]
    return archive.live_rows(table, archive.live_folders(table, folders, 1 << 40), 1 << 40).drop(*archive.FOLDER)


def test_batches_equal_one_run(spark, tmp_path):
    batches = [
        rows(spark, ("A", "x", (1, 3), 1.0), ("A", "y", (2, 3), 2.0), ("B", "x", (1, 9), 3.0)),
        rows(spark, ("A", "z", (1, 4), 4.0), (None, "x", (1, 4), 5.0), ("", "x", (1, 4), 6.0), ("A", "n", None, 7.0)),
        rows(spark, ("A", "x", (1, 3), 1.0), ("1", "x", (1, 3), 8.0), ("A", "n", None, 9.0), ("B/ =%", "x", (1, 3), 1.0)),
    ]
    path = str(tmp_path / "many")
    due = [archive.merge_batch(batch, number, path, "month") for number, batch in enumerate(batches)]
    everything = batches[0].unionByName(batches[1]).unionByName(batches[2])
    archive.merge_batch(everything, 0, str(tmp_path / "one"), "month")
    assert as_set(stored(spark, path, everything)) == as_set(everything) == as_set(stored(spark, str(tmp_path / "one"), everything))
    january = [r for r in as_set(everything) if r[0] == "A" and r[2].startswith("2020-01")]
    assert [r for r in as_set(due[2]) if r[0] == "A" and r[2] != "None"] == january  # the third batch gets all of its group
    assert archive.merge_batch(everything.limit(0), 3, path, "month") is None


def test_repeated_batch(spark, tmp_path):
    path = str(tmp_path / "archive")
    first, second = rows(spark, ("A", "x", (1, 3), 1.0)), rows(spark, ("A", "y", (1, 5), 2.0), ("B", "y", (1, 5), 3.0))
    archive.merge_batch(first, 0, path, "month")
    for _ in range(3):  # a batch whose query died after the rows were stored is given again
        due = archive.merge_batch(second, 1, path, "month")
        assert as_set(due) == as_set(first.unionByName(second))
    third = rows(spark, ("A", "z", (1, 6), 4.0))
    assert as_set(archive.merge_batch(third, 2, path, "month")) == [r for r in as_set(first.unionByName(second).unionByName(third)) if r[0] == "A"]
    # However many batches came, a folder holds the live slot and the one before it.
    table = archive.open_archive(spark, path, first.schema)
    assert {r.of_model: r.n for r in table.groupBy("of_model").agg(F.count_distinct("version").alias("n")).collect()} == {"A": 2, "B": 1}


def test_half_written_batch(spark, tmp_path):
    """Folders that a dead batch has already replaced do not hide what was live before it."""
    path = str(tmp_path / "archive")
    first = rows(spark, ("A", "x", (1, 3), 1.0), ("B", "x", (1, 3), 2.0))
    archive.merge_batch(first, 0, path, "month")
    archive.merge_batch(rows(spark, ("A", "lost", (1, 3), 9.0)), 1, path, "month")
    second = rows(spark, ("A", "y", (1, 4), 3.0), ("B", "y", (1, 4), 4.0))
    assert as_set(archive.merge_batch(second, 1, path, "month")) == as_set(first.unionByName(second))


def test_reads_only_touched_folders(spark, tmp_path):
    path = str(tmp_path / "archive")
    archive.merge_batch(rows(spark, *[("A", "x", (month, 3), float(month)) for month in range(1, 10)], ("B", "x", (1, 3), 1.0)), 0, path, "month")
    due = archive.merge_batch(rows(spark, ("A", "y", (4, 9), 0.0)), 1, path, "month")
    plan = due._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "2020-04-01" in plan
    assert due.count() == 2
    files = {name.split("of_model=")[1].split("/slot")[0] for name in due.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert files == {"A/of_period=2020-04-01"}
