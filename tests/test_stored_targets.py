from pyspark.sql import functions as F

from tarncast import fixtures as fx
from tarncast.catalog import live


def test_targets_that_change_in_their_last_bits_are_scored_once(spark, monkeypatch):
    """Averages of many rows, merged in another order at every run: here the clock stands for the order."""
    steady = fx.targets

    def restless(spark, folder):
        bits = (F.unix_micros(F.current_timestamp()) % 9973).cast("double") * 1e-12
        return steady(spark, folder).withColumn("observation", F.col("observation") + bits)

    monkeypatch.setattr(fx, "targets", restless)
    rows = live.incremental_score(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 2 and {row["second_run"] for row in rows} == {0}


def test_no_batch_of_a_stream_reads_the_orders_anew(spark, monkeypatch):
    read = []
    score = live.provenance.incremental_score

    def spy(batch, targets, *args, **kwargs):
        read.extend(targets.inputFiles())
        return score(batch, targets, *args, **kwargs)

    monkeypatch.setattr(live.provenance, "incremental_score", spy)
    assert live.stream_scores(spark, "/root/testdata/sf0.001").count() == 2
    assert read and not [path for path in read if "orders" in path]
