import random

from pyspark.sql import functions as F

from tarncast.llm import toxicity


def test_a_word_that_only_late_labels_teach(spark, monkeypatch):
    """Of 20,000 labelled rows those with the largest deals alone hold the second bad word: no first few thousand show it."""
    pick = random.Random(3)
    words = [f"n{number}" for number in range(200)]
    rows = [(number, " ".join(pick.choices(words, k=6)), number % 2) for number in range(20_000)]
    deal = F.xxhash64("doc_id", F.lit(11))
    mark = F.when(F.col("toxic") == 0, "").when(deal > 1 << 62, " zorgle").otherwise(" blick")
    table = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int").withColumn("text", F.concat("text", mark))
    held = F.col("doc_id") % 10 > 7
    for size, groups in ((8 << 20, 16), (200_000, 2)):
        monkeypatch.setattr(toxicity, "PART_BYTES", size, raising=False)
        monkeypatch.setattr(toxicity, "GROUPS", groups, raising=False)
        got = toxicity.score(table.select("doc_id", "text"), table.select("doc_id", "toxic"), "toxic", held, passed=["text"])
        kinds = F.when(F.col("passed.text").contains("zorgle"), "late").when(F.col("passed.text").contains("blick"), "early").otherwise("clean")
        rates = {r["kind"]: r["p"] for r in got.filter("held_out").groupBy(kinds.alias("kind")).agg(F.avg("predicted").alias("p")).collect()}
        assert rates["late"] > 0.95 and rates["early"] > 0.95 and rates["clean"] < 0.05


def test_thresholds_come_from_counts_of_every_row(spark):
    rows = spark.createDataFrame([(number % 2, f"the word{number % 7} of {number}") for number in range(7_000)], "y int, text string")
    assert toxicity.counted(rows, toxicity.Network.fresh()).sum() == 7_000
