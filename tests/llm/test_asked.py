"""Only texts that are asked for are shuffled for their tokens."""

import pytest
from conftest import invented
from pyspark.sql import functions as F

from tarncast.llm import line_dedup, setjoin


@pytest.mark.parametrize("bits", [6, 24])
def test_documents_that_may_be_asked_for(spark, monkeypatch, bits):
    monkeypatch.setattr(setjoin, "MARK_BITS", bits)
    rows = spark.range(-4000, 4000).select("id", F.lit("text").alias("text")).unionByName(spark.createDataFrame([(setjoin.NULL_ID, "none")], "id bigint, text string"))
    asked = rows.filter("id % 1000 = 0").select("id")
    got = {row["id"] for row in setjoin.among(rows, asked).collect()}
    assert got >= {row["id"] for row in asked.collect()}
    assert bits == 6 or len(got) < 100


def test_a_few_texts_go_to_the_tokens(spark, monkeypatch):
    """All 400 texts were shuffled, though two near copies of a line are in two of them."""
    line = invented(30, 1)
    texts = [invented(40, 100 + n, 1 << 30) for n in range(400)]
    texts[7], texts[300] = f"{texts[7]}\n{line}", f"{texts[300]}\n{line} tail"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    seen, whole = [], setjoin.among

    def watched(rows, asked):
        found = whole(rows, asked)
        seen.append((found.count(), asked.count()))
        return found

    monkeypatch.setattr(setjoin, "among", watched)
    assert [tuple(row) for row in line_dedup.removed_lines(docs).collect()] == [(300, 1)]
    assert seen[0] == (2, 2) and all(found <= 2 for found, _ in seen)
