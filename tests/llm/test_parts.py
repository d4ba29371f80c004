"""Where the texts of the toxicity model go."""

import random

import pyarrow as pa

from tarncast.llm import toxicity


def test_texts_are_dealt_once_for_all_rounds(spark, monkeypatch):
    """Every round dealt and shuffled all texts anew."""
    monkeypatch.setattr(toxicity, "PART_BYTES", 20_000)
    monkeypatch.setattr(toxicity, "STEPS", 1)
    pick, read = random.Random(5), spark.sparkContext.accumulator(0)
    words = [f"n{number}" for number in range(200)]
    texts = [(number % 2, number, " ".join(pick.choices(words, k=20))) for number in range(1_000)]

    def watched(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    schema = "y int, deal bigint, text string"
    rows = spark.createDataFrame(texts, schema).mapInArrow(watched, schema)
    size = sum(len(text) for _, _, text in texts)
    network = toxicity.fit(rows, 0.5, size)
    assert read.value == 1_000
    assert size > 3 * toxicity.PART_BYTES and (network.flat() != toxicity.Network.fresh().flat()).any()


def test_a_part_is_one_row_of_all_its_texts():
    rows = [(9, "b", 1), (2, "", 0), (2, "é", 1)]
    table = pa.table({"part": pa.array([3] * 3, pa.int32()), **{name: pa.array(own, kind) for name, own, kind in zip(("deal", "text", "y"), zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int32()), strict=True)}})
    got = toxicity.gathered((pa.scalar(3, pa.int32()),), table)
    assert got["part"].to_pylist() == [3] and [tuple(row.values()) for row in got["rows"].to_pylist()[0]] == rows
