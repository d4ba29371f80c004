"""What an executor's Python worker holds at once."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tarncast.llm import toxicity, words


def test_one_slice_of_texts_at_a_time():
    """A whole batch was made into Python objects before its first slice was taken."""
    texts = [b"x" * (1 << 18)] * 64
    batch = pa.record_batch({"text": pa.array([*texts, None], pa.binary())})
    tracemalloc.start()
    slices = words.text_batches([batch], limit=1 << 20)
    first, _ = next(slices), tracemalloc.get_traced_memory()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 << 20 and first[1] == texts[:4]
    assert [text for _, own in [first, *slices] for text in own] == [*texts, b""]


def test_a_passed_text_goes_to_the_classifier_once(spark, monkeypatch):
    """The text went to Python as its own column and again among the passed ones."""
    docs = spark.createDataFrame([(1, "s", "a text"), (2, None, None), (None, "t", "")], "doc_id bigint, source string, text string")
    kinds, run = [], type(docs).mapInArrow

    def watched(self, function, schema):
        kinds.append(self.schema.simpleString())
        return run(self, function, schema)

    monkeypatch.setattr(type(docs), "mapInArrow", watched)
    network = toxicity.Network.fresh()
    network.thresholds[:] = np.float32(1)
    got = toxicity.apply(docs, network, F.col("doc_id") == 1, passed=docs.columns)
    assert sorted((tuple(row.passed) for row in got.collect()), key=str) == sorted((tuple(row) for row in docs.collect()), key=str)
    assert got.schema["passed"].dataType.names == docs.columns
    assert [kind.count("string") for kind in kinds] == [2]  # source and text
