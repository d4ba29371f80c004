"""What packing leaves in an executor's Python workers, and how many of them a step starts."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark import SparkContext

from tarncast.llm import decontaminate, packing, tokens, toxicity

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture()
def no_lists(monkeypatch):
    """A table from a Python list is read by workers of its own, which stay beside those of the operators."""

    def refused(*_, **__):
        raise AssertionError("a list was sent through Python workers")

    monkeypatch.setattr(SparkContext, "parallelize", refused)


def test_no_second_set_of_workers(spark, no_lists):
    docs = spark.range(40).selectExpr("id as doc_id", "concat('a text of some words, number ', id, ', and a few more of them') as text")
    items = spark.range(1).selectExpr("id as item_id", "'a text of some words, number 7, and a few more of them' as text")
    packed = packing.pack(docs, VOCABULARY, capacity=8).collect()
    assert {row["doc_id"] for row in packed} == set(range(40))
    ends = {}
    for row in sorted(packed, key=lambda row: (row["sequence_id"], row["offset"])):  # every sequence is gapless from 0
        assert row["offset"] == ends.get(row["sequence_id"], 0)
        ends[row["sequence_id"]] = row["offset"] + row["length"]
    assert max(ends.values()) <= 8
    assert packing.pack(docs.limit(0), VOCABULARY).collect() == []
    assert 7 in {row["doc_id"] for row in decontaminate.find_leaks(docs, items).collect()}
    none = decontaminate.find_leaks(docs, items.limit(0), key="text")
    assert none.collect() == [] and none.columns == ["doc_id", "item_id", "passage", "score", "first_word", "last_word", "key"]


def test_packing_hands_memory_back(spark, monkeypatch):
    kept, given = [], []
    docs = spark.createDataFrame([(1, "a text")], "doc_id bigint, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, function, schema: kept.append(function))
    monkeypatch.setattr(packing, "give_back", lambda: given.append(1), raising=False)
    packing.cut_pieces(docs, VOCABULARY, 8, 1)
    batch = pa.record_batch({"doc_id": pa.array([1], pa.int64()), "text": pa.array(["a text"])})
    assert [out.num_rows for out in kept[0](iter([batch]))] == [1] and given


def test_pieces_are_bytes_and_few(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 5, raising=False)
    words = tokens.WordIds(VOCABULARY)
    for number in range(40):
        text = f"it's word{number}x, (part-{number}) naïve_{number} ǅ{number}"
        assert words.encode(text).tolist() == words.whole.encode(text, add_special_tokens=False).ids
        assert len(words.pieces) <= 5
    assert all(isinstance(value, bytes) for value in words.pieces.values())


def test_training_holds_the_ids_of_its_texts_once(monkeypatch):
    met = []

    def stopped(self, ids, *_):
        met.append(tracemalloc.get_traced_memory()[0])
        raise InterruptedError

    monkeypatch.setattr(toxicity.Network, "gradients", stopped)
    texts, network = [" ".join(f"w{n % 977}" for n in range(2000))] * 300, toxicity.Network.fresh()
    texts, labels = [text.encode() for text in texts], np.arange(300, dtype=np.float32) % 2
    tracemalloc.start()
    with pytest.raises(InterruptedError):
        toxicity.train(network, texts, labels, 0.5)
    tracemalloc.stop()
    assert met[0] < 2.3 * 300 * 2000 * 4 * (1 + len(toxicity.STEMS))
