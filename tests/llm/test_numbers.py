"""Which rows the pipeline numbers: no copy of the corpus lies on disk that is not needed."""

import glob

import corpus_pipeline
import pytest
from conftest import invented
from pyspark.sql import functions as F

from tarncast.session import shared_root


@pytest.fixture(scope="module")
def plain(spark):
    """Rows with ids of their own, repeated lines and a near copy."""
    texts = ["\n".join([invented(30, n), invented(30, 900), "short line"]) for n in range(12)] + [invented(90, 50), invented(90, 50) + " tail"]
    return spark.createDataFrame([(3 * n + 1, text, "s", len(text)) for n, text in enumerate(texts)], "doc_id bigint, text string, source string, n_chars bigint")


@pytest.mark.parametrize("stage", [corpus_pipeline.drop_lines, corpus_pipeline.keep_one_of_near_copies])
def test_rows_with_ids_of_their_own_are_not_copied(spark, plain, stage, monkeypatch):
    """A copy of all documents lay on disk through the whole stage, only to number the rows."""
    folder = shared_root(spark).removeprefix("file://").removeprefix("file:")
    before = set(glob.glob(f"{folder}/numbered-*"))
    got = sorted(map(tuple, stage(spark, plain, "").collect()))
    assert set(glob.glob(f"{folder}/numbered-*")) == before
    monkeypatch.setattr(corpus_pipeline, "own_ids", lambda docs: False, raising=False)
    assert sorted(map(tuple, stage(spark, plain, "").collect())) == got
    assert len(got) == (14 if stage is corpus_pipeline.drop_lines else 13)


@pytest.mark.parametrize("ids", [[1, 1, 2], [None, 1, 2], [-(1 << 63), 1, 2]])
def test_other_ids_are_numbered(spark, ids):
    docs = spark.createDataFrame([(own, invented(40, 7)) for own in ids], "doc_id bigint, text string")
    assert not corpus_pipeline.own_ids(docs) and not corpus_pipeline.own_ids(docs.filter("doc_id > 0").select(F.col("doc_id").cast("string"), "text"))
    assert corpus_pipeline.keep_one_of_near_copies(spark, docs, "").count() == 1
