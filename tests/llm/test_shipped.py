"""What travels with a function to the executors, and how many links a group of copies gives."""

import random

import pytest
from conftest import invented
from pyspark.cloudpickle import cloudpickle

import tarncast
from tarncast.llm import jaccard_join, line_dedup, suffix_dedup, toxicity, words
from tarncast.llm.components import components


def packed(function):
    """As the driver's entry sends it: with the package's own functions in it."""
    known = tarncast.__name__ in cloudpickle.list_registry_pickle_by_value()
    cloudpickle.register_pickle_by_value(tarncast)
    try:
        return cloudpickle.dumps(function)
    finally:
        if not known:
            cloudpickle.unregister_pickle_by_value(tarncast)


@pytest.mark.parametrize("function", [words.word_hashes, jaccard_join.document_items(5), line_dedup.line_items(5), suffix_dedup.places, toxicity.encode])
def test_tables_of_powers_stay_in_their_process(function):
    """Every function that is sent took two tables of 16 MB along, and each lay on the disks of the driver and of all executors."""
    words.word_hashes([b"a b " * words.SEGMENT])
    assert len(packed(function)) < 200_000
    assert words.power_table(3, 5).tolist() == [1, 3, 9, 27, 81]


def test_a_copy_hashes_as_the_function_does():
    copy = cloudpickle.loads(packed(words.word_hashes))
    texts = [b"one", b"two three " * 400, b"x" * 5000]
    for found, own in zip(copy(texts), words.word_hashes(texts), strict=True):
        assert (found == own).all()


def near_copies(count, size=100):
    """Texts of one passage, each with a word of its own at a place of its own: all of them are linked."""
    base, pick = invented(size, 5).split(), random.Random(3)
    return [" ".join([*base[: (at := pick.randrange(size))], f"own{n}", *base[at + 1 :]]) for n in range(count)]


@pytest.fixture
def links(monkeypatch):
    """The links of the second step, with nothing found by the first."""
    met = []

    def watch(module):
        settle = module.settle

        def watched(*args):
            found = settle(*args).localCheckpoint()
            met.extend((bytes(row["a"]), bytes(row["b"])) for row in found.collect())
            return found

        monkeypatch.setattr(module, "settle", watched)
        monkeypatch.setattr(module, "verify_pairs", lambda pairs, arrays, like: pairs.select("a", "b").limit(0))
        return met

    return watch


def test_linked_documents_give_a_forest(spark, links):
    """All pairs of a group of near copies were links, as many as the square of its size."""
    met, texts = links(jaccard_join), near_copies(60)
    docs = spark.createDataFrame([(n, text) for n, text in enumerate(texts)], "doc_id bigint, text string")
    got = jaccard_join.near_duplicates(docs).collect()
    assert sorted(row["doc_id"] for row in got) == list(range(60)) and {row["component_id"] for row in got} == {0}
    assert len(met) == 59
    assert len({row["label"] for row in components(spark.createDataFrame(met, "a binary, b binary")).collect()}) == 1


def test_linked_lines_give_one_link_each(spark, links):
    met, texts = links(line_dedup), near_copies(60)
    docs = spark.createDataFrame([(n, "\n".join(texts[2 * n : 2 * n + 2])) for n in range(30)], "doc_id bigint, text string")
    got = sorted((row["id"], row["part"]) for row in line_dedup.removed_lines(docs).collect())
    assert got == [(n, part) for n in range(30) for part in range(2) if n or part]
    assert len(met) == 59
