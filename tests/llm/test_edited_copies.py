"""Edited copies of benchmark passages, in short and long documents, against an alignment of whole texts."""

import pytest

from tarncast.llm import decontaminate
from tarncast.llm.words import ngrams, word_hashes
from conftest import invented


def leaks_brute(texts, items):
    """Scores of at least a half among all pairs that share a run of four words."""
    out = {}
    for doc_id, text in texts:
        for item_id, item in items:
            a, b = (word_hashes([value.encode()])[0] for value in (item, text))
            if not set(ngrams(a, 4).tolist()).isdisjoint(ngrams(b, 4).tolist()) and (score := decontaminate.align(a, b)[0] / len(a)) >= 0.5:
                out[doc_id, item_id] = score
    return out


EDITS = {
    "every 5th": lambda words: [f"e{n}" if n % 5 == 4 else word for n, word in enumerate(words)],
    "every 5th from the third": lambda words: [f"e{n}" if n % 5 == 2 else word for n, word in enumerate(words)],
    "every 6th": lambda words: [f"e{n}" if n % 6 == 5 else word for n, word in enumerate(words)],
    "put in": lambda words: [part for n, word in enumerate(words) for part in ([word, "put", "in"] if n % 4 == 3 else [word])],
    "a new first part": lambda words: [f"e{n}" if n < len(words) // 3 or n % 7 == 6 else word for n, word in enumerate(words)],
}


@pytest.mark.parametrize("edit", EDITS)
def test_edited_copies(spark, edit):
    """One edited copy of each item in a short and in a long document, so that only what the edit left of the item is in the corpus."""
    items = [(n, invented(n, n)) for n in (20, 38, 59)]
    copies = [" ".join(EDITS[edit](item.split())) for _, item in items]
    texts = list(enumerate(f"{invented(length, 500 + n)} {copy} {invented(length, 600 + n)}" for n, copy in enumerate(copies) for length in (3, 1500)))
    found = decontaminate.find_leaks(spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    want = leaks_brute(texts, items)
    assert {(r.doc_id, r.item_id): r.score for r in found.collect()} == pytest.approx(want) and len(want) == 6


def test_only_a_frequent_run_is_left(spark):
    """Of a copy one run of four words is left, and 49 other documents hold it too; its other runs are shorter."""
    item = invented(14, 7).split()
    copy = [*item[:4], "x", *item[5:8], "x", *item[9:12], "x", item[13]]
    docs = [(0, " ".join(copy))] + [(n, f"{' '.join(item[:4])} {invented(30, 700 + n)}") for n in range(1, 50)]
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string"))
    assert [r.doc_id for r in found.collect()] == [0]
