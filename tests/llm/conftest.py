"""Small tables for the training-data operators: nulls, ties, long texts, repeated rows, clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def invented(words, seed, vocabulary=4000):
    pick = random.Random(seed)
    return " ".join(f"w{pick.randrange(vocabulary)}" for _ in range(words))


def edited(text, seed, share=0.02):
    pick = random.Random(seed)
    return " ".join(f"e{pick.randrange(9999)}" if pick.random() < share else word for word in text.split(" "))


@pytest.fixture(scope="session")
def rows():
    """Texts with exact copies, near copies, shared passages, repeated lines, odd bytes, empty and null ones."""
    base = [invented(120, seed) for seed in range(12)]
    texts = list(base)
    texts += [base[0], base[0].upper(), base[1], base[1]]
    texts += [edited(base[2], seed) for seed in range(8)] + [edited(base[3], seed, 0.04) for seed in range(8)]
    passage = invented(90, 77)
    texts += [f"{invented(60, 100 + n)} {passage} {invented(40, 200 + n)}" for n in range(5)]
    lines = [invented(30, 300 + n) for n in range(4)]
    texts += ["\n".join([invented(25, 400 + n), lines[n % 4], edited(lines[(n + 1) % 4], n, 0.03), "short line"]) for n in range(8)]
    texts += ["", None, "   \t\n ", "one", "One", "three small words", "Three  small\twords", "ÀB É é", "Àb É é", "a b \x1c c", "aa " * 400, "ab" * 900, invented(9000, 5), invented(9000, 5) + " tail", "é" * 700, "x<|endoftext|> y"]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows, one of them twice and one under no id, beside columns whose names clash with helper names."""
    table = [(doc_id, text, None if doc_id % 3 else "en", "s", None if text is None else len(text)) for doc_id, text in rows]
    table += [table[5], (None, "nobody's text with words enough to count", None, None, None)]
    frame = spark.createDataFrame(table, SCHEMA)
    return frame.repartition(5).withColumns({name: F.lit(9) for name in ("id", "tag", "hash", "body", "sid", "tok", "g", "n", "kept", "first", "unit", "dropped_id", "x", "label", "score")})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
