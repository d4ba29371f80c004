"""Benchmark passages in training documents: n-gram seeds, then Smith-Waterman alignment.

Test items are read in blocks of bounded size, and each block meets every document. Seeds are all
the items' word n-grams, frequent ones too: an edited copy may hold no other. A document that holds a
seed is aligned with the item around the seed: word against word, so copies with words changed, left
out or put in still score. Places that hold too few of the item's words to reach the least score are
passed over without an alignment, which is what keeps frequent seeds cheap.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarncast.llm.words import ngrams, text_batches, word_hashes
from tarncast.session import work_path

BLOCK_BYTES = 8 << 20
PASSAGE_WORDS = 256
FOUND = "doc_id bigint, item_id bigint, passage int, score double, first_word bigint, last_word bigint"


def align(item: np.ndarray, text: np.ndarray, match: float = 1.0, mismatch: float = -0.5, gap: float = -0.5) -> tuple[float, int]:
    """The best local alignment score of two word sequences and where it ends in ``text``."""
    places = np.arange(1, len(text) + 1)
    row = np.zeros(len(text) + 1)
    best, end = 0.0, 0
    for word in item:
        step = np.zeros(len(text) + 1)
        step[1:] = np.maximum(row[:-1] + np.where(text == word, match, mismatch), row[1:] + gap)
        np.maximum(step, 0, out=step)
        # A gap in the item: the best value further left, less a gap for each place.
        step[1:] = np.maximum(step[1:], np.maximum.accumulate(step[1:] - gap * places) + gap * places)
        row = step
        at = int(row.argmax())
        if row[at] > best:
            best, end = float(row[at]), at
    return best, end


class Block:
    """Some test passages: their words, and their seeds in hash order."""

    def __init__(self, items: list[tuple[int, bytes]], seed_words: int):
        hashes, bounds = word_hashes([text for _, text in items])
        self.names: list[tuple[int, int]] = []
        self.words: list[np.ndarray] = []
        seeds, owners, places = [], [], []
        for (item_id, _), first, last in zip(items, bounds[:-1], bounds[1:], strict=True):
            for number, at in enumerate(range(int(first), int(last), PASSAGE_WORDS)):
                own = hashes[at : min(at + PASSAGE_WORDS, last)]
                if len(own) < seed_words:
                    continue
                grams = ngrams(own, seed_words)
                seeds.append(grams)
                owners.append(np.full(len(grams), len(self.words)))
                places.append(np.arange(len(grams)))
                self.names.append((item_id, number))
                self.words.append(own)
        self.seeds = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        self.owners = np.concatenate(owners) if seeds else np.zeros(0, np.int64)
        self.places = np.concatenate(places) if seeds else np.zeros(0, np.int64)
        by = np.argsort(self.seeds, kind="stable")
        self.seeds, self.owners, self.places = self.seeds[by], self.owners[by], self.places[by]
        self.distinct = np.unique(self.seeds)

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``grams`` that are seeds, and their places among the distinct seeds."""
        if not len(self.distinct):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.distinct, grams), len(self.distinct) - 1)
        found = np.flatnonzero(self.distinct[at] == grams)
        return found, at[found]


def blocks(benchmark: DataFrame, item_id: str, text: str, seed_words: int) -> Iterator[Block]:
    """All test items, ``BLOCK_BYTES`` of text at a time."""
    part, size = [], 0
    for row in benchmark.select(F.col(item_id).cast("bigint").alias("i"), F.col(text).alias("t")).toLocalIterator():
        value = (row["t"] or "").encode("utf-8", "surrogatepass")
        if part and size + len(value) > BLOCK_BYTES:
            yield Block(part, seed_words)
            part, size = [], 0
        part.append((row["i"], value))
        size += len(value)
    if part:
        yield Block(part, seed_words)


def document_grams(texts: list[bytes], seed_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a slice, its bounds, and the n-gram at each place (those over a text's end are 0)."""
    hashes, bounds = word_hashes(texts)
    grams = np.zeros(len(hashes), np.uint64)
    if len(hashes) >= seed_words:
        grams[: len(hashes) - seed_words + 1] = ngrams(hashes, seed_words)
    for last in bounds[1:]:
        grams[max(0, last - seed_words + 1) : last] = 0
    return hashes, bounds, grams


def find_leaks(docs: DataFrame, benchmark: DataFrame, seed_words: int = 4, least: float = 0.5, item_id: str = "item_id", text: str = "text", key: str | None = None) -> DataFrame:
    """Documents that hold a test passage: doc_id, item_id, passage, score, first_word, last_word.

    ``score`` is the alignment score over the number of words of the passage (1 for an exact copy), and rows have ``least`` or
    more. Every place of a document that shares a run of ``seed_words`` words with the passage is aligned, so copies
    without one such run are not found. Items of more than 256 words are searched as passages of 256; passages of fewer
    than ``seed_words`` words match nothing. With ``key``, that string column of the document follows as ``key``. One row for each document, item and passage, its best place. A null text is
    empty; a repeated or null doc_id gives rows of each document; other columns are ignored; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    path = work_path(spark, "leaks")
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *([F.col(key).cast("string").alias("key")] if key else []))
    schema = FOUND + (", key string" if key else "")
    names = [part.split()[0] for part in schema.split(", ")]
    for block in blocks(benchmark, item_id, text, seed_words):
        if not len(block.seeds):
            continue

        def search(batches: Iterable[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch, texts in text_batches(batches):
                hashes, bounds, grams = document_grams(texts, seed_words)
                found, seeds = block.hits(grams)
                if not len(found):
                    continue
                ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
                keys = batch.column(batch.schema.get_field_index("key")) if key else None
                first, last = (np.searchsorted(block.seeds, block.distinct[seeds], side) for side in ("left", "right"))
                near: dict[tuple[int, int], list[int]] = {}
                for place, row, a, b in zip(found, np.searchsorted(bounds, found, "right") - 1, first, last, strict=True):
                    for entry in range(a, b):
                        near.setdefault((int(row), int(block.owners[entry])), []).append(int(place) - int(block.places[entry]))
                out = []
                for (row, owner), begins in near.items():
                    item = block.words[owner]
                    slack = math.ceil(max(0.0, 2 * (1 - least)) * len(item))  # more words put in cost more than may be lost
                    best = (0.0, 0, 0)
                    spans: list[list[int]] = []
                    for begin in sorted(set(begins)):
                        low, high = max(int(bounds[row]), begin - slack), min(int(bounds[row + 1]), begin + len(item) + slack)
                        if spans and low <= spans[-1][1] and high - spans[-1][0] <= 6 * len(item):
                            spans[-1][1] = max(spans[-1][1], high)
                        else:
                            spans.append([low, high])
                    for low, high in spans:
                        if np.isin(item, hashes[low:high]).sum() < max(best[0], least * len(item)):
                            continue  # the score is at most the number of words found
                        score, end = align(item, hashes[low:high])
                        if score > best[0]:
                            _, back = align(item[::-1], hashes[low : low + end][::-1])  # the same alignment from its end
                            best = (score, low + end - back - int(bounds[row]), low + end - int(bounds[row]))
                    if best[0] >= least * len(item):
                        out.append((ids[row], *block.names[owner], best[0] / len(item), *best[1:], *([keys[row].as_py()] if key else [])))
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), *[pa.string()] * bool(key))
                    yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        source.mapInArrow(search, schema).write.mode("append").parquet(path)
    # No rows, for the schema; a list of none would start a second set of Python workers on every executor.
    spark.range(0).select(*[F.lit(None).cast(part.split()[1]).alias(part.split()[0]) for part in schema.split(", ")]).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
