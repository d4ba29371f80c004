"""Target-distribution importance resampling over hashed word n-grams.

A document is separator-normalised once: its words joined by one space. One scan stores the running
CRC after each word. The CRC of any n-gram then comes from two prefixes: with ``shift(v, n)`` the
effect of n zero bytes on a checksum, a linear map over GF(2),

    crc(words i..j) = running(end of j) xor shift(running(start of i), bytes from i to j)

so no n-gram is ever built as a string. Buckets are counted over all documents and all texts of the
target; a document's weight is the mean log ratio of its buckets, and Gumbel noise drawn from its id
turns the highest scores into a weighted sample without replacement.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarncast.llm.words import text_batches
from tarncast.session import work_path

RATED = "doc_id bigint, n_words bigint, n_features bigint, weight bigint"
#: Letters a-z, digits and all bytes beyond ASCII stay, A-Z are lower-cased, the rest separates words.
NORMAL = bytes(byte + 32 if 65 <= byte <= 90 else byte if byte >= 128 or 48 <= byte <= 57 or 97 <= byte <= 122 else 32 for byte in range(256))
PIECES = re.compile(rb" ?[^ ]+")


def byte_steps() -> np.ndarray:
    """What one more byte does to the register, for each value of its low byte."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, (steps >> 1) ^ np.uint32(0xEDB88320), steps >> 1)
    return steps


STEPS = byte_steps()


class Shifts:
    """``shift(values, lengths)``: the effect of ``lengths`` zero bytes on checksums, by tables for 0..255, then multiples of 256, of 65,536, ..."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def level(self, at: int) -> np.ndarray:
        """Tables [count, byte of the value, its content] for ``count * 256**at`` zero bytes."""
        while len(self.levels) <= at:
            own = np.zeros((256, 4, 256), np.uint32)
            own[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
            for count in range(1, 256):
                before = own[count - 1]
                if self.levels:
                    own[count] = self.apply(self.levels[-1], self.apply(self.levels[-1], before, 255), 1)
                else:
                    own[count] = STEPS[before & 255] ^ (before >> 8)
            self.levels.append(own)
        return self.levels[at]

    @staticmethod
    def apply(table: np.ndarray, values: np.ndarray, counts) -> np.ndarray:
        flat, base = table.reshape(-1), np.asarray(counts, dtype=np.int64) * 1024
        out = flat[base + (values & 255)]
        for byte in (1, 2, 3):
            out = out ^ flat[base + 256 * byte + ((values >> np.uint32(8 * byte)) & 255)]
        return out

    def __call__(self, values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        at = 0
        while len(lengths) and lengths.any():
            values = self.apply(self.level(at), values, lengths & 255)
            lengths, at = lengths >> 8, at + 1
        return values


SHIFTS = Shifts()


def scan(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Running CRCs at the start and the end of every word, its end in bytes (over all texts), and the number of words of each text."""
    ends: list[int] = []
    sizes: list[int] = []
    words = np.zeros(len(texts), np.int64)
    for at, text in enumerate(texts):
        pieces = PIECES.findall(b" ".join(text.translate(NORMAL).split()))
        words[at] = len(pieces)
        sizes += map(len, pieces)
        running = 0
        for piece in pieces:
            running = crc32(piece, running)
            ends.append(running)
    last = np.array(ends, dtype=np.uint32)
    first = np.zeros_like(last)
    if len(last):
        register = ~last[:-1]
        first[1:] = ~(STEPS[(register ^ np.uint32(32)) & 255] ^ (register >> np.uint32(8)))
        first[(np.cumsum(words) - words)[words > 0]] = 0
    return first, last, np.cumsum(np.array(sizes, dtype=np.int64)), words


def ngram_crcs(texts: list[bytes], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 of every run of 1 to ``most`` words of each text, the text it is from, and the words of each text."""
    first, last, at, words = scan(texts)
    owner = np.repeat(np.arange(len(texts)), words)
    size = np.diff(at, prepend=0)
    begins = np.ones(len(at), dtype=bool)
    begins[1:] = owner[1:] != owner[:-1]
    start = at - size + ~begins  # the space before a word that is not its text's first belongs to no word
    crcs, owners = [], []
    for n in range(1, most + 1):
        count = max(0, len(at) - n + 1)
        inside = np.flatnonzero(owner[:count] == owner[n - 1 :][:count])
        crcs.append(last[inside + n - 1] ^ SHIFTS(first[inside], at[inside + n - 1] - start[inside]))
        owners.append(owner[inside])
    return np.concatenate(crcs), np.concatenate(owners), words


def bucket_counts(docs: DataFrame, buckets: int, most: int) -> np.ndarray:
    """How many features of all texts fall into each bucket; one row of counts leaves a task, ``buckets`` rows reach the driver."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, texts in text_batches(batches):
            total += np.bincount(ngram_crcs(texts, most)[0] % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array([used.tolist()], pa.list_(pa.int32())), "n": pa.array([total[used].tolist()], pa.list_(pa.int64()))})

    rows = docs.select("text").mapInArrow(count, "bucket array<int>, n array<bigint>")
    each = rows.select(F.explode(F.arrays_zip("bucket", "n")).alias("x")).groupBy("x.bucket").agg(F.sum("x.n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for row in each.toLocalIterator():
        total[row["bucket"]] = row["n"]
    return total


def bucket_gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share of the target / share of the documents)) of each bucket, with one count added to each."""
    buckets, all_docs, all_target = len(docs), int(docs.sum()), int(target.sum())
    ratio = lambda s, t: (t + 1.0) * (all_docs + buckets) / ((s + 1.0) * (all_target + buckets))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(docs.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weights(docs: DataFrame, gains: np.ndarray, most: int) -> DataFrame:
    """One row for each document: doc_id, n_words, n_features and the floored mean gain of its features (0 without any)."""
    buckets = np.uint32(len(gains))

    def rate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            crcs, owner, words = ngram_crcs(texts, most)
            found = np.bincount(owner, minlength=len(texts))
            total = np.zeros(len(texts), np.int64)
            np.add.at(total, owner, gains[crcs % buckets])
            yield pa.record_batch({"doc_id": batch.column(0), "n_words": pa.array(words), "n_features": pa.array(found), "weight": pa.array(total // np.maximum(found, 1))})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(rate, RATED)


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10_000, most: int = 2, seed: int = 7) -> DataFrame:
    """One row for each row of ``docs`` (``doc_id``, ``text``): doc_id, n_words, n_features, weight, score, rank.

    Of the N documents of at least ``least_words`` words, the floor(percent N / 100) of the highest score are drawn; ``rank``
    numbers them from 1, ties by the smaller doc_id (null last), then by fewer features and smaller weight; others have a null rank.
    A null text, and one without words, has no features and weight 0. The noise comes from the text ``seed:doc_id``, so a repeated
    doc_id gets the same noise for each of its rows, and a null one that of the empty text. An empty target makes every
    bucket's target share equal; an empty ``docs`` gives no rows. Other columns are ignored.

    Ranks come from a stored range-partitioned sort and the row counts of its partitions, never from one task over all rows.
    """
    spark = docs.sparkSession
    gains = bucket_gains(bucket_counts(docs, buckets, most), bucket_counts(target, buckets, most))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296))).cast("bigint")
    rated = work_path(spark, "rated")
    weights(docs, gains, most).withColumn("score", score).withColumn("able", F.col("n_words") >= least_words).write.parquet(rated)
    scored = spark.read.parquet(rated)
    able = scored.agg(F.count_if("able")).first()[0]
    order = [F.desc("able"), F.desc("score"), F.col("doc_id").asc_nulls_last(), F.asc("n_features"), F.asc("weight")]
    ranked = work_path(spark, "ranked")
    scored.sort(*order).withColumn("at", F.monotonically_increasing_id()).write.parquet(ranked)
    rows = spark.read.parquet(ranked).withColumn("part", F.shiftright("at", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    number = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    drawn = rows.join(parts, "part").withColumn("number", number)
    return drawn.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("number") <= percent * able // 100, F.col("number")).alias("rank"))
