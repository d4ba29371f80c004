"""Quality of documents by a regularised quadratic discriminant over document statistics.

The statistics are counted over the whole text, transformed towards normal shapes and standardised.
Each class has a mean and a covariance, shrunk towards the pooled covariance and its diagonal; the
score is the difference of the two log densities, through the Cholesky factors kept with the model.
The model needs only counts, sums and cross products, which Spark adds up over all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarncast.llm.words import text_batches, word_hashes
from tarncast.session import work_path

CLASSES = 9
UPPER, LOWER, DIGIT, BLANK, NEWLINE, STOP, MARK, BAR, HIGH = range(CLASSES)
FEATURES = 22


def byte_classes() -> np.ndarray:
    table = np.full(256, MARK, dtype=np.int64)
    table[ord("A") : ord("Z") + 1] = UPPER
    table[ord("a") : ord("z") + 1] = LOWER
    table[ord("0") : ord("9") + 1] = DIGIT
    table[[9, 11, 12, 13, 32]] = BLANK
    table[10] = NEWLINE
    table[[ord(mark) for mark in ".,;:?'\"()-"]] = STOP
    table[[ord(mark) for mark in "|<>{}[]=_/\\"]] = BAR
    table[128:] = HIGH
    return table


KIND = byte_classes()


def logit(share: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Log odds of a share, held off 0 and 1 by half a case."""
    return np.log((share * count + 0.5) / ((1 - share) * count + 0.5))


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of transformed statistics for each text; an empty text has the values of no counts at all."""
    rows = len(texts)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=rows)
    buffer = np.frombuffer(b"".join(texts), dtype=np.uint8)
    owner = np.repeat(np.arange(rows), sizes)
    kinds = np.bincount(owner * CLASSES + KIND[buffer], minlength=rows * CLASSES).reshape(rows, CLASSES).astype(float)
    hashes, bounds = word_hashes(texts)
    counts = np.diff(bounds)
    doc = np.repeat(np.arange(rows), counts)
    n = counts.astype(float)
    letters = kinds[:, UPPER] + kinds[:, LOWER] + kinds[:, HIGH]
    size, some = sizes.astype(float), np.maximum(n, 1)
    by = np.lexsort((hashes, doc))
    ordered, ordered_doc = hashes[by], doc[by]
    new = np.concatenate([[True], (ordered[1:] != ordered[:-1]) | (ordered_doc[1:] != ordered_doc[:-1])]) if len(by) else np.zeros(0, bool)
    distinct = np.bincount(ordered_doc[new], minlength=rows).astype(float)
    runs = np.diff(np.concatenate([np.flatnonzero(new), [len(by)]])) if len(by) else np.zeros(0, np.int64)
    most = np.zeros(rows)
    np.maximum.at(most, ordered_doc[new], runs)
    once = np.bincount(ordered_doc[new][runs == 1], minlength=rows).astype(float)

    def repeats(step: int) -> np.ndarray:
        same = (hashes[step:] == hashes[:-step]) & (doc[step:] == doc[:-step])
        return np.bincount(doc[step:][same], minlength=rows).astype(float)

    pairs = hashes[1:] * np.uint64(0x9E3779B97F4A7C15) + hashes[:-1]
    inside = doc[1:] == doc[:-1]
    by = np.lexsort((pairs[inside], doc[1:][inside]))
    pair, pair_doc = pairs[inside][by], doc[1:][inside][by]
    new = np.concatenate([[True], (pair[1:] != pair[:-1]) | (pair_doc[1:] != pair_doc[:-1])]) if len(by) else np.zeros(0, bool)
    pair_distinct = np.bincount(pair_doc[new], minlength=rows).astype(float)
    lines = kinds[:, NEWLINE] + 1
    share = lambda a, b: np.clip(a / np.maximum(b, 1), 0, 1)
    columns = [
        np.log1p(size),
        np.log1p(n),
        np.log1p((size - kinds[:, BLANK] - kinds[:, NEWLINE]) / some),
        np.log1p(n / lines),
        np.log1p(n / (kinds[:, STOP] + 1)),
        logit(share(kinds[:, UPPER], letters), letters),
        logit(share(kinds[:, DIGIT], size), size),
        logit(share(kinds[:, STOP], size), size),
        logit(share(kinds[:, MARK], size), size),
        logit(share(kinds[:, BAR], size), size),
        logit(share(kinds[:, HIGH], size), size),
        logit(share(kinds[:, NEWLINE], size), size),
        logit(share(kinds[:, BLANK], size), size),
        logit(share(distinct, n), n),
        logit(share(once, n), n),
        logit(share(most, n), n),
        logit(share(repeats(1), n), n),
        logit(share(repeats(2), n), n),
        logit(share(pair_distinct, np.maximum(n - 1, 0)), np.maximum(n - 1, 0)),
        np.arcsinh(kinds[:, MARK]),
        np.arcsinh(kinds[:, BAR]),
        np.arcsinh(repeats(1)),
    ]
    return np.column_stack(columns)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and its statistics, stored; one row for each row of ``docs``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            values = statistics(texts)
            yield pa.record_batch(
                {"doc_id": batch.column(batch.schema.get_field_index("doc_id")), "x": pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * FEATURES, pa.int32()), pa.array(values.ravel()))}
            )

    path = work_path(docs.sparkSession, "statistics")
    docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, x array<double>").write.parquet(path)
    return docs.sparkSession.read.schema("doc_id bigint, x array<double>").parquet(path)


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of both classes, and the prior log odds."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    whitening: list[np.ndarray]
    log_dets: list[float]
    prior: float

    @staticmethod
    def fit(counts: list[float], sums: list[np.ndarray], products: list[np.ndarray], shrink: float, ridge: float) -> Discriminant:
        """From each class's count, sums and cross products; without rows of both classes every score is the prior."""
        total = sum(counts)
        width = len(sums[0])
        if min(counts) < 2:
            share = (counts[1] + 1) / (total + 2)
            return Discriminant(np.zeros(width), np.ones(width), [np.zeros(width)] * 2, [np.zeros((width, width))] * 2, [0.0, 0.0], float(np.log(share / (1 - share))))
        centre = (sums[0] + sums[1]) / total
        variance = np.diag(products[0] + products[1]) / total - centre**2
        scale = np.sqrt(np.maximum(variance, 1e-6))
        means = [(part / count - centre) / scale for part, count in zip(sums, counts, strict=True)]
        spread = [(part / count - np.outer(total_ / count, total_ / count)) / np.outer(scale, scale) for part, total_, count in zip(products, sums, counts, strict=True)]
        pooled = sum(part * count for part, count in zip(spread, counts, strict=True)) / total
        whitening, log_dets = [], []
        for part in spread:
            mixed = (1 - shrink) * part + shrink * pooled
            mixed = (1 - ridge) * mixed + ridge * np.diag(np.diag(pooled) + 0.1)
            factor = np.linalg.cholesky(mixed)
            whitening.append(np.linalg.inv(factor))
            log_dets.append(2 * float(np.log(np.diag(factor)).sum()))
        return Discriminant(centre, scale, means, whitening, log_dets, float(np.log(counts[1] / counts[0])))

    def scores(self, values: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        values = (values - self.centre) / self.scale
        density = [-0.5 * (((values - mean) @ white.T) ** 2).sum(axis=1) - 0.5 * log_det for mean, white, log_det in zip(self.means, self.whitening, self.log_dets, strict=True)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.prior, -40, 40)))


def fit(statistics_: DataFrame, labels: DataFrame, label: str, learn: Column, shrink: float = 0.2, ridge: float = 0.02) -> Discriminant:
    """Fit on all rows of ``labels`` (doc_id, a 0/1 column ``label``) that hold ``learn``; null labels are left out."""
    known = labels.filter(F.col(label).isin(0, 1) & learn).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y"))

    def moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + FEATURES + FEATURES * FEATURES))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for value in (0, 1):
                own = x[y == value]
                total[value] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.record_batch({"m": pa.array([total.ravel().tolist()], pa.list_(pa.float64()))})

    parts = statistics_.join(known, "doc_id").select("x", "y").mapInArrow(moments, "m array<double>")
    sums = np.zeros(2 * (1 + FEATURES + FEATURES * FEATURES))
    for row in parts.select(F.posexplode("m").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).toLocalIterator():  # a fixed number of rows
        sums[row["at"]] = row["v"]
    sums = sums.reshape(2, -1)
    return Discriminant.fit(
        [float(part[0]) for part in sums], [part[1 : 1 + FEATURES] for part in sums], [part[1 + FEATURES :].reshape(FEATURES, FEATURES) for part in sums], shrink, ridge
    )


def score(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, threshold: float = 0.7) -> DataFrame:
    """One row for each row of ``docs`` (``doc_id``, ``text``): doc_id, held_out, score (0 to 1), predicted.

    Labels are learnt from the rows that are not ``held_out`` (a condition on doc_id). A null or empty text gets the
    score of an empty text, a null doc_id is never learnt from; repeated rows are scored alike and learnt from each.
    Other columns are ignored; without rows of both classes every score is the classes' share; an empty table gives no rows.
    """
    values = document_statistics(docs)
    model = fit(values, labels, label, ~held_out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
            yield pa.record_batch({"doc_id": batch.column(0), "score": pa.array(model.scores(x))})

    scored = values.mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
