"""Toxicity by a convolutional text classifier, written and trained in numpy.

A word's embedding is the sum of hashed embeddings of the word and of its first three, five and seven bytes,
in lower case, so that inflected and punctuated forms share most of it. Filters of several widths run over the whole text, the
largest response of each is kept, and a linear layer gives a logit. The model is fitted on two thirds of the
labelled rows: Spark deals them into parts of a bounded size, every part trains a copy of the network, and the copies
are averaged after each round. Thresholds are set for each language, told from the text's own function words, from
counts of all other labelled rows, and scores are shifted so that the threshold is always ``CUT``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarncast.llm.setjoin import release
from tarncast.llm.words import PLACES, give_back, mix, text_batches, word_features, word_hashes
from tarncast.session import work_path

BITS, DEPTH, FILTERS, WIDTHS = 15, 12, 12, (1, 2, 3)
STEMS = (3, 5, 7)
CUT = 0.7
PART_BYTES, ROUNDS, SLICE_BYTES = 8 << 20, 4, 1 << 19
#: Logits are counted in cells of 1 / GRID, the outer cells open.
GRID, REACH = 128, 32
PART_COLUMNS = "part int, rows array<struct<deal: bigint, text: string, y: int>>"
MEAN_COLUMNS = "part int, rows bigint, flat binary"
MEANS = pa.schema([("part", pa.int32()), ("rows", pa.int64()), ("flat", pa.binary())])
BATCH_WORDS, EPOCHS, STEPS, RATE, DECAY = 24_000, 6, 400, 0.01, 0.3

#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on are with as be at by this from or an",
    "de": "der die und das von zu mit den des im ist nicht auf ein eine sich dem auch wie für",
    "fr": "le la les et des du un une est pour dans qui sur au ce pas avec plus par ne",
    "es": "el los las y que del se por con una para su al lo como más o pero sus es",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]


def language_table() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the function words, sorted, and their languages."""
    words = [(word.encode(), at) for at, text in enumerate(FUNCTION_WORDS.values()) for word in text.split()]
    hashes, _ = word_hashes([word for word, _ in words])
    by = np.argsort(hashes)
    return hashes[by], np.array([at for _, at in words])[by]


FUNCTION_HASHES, FUNCTION_LANGUAGES = language_table()


def languages(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The language with most function words in each text; the last place when there is none."""
    rows = len(bounds) - 1
    at = np.minimum(np.searchsorted(FUNCTION_HASHES, hashes), len(FUNCTION_HASHES) - 1)
    known = FUNCTION_HASHES[at] == hashes
    row = np.repeat(np.arange(rows), np.diff(bounds))[known]
    votes = np.bincount(row * len(FUNCTION_WORDS) + FUNCTION_LANGUAGES[at[known]], minlength=rows * len(FUNCTION_WORDS)).reshape(rows, -1)
    return np.where(votes.max(axis=1) > 0, votes.argmax(axis=1), len(FUNCTION_WORDS))


def lowered(text: bytes) -> bytes:
    """The text in lower case; A-Z are lowered with the hashes, so that only other letters need it here."""
    return text if text.isascii() else text.decode("utf-8", "replace").lower().encode()


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embedding rows of every word (words by 1 + stems), bounds of the texts, and their languages."""
    hashes, stems, bounds = word_features([lowered(text) for text in texts], STEMS)
    cells = [hashes, *(stem + PLACES[at] for at, stem in enumerate(stems))]
    ids = np.stack([(mix(cell) >> np.uint64(64 - BITS)).astype(np.int32) for cell in cells], axis=1)
    return ids, bounds, languages(hashes, bounds)


@dataclass
class Network:
    """Hashed embeddings, one filter bank for each width, and the output layer."""

    embed: np.ndarray
    banks: np.ndarray  # DEPTH x (sum of widths x FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES), np.float32))
    slope: float = 1.0

    @staticmethod
    def fresh(seed: int = 7) -> Network:
        random = np.random.Generator(np.random.PCG64(seed))
        pools = len(WIDTHS) * FILTERS
        normal = lambda *shape, scale: (random.standard_normal(shape) * scale).astype(np.float32)
        return Network(normal(1 << BITS, DEPTH, scale=0.1), normal(DEPTH, sum(WIDTHS) * FILTERS, scale=0.3), np.zeros(pools, np.float32), normal(pools, scale=0.3), np.zeros(1, np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.banks, self.bias, self.out, self.out_bias]

    def flat(self) -> np.ndarray:
        """All parameters in one row."""
        return np.concatenate([p.ravel() for p in self.parameters()])

    def copy(self, flat: np.ndarray | None = None) -> Network:
        """A network of the same parameters, or of those in ``flat``."""
        parts = np.split(self.flat() if flat is None else flat, np.cumsum([p.size for p in self.parameters()])[:-1])
        return Network(*[part.reshape(p.shape).astype(np.float32) for part, p in zip(parts, self.parameters(), strict=True)])

    def responses(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Every filter at every place; a filter that would run over its text's end gives -inf there."""
        parts = words @ self.banks
        result = np.empty((len(words), len(WIDTHS) * FILTERS), np.float32)
        left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(words))
        column = 0
        for number, width in enumerate(WIDTHS):
            own = result[:, number * FILTERS : (number + 1) * FILTERS]
            own[:] = parts[:, column : column + FILTERS]
            for place in range(1, width):
                at = column + place * FILTERS
                own[:-place] += parts[place:, at : at + FILTERS]
            own[left < width] = -np.inf
            column += width * FILTERS
        return result

    def pooled(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest response of each filter in each text, and the responses."""
        full = np.full((len(bounds) - 1, len(WIDTHS) * FILTERS), -np.inf, np.float32)
        some = np.flatnonzero(np.diff(bounds))
        responses = self.responses(words, bounds)
        if len(some):
            full[some] = np.maximum.reduceat(responses, bounds[:-1][some], axis=0)
        return full, responses

    def words(self, ids: np.ndarray) -> np.ndarray:
        return self.embed[ids].sum(axis=1)

    def logits(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        pool, _ = self.pooled(self.words(ids), bounds)
        return np.maximum(pool + self.bias, 0) @ self.out + self.out_bias[0]

    def gradients(self, ids: np.ndarray, bounds: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
        """Gradients of the weighted log loss by the parameters, in their order."""
        words = self.words(ids)
        pool, responses = self.pooled(words, bounds)
        hidden = np.maximum(pool + self.bias, 0)
        chance = 1 / (1 + np.exp(-np.clip(hidden @ self.out + self.out_bias[0], -30, 30)))
        error = ((chance - labels) * weights / weights.sum()).astype(np.float32)
        to_pool = (error[:, None] * self.out) * (pool + self.bias > 0)
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        place, column = np.nonzero((responses == pool[owner]) & np.isfinite(responses))
        first = np.zeros(pool.shape, np.int64)
        first[owner[place[::-1]], column[::-1]] = place[::-1]  # the first of equal places stays
        row, column = np.nonzero(to_pool)
        value, at = to_pool[row, column], first[row, column]
        number = column // FILTERS
        to_parts = np.zeros((len(words), self.banks.shape[1]), np.float32)
        start = np.concatenate([[0], np.cumsum(WIDTHS)])[:-1] * FILTERS
        for which, width in enumerate(WIDTHS):
            own = number == which
            for step in range(width):
                np.add.at(to_parts, (at[own] + step, start[which] + step * FILTERS + column[own] % FILTERS), value[own])
        used = np.flatnonzero(to_parts.any(axis=1))
        to_words = to_parts[used] @ self.banks.T
        to_embed = np.zeros_like(self.embed)
        for part in range(ids.shape[1]):
            np.add.at(to_embed, ids[used, part], to_words)
        return [to_embed, words[used].T @ to_parts[used], to_pool.sum(axis=0), hidden.T @ error, np.array([error.sum()], np.float32)]


def slices(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of texts of about ``SLICE_BYTES``, so that what is made of them stays small."""
    first, size = 0, 0
    for at, text in enumerate(texts):
        if at > first and size + len(text) > SLICE_BYTES:
            yield texts[first:at]
            first, size = at, 0
        size += len(text)
    if first < len(texts):
        yield texts[first:]


def train(network: Network, texts: list[bytes], labels: np.ndarray, share: float, count: int = 1, seed: int = 7) -> None:
    """Adam over minibatches of about ``BATCH_WORDS`` words of one of ``count`` parts.

    The only part takes ``EPOCHS`` passes, one of several its share of ``ROUNDS`` passes in each round; ``STEPS`` steps at
    least over all parts and rounds. Both classes weigh the same over all rows, of which ``share`` are of class 1.
    """
    random = np.random.Generator(np.random.PCG64(seed))
    parts = [encode(part) for part in slices(texts)]
    ids = np.concatenate([part[0] for part in parts])
    bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(part[1]) for part in parts]))])
    del parts  # as large as ``ids``
    weights = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in network.parameters()]
    step = 0
    rounds = 1 if count == 1 else ROUNDS
    passes = max(EPOCHS if count == 1 else ROUNDS, -(-STEPS * BATCH_WORDS // max(1, count * len(ids))))
    for _ in range(-(-passes // rounds)):
        order = random.permutation(len(texts))
        sizes = np.cumsum(np.diff(bounds)[order] + 20)
        for batch in np.split(order, np.flatnonzero(np.diff(sizes // BATCH_WORDS)) + 1):
            own = np.concatenate([ids[bounds[doc] : bounds[doc + 1]] for doc in batch])
            own_bounds = np.concatenate([[0], np.cumsum(bounds[batch + 1] - bounds[batch])])
            step += 1
            for parameter, gradient, (mean, square) in zip(network.parameters(), network.gradients(own, own_bounds, labels[batch], weights[batch]), state, strict=True):
                mean += 0.1 * (gradient - mean)
                square += 0.001 * (gradient * gradient - square)
                parameter -= RATE * (DECAY * parameter + (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-4))


def gathered(key: tuple, table: pa.Table) -> pa.Table:
    """The rows of one part as one row."""
    rows = pa.StructArray.from_arrays([table[name].combine_chunks() for name in ("deal", "text", "y")], names=["deal", "text", "y"])
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "rows": pa.ListArray.from_arrays([0, len(rows)], rows)})


def learner(network: Network, share: float, count: int, number: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Trains a copy of the network on each part, given as one row; gives its parameters and the number of rows."""

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                part, rows = batch["part"][at].as_py(), batch["rows"][at].values
                found = sorted(zip(rows.field("deal").to_pylist(), rows.field("text").cast(pa.binary()).to_pylist(), rows.field("y").to_pylist(), strict=True))
                own = network.copy()
                train(own, [text for _, text, _ in found], np.array([y for _, _, y in found], np.float32), share, count, 7 + number)
                yield pa.record_batch([[part], [len(found)], [own.flat().tobytes()]], schema=MEANS)
                give_back()

    return learn


def mean(parts: Iterable[tuple[int, int, bytes]]) -> tuple[int, np.ndarray]:
    """The rows of all parts (part, rows, parameters), and the mean of their parameters by rows."""
    total, met = 0.0, 0
    for _, rows, flat in parts:
        total = total + np.frombuffer(flat, np.float32) * float(rows)
        met += rows
    return met, (total / met).astype(np.float32)


def averaged(key: tuple, table: pa.Table) -> pa.Table:
    """The mean of some parts; they are taken in their order, so that it is the same each time."""
    met, flat = mean(sorted(zip(*(table[name].to_pylist() for name in MEANS.names), strict=True)))
    return pa.table({"part": [key[0].as_py()], "rows": [met], "flat": [flat.tobytes()]}, MEANS)


def fit(rows: DataFrame, share: float, size: int) -> Network:
    """The network after ``ROUNDS`` rounds over all ``rows`` (y, deal, text) of ``size`` bytes; with one part, after one round.

    Every part is stored as one row, so that the rounds after the first shuffle no texts. Copies of the network are averaged in groups
    first: the driver gets the square root of their number.
    """
    spark = rows.sparkSession
    count = max(1, -(-size // PART_BYTES))
    dealt = rows.select(F.pmod(F.xxhash64("deal", "text"), F.lit(count)).cast("int").alias("part"), "y", "deal", "text")
    path = work_path(spark, "parts")
    dealt.repartition(count, "part").groupBy("part").applyInArrow(gathered, PART_COLUMNS).write.parquet(path)
    parts = spark.read.schema(PART_COLUMNS).parquet(path)
    network = Network.fresh()
    for number in range(ROUNDS if count > 1 else 1):
        copies = parts.mapInArrow(learner(network, share, count, number), MEAN_COLUMNS)
        if count > 1:
            copies = copies.groupBy(F.pmod("part", F.lit(math.isqrt(count))).alias("group")).applyInArrow(averaged, MEAN_COLUMNS)
        _, flat = mean(sorted((row["part"], row["rows"], bytes(row["flat"])) for row in copies.collect()))
        network = network.copy(flat)
        del copies  # so that the shuffle files of this round, or the one before, go
        release(spark)
    return network


def counted(rows: DataFrame, network: Network) -> np.ndarray:
    """How many of all ``rows`` (y, text) have each language, label and cell of logits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, limit=SLICE_BYTES):
            ids, bounds, spoken = encode(texts)
            cell = np.clip(np.floor(network.logits(ids, bounds) * GRID), -REACH * GRID, REACH * GRID - 1).astype(np.int32) + REACH * GRID
            yield pa.record_batch({"spoken": pa.array(spoken.astype(np.int32)), "y": batch["y"], "cell": pa.array(cell)})

    counts = np.zeros((len(LANGUAGES), 2, 2 * REACH * GRID))
    cells = rows.select("y", "text").mapInArrow(run, "spoken int, y int, cell int").groupBy("spoken", "y", "cell").count()
    for row in cells.toLocalIterator():  # at most as many as there are cells
        counts[row["spoken"], row["y"], row["cell"]] = row["count"]
    return counts


def calibrate(network: Network, counts: np.ndarray) -> None:
    """Set the threshold of each language where F1 is best, halfway between the logits around it, and a common slope.

    A language of few positives takes the threshold of all, in proportion.
    """
    logits = (np.arange(counts.shape[2]) + 0.5) / GRID - REACH

    def best(own: np.ndarray) -> float:
        """From counts by label and cell."""
        met = np.flatnonzero(own.sum(axis=0))[::-1]
        hits, marked = np.cumsum(own[1, met]), np.cumsum(own[:, met].sum(axis=0))
        at = int((2 * hits / (marked + max(1, hits[-1]))).argmax())
        value = logits[met[at]]
        after = logits[met[at + 1]] if at + 1 < len(met) else value - 1
        return float((value + after) / 2)

    everyone = counts.sum(axis=0)
    if not everyone[1].sum():
        network.thresholds[:] = logits[np.flatnonzero(everyone.sum(axis=0)).max()] + 1
        return
    common = best(everyone)
    for language, own in enumerate(counts):
        positives = own[1].sum()
        trust = positives / (positives + 20)
        network.thresholds[language] = trust * best(own) + (1 - trust) * common if positives else common
    distance = np.abs(logits - network.thresholds[:, None]).ravel()
    by = np.argsort(distance, kind="stable")
    reached = np.cumsum(counts.sum(axis=1).ravel()[by])
    network.slope = float(3 / max(1e-3, distance[by[np.searchsorted(reached, reached[-1] / 2)]]))


def scores(network: Network, texts: list[bytes]) -> np.ndarray:
    ids, bounds, spoken = encode(texts)
    value = network.slope * (network.logits(ids, bounds) - network.thresholds[spoken]) + np.log(CUT / (1 - CUT))
    return (1 / (1 + np.exp(-np.clip(value, -30, 30)))).astype(np.float64)


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column) -> DataFrame:
    """All labelled rows to learn from, stored: ``use`` 0 to fit on (two thirds of the ids), 1 to calibrate on, y, deal, text."""
    spark = docs.sparkSession
    known = labels.filter(F.col(label).isin(0, 1) & learn).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.withColumn("deal", F.xxhash64("doc_id", F.lit(11)))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter(learn)
    use = (F.pmod("deal", F.lit(3)) == 0).cast("int").alias("use")
    # Merged at every size: the disk then grows with the input, without a jump where labels get too many to be sent to all.
    rows = texts.join(known.hint("merge"), "doc_id").select(use, "y", "deal", "text")
    path = work_path(spark, "labelled")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def score(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, threshold: float = CUT, passed: list[str] | None = None) -> DataFrame:
    """One row for each row of ``docs`` (``doc_id``, ``text``): doc_id, held_out, score (0 to 1), predicted.

    Labels are learnt from rows that are not ``held_out`` (a condition on doc_id); null labels and ids are left out. Every
    whole text is scored; a null text is empty and gets the score of no words. With ``passed``, those columns of the
    row follow as a struct ``passed``. Repeated rows are scored alike; other
    columns are ignored; without both classes to learn from no text is marked; an empty table gives no rows.
    """
    rows = labelled(docs, labels, label, ~held_out)
    met = {(r["use"], r["y"]): r for r in rows.groupBy("use", "y").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()}
    release(docs.sparkSession)  # the join's files are no longer those of the last query
    if (0, 0) in met and (0, 1) in met:
        share = met[0, 1]["n"] / (met[0, 0]["n"] + met[0, 1]["n"])
        network = fit(rows.filter("use = 0"), share, met[0, 0]["size"] + met[0, 1]["size"])
        calibrate(network, counted(rows.filter("use = 1") if {use for use, _ in met} > {0} else rows, network))
    else:
        network = Network.fresh()
        network.thresholds[:] = 1e6
    return apply(docs, network, held_out, threshold, passed)


def apply(docs: DataFrame, network: Network, held_out: Column, threshold: float = CUT, passed: list[str] | None = None) -> DataFrame:
    """Score every row; the network travels with the function and has a fixed size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, limit=SLICE_BYTES):
            beside = {"passed": pa.StructArray.from_arrays([batch.column(at) for at in places], fields=[batch.schema.field(at).with_name(name) for at, name in zip(places, passed, strict=True)])} if passed else {}
            yield pa.record_batch({"doc_id": batch.column(0), "score": pa.array(scores(network, texts)), **beside})
        give_back()

    # The text itself goes to Python once, whether or not it is passed.
    others = [name for name in passed or [] if name != "text"]
    places = [1 if name == "text" else 2 + others.index(name) for name in passed or []]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *[F.col(f"`{name}`").alias(f"passed_{at}") for at, name in enumerate(others)])
    kind = docs.select(F.struct(*[F.col(f"`{name}`") for name in passed]).alias("passed")).schema["passed"].dataType.simpleString() if passed else ""
    scored = rows.mapInArrow(run, "doc_id bigint, score double" + (f", passed {kind}" if passed else ""))
    marked = (F.col("score") >= threshold).cast("int").alias("predicted")
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", marked, *["passed"] * bool(passed))
