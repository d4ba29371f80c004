"""Building blocks of exact Jaccard self-joins by prefix filtering.

Items are sets of 64-bit token hashes computed from documents. Tokens are put in one global order,
rare ones first: by a fixed-size count sketch over all items, then by hash. Any global order gives
exact results; the sketch only decides how short the lists are. Two sets of Jaccard similarity t
or more share a token among their first n - ceil(t n) + 1, so each item posts only those.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarncast.llm.components import components
from tarncast.llm.words import give_back, mix, text_batches
from tarncast.session import durable, work_path

NULL_ID = -(1 << 63)
SKETCH_BITS = 16
BUCKET_POSTINGS = 1 << 19
SHIFTS = 48
UNIT_SETS = 4_000
UNIT_TOKENS = 1 << 20
#: Rows of whole lists that are tested in one task's call.
UNIT_ROWS = 1 << 15
#: Bits that tell which documents are asked for.
MARK_BITS = 24
#: Pairs of a list or cluster that are looked at in one step.
CELLS = 1 << 18

#: From the texts of a slice: token hashes with repeats, the item of each (ascending), and each item's row and part of the row.
Items = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Similarity:
    """A threshold as a fraction, so that every test is done in whole numbers."""

    over: int = 75
    under: int = 100

    def linked(self, shared, a, b):
        return self.under * shared >= self.over * (a + b - shared)

    def prefix(self, n):
        """How many tokens of a set of size n must hold a shared one."""
        return n + (-self.over * n // self.under) + 1

    def lengths(self, a, b):
        """Whether sizes a and b can reach the threshold (numpy arrays or numbers)."""
        return self.under * np.minimum(a, b) >= self.over * np.maximum(a, b)

    def possible(self, most, a, b):
        """Whether an overlap of at most ``most`` can reach the threshold."""
        return (self.over + self.under) * most >= self.over * (a + b)

    def pair(self, n_a: Column, rem_a: Column, n_b: Column, rem_b: Column) -> Column:
        """Length and positional filter on columns: ``rem`` counts tokens from the shared one on."""
        size = self.under * F.least(n_a, n_b) >= self.over * F.greatest(n_a, n_b)
        return size & ((self.over + self.under) * F.least(rem_a, rem_b) >= self.over * (n_a + n_b))


def rarity(docs: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """Counts of token occurrences by the top bits of the hash, over all items, and their sum."""
    cells = 1 << SKETCH_BITS

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, dtype=np.int64)
        for _, texts in text_batches(batches):
            total += np.bincount((items(texts)[0] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=cells)
        used = np.flatnonzero(total)
        yield pa.record_batch({"cells": pa.array([used.tolist()], pa.list_(pa.int32())), "counts": pa.array([total[used].tolist()], pa.list_(pa.int64()))})
        give_back()

    rows = docs.select("text").mapInArrow(count, "cells array<int>, counts array<bigint>")
    each = rows.select(F.explode(F.arrays_zip("cells", "counts")).alias("x")).groupBy(F.col("x.cells").alias("cell")).agg(F.sum("x.counts").alias("n"))
    sketch = np.zeros(cells, dtype=np.int64)
    for row in each.toLocalIterator():  # at most 2**SKETCH_BITS rows
        sketch[row["cell"]] = row["n"]
    return sketch, int(sketch.sum())


@dataclass
class Sets:
    """The items of a slice that have tokens: distinct tokens in hash order, bounds, 128-bit names, rows and parts."""

    tokens: np.ndarray
    bounds: np.ndarray
    names: np.ndarray  # two unsigned 64-bit numbers for each item
    rows: np.ndarray
    parts: np.ndarray

    @staticmethod
    def of(texts: list[bytes], items: Items) -> Sets:
        tokens, owner, rows, parts = items(texts)
        used, owner = np.unique(owner, return_inverse=True)
        owner = owner.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32)  # 16 bits sort fastest
        by = np.argsort(tokens)
        by = by[np.argsort(owner[by], kind="stable")]
        tokens, owner = tokens[by], owner[by]
        if len(tokens):
            fresh = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])])
            tokens, owner = tokens[fresh], owner[fresh]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(used)))]).astype(np.int64)
        return Sets(tokens, bounds, set_names(tokens, bounds), rows[used], parts[used])

    def parities(self) -> list[bytes]:
        """A bit array for each set, of a power of two of bits, twice its size or more: whether an odd number of its tokens fall on a bit.

        Two arrays differ in no more bits than the sets differ in tokens. An array of half the size is the exclusive or of its halves.
        """
        sizes = np.diff(self.bounds)
        bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * sizes, 1))).astype(np.int64))
        ends = np.cumsum(bits)
        first = ends - bits
        place = np.repeat(first, sizes) + (self.tokens & np.repeat(bits - 1, sizes).astype(np.uint64)).astype(np.int64)
        odd = np.bincount(place, minlength=int(bits.sum())).astype(np.uint8) & 1
        blob = np.packbits(odd, bitorder="little").tobytes()
        return [blob[at // 8 : end // 8] for at, end in zip(first.tolist(), ends.tolist(), strict=True)]

    def sids(self) -> list[bytes]:
        blob = self.names.astype(">u8").tobytes()
        return [blob[at : at + 16] for at in range(0, len(blob), 16)]

    def prefixes(self, order: np.ndarray, like: Similarity) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of all prefixes, the item of each and its place in the item's order."""
        sizes = np.diff(self.bounds)
        owner = np.repeat(np.arange(len(sizes)), sizes).astype(np.uint16 if len(sizes) <= 1 << 16 else np.uint32)
        by = np.argsort(order[(self.tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
        by = by[np.argsort(owner[by], kind="stable")]
        place = np.arange(len(by)) - np.repeat(self.bounds[:-1], sizes)
        kept = place < np.repeat(like.prefix(sizes), sizes)
        return self.tokens[by][kept], owner[kept].astype(np.int64), place[kept]


def set_names(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128 bits that name each set: two sums over its tokens."""
    if len(bounds) == 1:
        return np.zeros((0, 2), np.uint64)
    one = np.add.reduceat(mix(tokens), bounds[:-1])
    two = np.add.reduceat(mix(tokens ^ np.uint64(0x94D049BB133111EB)), bounds[:-1])
    return np.stack([one, two ^ np.diff(bounds).astype(np.uint64)], axis=1)


class Parities:
    """The bit arrays of many sets, by size, folded to smaller sizes when first asked for."""

    def __init__(self, arrays: list[bytes]):
        self.arrays = [np.frombuffer(own, dtype=np.uint64) for own in arrays]
        self.width = np.array([len(own) for own in self.arrays], dtype=np.int64)
        self.folded: dict[tuple[int, int], np.ndarray] = {}
        self.places = {int(width): np.flatnonzero(self.width == width) for width in np.unique(self.width)}
        self.row = np.zeros(len(arrays), np.int64)
        for own in self.places.values():
            self.row[own] = np.arange(len(own))

    def of_width(self, width: int, to: int) -> np.ndarray:
        if (width, to) not in self.folded:
            whole = np.stack([self.arrays[at] for at in self.places[width]])
            self.folded[width, to] = np.bitwise_xor.reduce(whole.reshape(len(whole), -1, to), axis=1)
        return self.folded[width, to]

    def differ(self, at: int, others: np.ndarray) -> np.ndarray:
        """A number of tokens that set ``at`` differs in from each of ``others`` at least."""
        out = np.zeros(len(others), np.int64)
        for width, _ in self.places.items():
            chosen = np.flatnonzero(self.width[others] == width)
            if len(chosen):
                to = min(width, int(self.width[at]))
                own = np.bitwise_xor.reduce(self.arrays[at].reshape(-1, to), axis=0)
                out[chosen] = np.bitwise_count(self.of_width(width, to)[self.row[others[chosen]]] ^ own).sum(axis=1)
        return out


def likely(pairs: DataFrame, like: Similarity) -> DataFrame:
    """The pairs (a, n_a, bits_a, b, n_b, bits_b; more columns may follow) whose bit arrays leave room for the threshold, without the arrays."""
    left = pairs.drop("bits_a", "bits_b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(name).to_numpy().astype(np.int64) for name in ("n_a", "n_b"))
            differ = np.zeros(len(batch), np.int64)
            for at, pair in enumerate(zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist(), strict=True)):
                one, two = (np.frombuffer(own, dtype=np.uint64) for own in pair)
                to = min(len(one), len(two))
                differ[at] = np.bitwise_count(np.bitwise_xor.reduce(one.reshape(-1, to), axis=0) ^ np.bitwise_xor.reduce(two.reshape(-1, to), axis=0)).sum()
            kept = np.flatnonzero(like.possible((n_a + n_b - differ) // 2, n_a, n_b))
            yield pa.RecordBatch.from_arrays([batch.column(name) for name in names], names=names).take(pa.array(kept))

    names = left.columns
    return pairs.mapInArrow(run, left.schema)


def rank_of(sketch: np.ndarray) -> np.ndarray:
    """The sketch's counts on a fine logarithmic scale of 16 bits: the order of tokens."""
    return np.minimum(np.log2(sketch + 1) * 1000, 65535).astype(np.uint16)


def _pack(*columns: np.ndarray) -> bytes:
    return b"".join(column.tobytes() for column in columns)


def _unpack(values: list[bytes], *kinds: str) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    width = sum(np.dtype(kind).itemsize for kind in kinds)
    for value in values:
        count, at = len(value) // width, 0
        for part, kind in zip(parts, kinds, strict=True):
            part.append(np.frombuffer(value, dtype=kind, count=count, offset=at))
            at += count * np.dtype(kind).itemsize
    return [np.concatenate(part) for part in parts]


def post(docs: DataFrame, items: Items, order: tuple[np.ndarray, int], like: Similarity, grouped: bool) -> tuple[DataFrame, DataFrame]:
    """Token lists of two groups or more, and one row for each item that has tokens.

    Lists: tok, g, n, rem. ``tok`` names all tokens that have the same groups, with the largest ``rem`` of each.
    Items: id, part, n, sid (128-bit name of the set), g (64-bit name of its
    group), bits (its parities). A group is the items of one size and one prefix if ``grouped``, else of one set. Two
    groups under one g only bring more candidates. Both tables are stored in the shared folder.
    """
    sketch, total = order
    buckets = max(8, math.ceil(total * (1 - like.over / like.under) / BUCKET_POSTINGS))

    rank = rank_of(sketch)
    entry = pa.struct([("id", pa.int64()), ("part", pa.int32()), ("n", pa.int32()), ("sid", pa.binary()), ("g", pa.int64()), ("bits", pa.binary())])

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            sets = Sets.of(texts, items)
            if not len(sets.rows):
                continue
            ids = batch.column(batch.schema.get_field_index("id")).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            sizes = np.diff(sets.bounds).astype(np.int32)
            token, owner, place = sets.prefixes(rank, like)
            if grouped:
                starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                named = set_names(token, np.concatenate([starts, [len(token)]]))[:, 0] + mix(sizes.astype(np.uint64))
            else:
                named = sets.names[:, 0]
            group = mix(named).view(np.int64)
            light = pa.StructArray.from_arrays(
                [pa.array(ids[sets.rows]), pa.array(sets.parts.astype(np.int32)), pa.array(sizes), pa.array(sets.sids(), pa.binary()), pa.array(group), pa.array(sets.parities(), pa.binary())], fields=list(entry)
            )
            _, once = np.unique(group, return_index=True)  # a slice's copies post once
            posts = np.zeros(len(sizes), dtype=bool)
            posts[once] = True
            own = posts[owner]
            token, owner, place = token[own], owner[own], place[own]
            g, n, rem = group[owner], sizes[owner], (sizes[owner] - place).astype(np.int32)
            bucket = ((token >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            names, blobs = [], []
            for part in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
                names.append(int(bucket[part[0]]))
                blobs.append(_pack((token[part] & np.uint64(0xFFFFFFFF)).astype(np.uint32), g[part], n[part], rem[part]))
            names.append(names[len(light) % len(names)])
            blobs.append(None)
            listed = pa.ListArray.from_arrays(pa.array([*[None] * (len(names) - 1), 0, len(light)], pa.int32()), light)
            yield pa.record_batch({"bucket": pa.array(names, pa.int32()), "blob": pa.array(blobs, pa.binary()), "items": listed})
        give_back()

    kinds = ("<u4", "<i8", "<i4", "<i4")

    def lists(table: pa.Table) -> pa.Table:
        give_back()
        blobs = [value for value in table.column("blob").to_pylist() if value is not None]
        tok, g, n, rem = _unpack(blobs, *kinds) if blobs else [np.zeros(0, dtype=kind) for kind in kinds]
        by = np.lexsort((g, n, tok))
        tok, g, n, rem = tok[by], g[by], n[by], rem[by]
        if len(tok):
            fresh = np.concatenate([[True], (tok[1:] != tok[:-1]) | (g[1:] != g[:-1])])
            tok, g, n, rem = tok[fresh], g[fresh], n[fresh], rem[fresh]
        useful = np.zeros(len(tok), dtype=bool)
        for step in range(1, min(SHIFTS, len(tok) - 1) + 1):
            same = tok[step:] == tok[:-step]
            if not same.any():
                break
            least = np.minimum(rem[step:], rem[:-step])
            fits = same & like.lengths(n[step:].astype(np.int64), n[:-step]) & like.possible(least.astype(np.int64), n[step:], n[:-step])
            useful[step:] |= fits
            useful[:-step] |= fits
        else:
            if len(tok) > SHIFTS:  # a longer list stays whole
                far = np.flatnonzero(tok[SHIFTS:] == tok[:-SHIFTS])
                for value in np.unique(tok[far]):
                    useful[np.searchsorted(tok, value, "left") : np.searchsorted(tok, value, "right")] = True
        tok, g, n, rem = tok[useful], g[useful], n[useful], rem[useful]
        if len(tok):  # tokens of equal members are one list: its name is a sum over its members
            new = np.concatenate([[True], tok[1:] != tok[:-1]])
            names = mix(np.add.reduceat(mix(g.view(np.uint64)), np.flatnonzero(new)))[np.cumsum(new) - 1]
            by = np.lexsort((g, names))
            names, g, n, rem = names[by], g[by], n[by], rem[by]
            starts = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]) | (g[1:] != g[:-1])]))
            tok, g, n, rem = names[starts].view(np.int64), g[starts], n[starts], np.maximum.reduceat(rem, starts)
        found = pa.table({"tok": pa.array(tok.astype(np.int64)), "g": pa.array(g), "n": pa.array(n), "rem": pa.array(rem), "items": pa.nulls(len(tok), table.schema.field("items").type)})
        packed = table.column("items").drop_null()
        empty = [pa.nulls(len(packed), kind) for kind in (pa.int64(), pa.int64(), pa.int32(), pa.int32())]
        return pa.concat_tables([found, pa.table([*empty, packed], schema=found.schema)])

    item = "array<struct<id: bigint, part: int, n: int, sid: binary, g: bigint, bits: binary>>"
    posted = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").mapInArrow(emit, f"bucket int, blob binary, items {item}")
    path = work_path(docs.sparkSession, "lists")
    posted.groupBy("bucket").applyInArrow(lists, f"tok bigint, g bigint, n int, rem int, items {item}").write.parquet(path)
    stored = docs.sparkSession.read.schema(f"tok bigint, g bigint, n int, rem int, items {item}").parquet(path)
    found = durable(stored.filter("items is null").groupBy("tok", "g").agg(F.first("n").alias("n"), F.max("rem").alias("rem")))
    release(docs.sparkSession)
    return found, stored.filter("items is not null").select(F.explode("items").alias("x")).select("x.*")


def release(spark: SparkSession) -> None:
    """Spark removes the shuffle files of finished steps when the driver collects garbage; ask for it, so that disks hold one step at a time.

    On a cluster the last query's files stay until another query has run: call it behind a small one, or before the next large one.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def among(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows whose id may be in ``asked``: an id marks one of 2**``MARK_BITS`` bits, sent to all in at most 2**(``MARK_BITS`` - 6) words, so that other texts are not shuffled."""
    mark = F.pmod(F.xxhash64("id"), F.lit(1 << MARK_BITS))
    bit = F.expr("shiftleft(1L, cast(mark & 63 as int))")
    words = asked.select(mark.alias("mark")).select(F.shiftright("mark", 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("marks"))
    held = rows.withColumn("mark", mark).withColumn("word", F.shiftright("mark", 6)).join(F.broadcast(words), "word")
    return held.filter(F.col("marks").bitwiseAND(bit) != 0).drop("mark", "word", "marks")


def fetch(docs: DataFrame, items: Items, wanted: DataFrame) -> DataFrame:
    """The token arrays of the sets named in ``wanted`` (id, sid: any document that holds the set), stored: sid, tokens.

    A repeated doc_id may bring a set twice.
    """
    asked = durable(wanted.groupBy("id").agg(F.collect_set("sid").alias("sids")))  # at most the items of one document

    def arrays(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            asked_for = [set(value) for value in batch.column(batch.schema.get_field_index("sids")).to_pylist()]
            sids, blobs, sets = [], [], Sets.of(texts, items)
            for row, sid, first, last in zip(sets.rows, sets.sids(), sets.bounds[:-1], sets.bounds[1:], strict=True):
                if sid in asked_for[row]:
                    asked_for[row].discard(sid)
                    sids.append(sid)
                    blobs.append(sets.tokens[first:last].tobytes())
            yield pa.record_batch({"sid": pa.array(sids, pa.binary()), "tokens": pa.array(blobs, pa.binary())})
        give_back()

    rows = among(docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("id"), "text"), asked).join(asked, "id").select("text", "sids")
    path = work_path(docs.sparkSession, "arrays")
    release(docs.sparkSession)
    rows.mapInArrow(arrays, "sid binary, tokens binary").write.parquet(path)
    return docs.sparkSession.read.schema("sid binary, tokens binary").parquet(path)


def verify_pairs(pairs: DataFrame, arrays: DataFrame, like: Similarity) -> DataFrame:
    """The pairs (a, b, with sizes n_a, n_b) whose sets reach the threshold. A set with many partners is spread."""
    load = pairs.agg(F.sum(F.col("n_a").cast("bigint") + F.col("n_b"))).first()[0] or 0
    units = max(1, math.ceil(load / UNIT_TOKENS))
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(500)).cast("int").alias("spread"))
    placed = pairs.join(many, "a").select(F.pmod(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("spread"))), F.lit(units)).cast("int").alias("unit"), "a", "b")
    members = placed.select("unit", F.explode(F.array("a", "b")).alias("sid")).distinct().join(arrays, "sid")
    rows = members.select("unit", "sid", "tokens", F.lit(None).cast("binary").alias("b")).unionByName(
        placed.select("unit", F.col("a").alias("sid"), F.lit(None).cast("binary").alias("tokens"), "b")
    )

    def test(table: pa.Table) -> pa.Table:
        sets, ask = {}, []
        for sid, tokens, b in zip(*(table.column(name).to_pylist() for name in ("sid", "tokens", "b")), strict=True):
            if b is None:
                sets[sid] = np.frombuffer(tokens, dtype=np.uint64)
            else:
                ask.append((sid, b))
        good = []
        for a, b in ask:
            one, two = sets[a], sets[b]
            shared = len(np.intersect1d(one, two, assume_unique=True))
            if like.linked(shared, len(one), len(two)):
                good.append((a, b))
        return pa.table({"a": pa.array([a for a, _ in good], pa.binary()), "b": pa.array([b for _, b in good], pa.binary())})

    return rows.groupBy("unit").applyInArrow(test, "a binary, b binary")


class Trees:
    """A union-find forest over places 0 .. count - 1."""

    def __init__(self, root: list[int]):
        self.root = root

    def top(self, at: int) -> int:
        root = self.root
        while root[at] != at:
            root[at] = at = root[root[at]]
        return at

    def join(self, one: int, two: int) -> bool:
        """Whether they stood in two trees, which are one from now on."""
        one, two = self.top(one), self.top(two)
        self.root[two] = one
        return one != two


def pairings(blocks: np.ndarray, i: int, j: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of one block, or of the first of two, some at a time, and for each which places it is paired with: later ones, or the second block's."""
    step = max(1, CELLS // len(blocks))
    count = len(blocks) if i == j else int((blocks == i).sum())
    for first in range(0, count, step):
        places = np.arange(first, min(first + step, count))
        later = np.arange(len(blocks)) > places[:, None]
        yield places, later if i == j else later & (blocks == j)


def settle(rest: DataFrame, bits: DataFrame, fetched: Callable[[DataFrame], DataFrame], like: Similarity, ask: Callable, news: Callable) -> DataFrame:
    """Verify every pair of a list that ``ask`` wants: those links a, b that are ``news``.

    ``rest``: tok, sid, n, rem, note; ``bits``: sid, bits. Pairs of a list that pass the length and positional filters and whose bit arrays leave room for
    the threshold are candidates. A list gives a spanning forest of them, so at most its members less one as rows; what
    they connect is a cluster, and a cluster is tested whole, see ``verify_clusters``, on the tokens that ``fetched`` brings for its sets (sid, note).
    """
    rest = durable(rest)
    clusters = components(candidates(rest, bits, like, ask)).select(F.col("node").alias("sid"), F.col("label").alias("cluster"))
    members = durable(rest.select("sid", "n", "note").distinct().join(clusters, "sid"))
    return verify_clusters(members, fetched(members.select("sid", "note").distinct()), like, ask, news)


def candidates(rest: DataFrame, bits: DataFrame, like: Similarity, ask: Callable) -> DataFrame:
    """For each list a spanning forest (a, b) of its candidate pairs. A list of over ``UNIT_SETS`` members is dealt into blocks, tested two at a time."""
    size = rest.groupBy("tok").agg(F.count("*").alias("rows"), F.ceil(F.count("*") / F.lit(UNIT_SETS)).cast("int").alias("blocks"))
    size = durable(size.filter("rows > 1"))
    packs = max(1, math.ceil((size.filter("blocks = 1").agg(F.sum("rows")).first()[0] or 0) / UNIT_ROWS))
    placed = rest.join(size, "tok").join(bits, "sid").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    whole = F.col("blocks") == 1
    units = dealt.select(
        F.when(whole, F.pmod(F.xxhash64("tok"), F.lit(packs))).otherwise(F.col("tok")).alias("unit"),
        F.when(whole, -1).otherwise(F.least("block", "other")).alias("i"),
        F.when(whole, -1).otherwise(F.greatest("block", "other")).alias("j"),
        *("tok", "block", "sid", "n", "rem", "bits", "note"),
    )

    def forest(rows: list[tuple], i: int, j: int) -> list[tuple[bytes, bytes]]:
        rows.sort(key=lambda row: (row[0], row[1]))
        block, _, n, rem, bits, note = zip(*rows, strict=True)
        blocks, n, rem = np.array(block), np.array(n, dtype=np.int64), np.array(rem, dtype=np.int64)
        wanted, parities = ask(np.array([*note, None], dtype=object)[:-1]), None
        trees, found = Trees(list(range(len(rows)))), []
        for places, later in pairings(blocks, i, j):
            todo = later & like.lengths(n, n[places, None]) & like.possible(np.minimum(rem, rem[places, None]), n, n[places, None]) & wanted(places)
            for row in np.flatnonzero(todo.any(axis=1)):
                parities = parities or Parities(list(bits))
                at, others = int(places[row]), np.flatnonzero(todo[row])
                others = others[like.possible((n[others] + n[at] - parities.differ(at, others)) // 2, n[others], n[at])]
                found += [(rows[at][1], rows[other][1]) for other in others.tolist() if trees.join(at, other)]
        return found

    def test(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        lists: dict[int, list[tuple]] = {}
        for tok, *row in zip(*(table.column(name).to_pylist() for name in ("tok", "block", "sid", "n", "rem", "bits", "note")), strict=True):
            lists.setdefault(tok, []).append(tuple(row))
        found = list({pair for own in lists.values() for pair in forest(own, i, j)})
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    return units.groupBy("unit", "i", "j").applyInArrow(test, "a binary, b binary").distinct()


def verify_clusters(members: DataFrame, arrays: DataFrame, like: Similarity, ask: Callable, news: Callable) -> DataFrame:
    """Test all pairs that ``ask`` wants inside each cluster: those links a, b that are ``news``.

    ``members``: cluster, sid, n, note (one row for each set). A cluster of up to ``UNIT_TOKENS`` tokens and ``UNIT_SETS`` sets is
    sent once, small ones together; a larger one is dealt into blocks of that size and tested two blocks at a time, so its rows are the
    square of its size over the block's, and no pair is ever a row. ``ask(notes)`` makes a function of some places that tells, a row for each, which sets are to be tested against it, and
    ``news(notes)`` makes a function of two linked places that tells whether their link says more than the links before it: few enough do, however many there are.
    """
    blocks = F.greatest(F.ceil(F.count("*") / F.lit(UNIT_SETS)), F.ceil(F.sum("n") / F.lit(UNIT_TOKENS))).cast("int").alias("blocks")
    size = durable(members.groupBy("cluster").agg(blocks, F.sum("n").alias("tokens")))
    packs = max(1, math.ceil((size.filter("blocks = 1").agg(F.sum("tokens")).first()[0] or 0) / UNIT_TOKENS))
    placed = members.join(size, "cluster").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    whole = F.col("blocks") == 1
    units = dealt.select(
        F.when(whole, F.pmod(F.xxhash64("cluster"), F.lit(packs)).cast("string")).otherwise(F.hex("cluster")).alias("unit"),
        F.when(whole, -1).otherwise(F.least("block", "other")).alias("i"),
        F.when(whole, -1).otherwise(F.greatest("block", "other")).alias("j"),
        "cluster",
        "block",
        "sid",
        "note",
    )

    def links(rows: list[tuple], i: int, j: int) -> list[tuple[bytes, bytes]]:
        """Pairs of one block, or across two, that reach the threshold; shared tokens are counted from a list of holders for each token."""
        rows.sort(key=lambda row: (row[0], row[1]))
        notes = np.array([row[2] for row in rows] + [None], dtype=object)[:-1]
        blocks = np.array([row[0] for row in rows])
        sets = [np.frombuffer(row[3], dtype=np.uint64) for row in rows]
        sizes = np.array([len(own) for own in sets], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        owner = np.repeat(np.arange(len(rows)), sizes)
        flat = np.concatenate(sets)
        by = np.argsort(flat, kind="stable")
        new = np.concatenate([[True], flat[by][1:] != flat[by][:-1]])
        firsts = np.flatnonzero(new)
        lasts = np.concatenate([firsts[1:], [len(flat)]])
        group = np.empty(len(flat), np.int64)
        group[by] = np.cumsum(new) - 1
        holders = owner[by]
        wanted, told, found = ask(notes), news(notes), []
        for tested, later in pairings(blocks, i, j):
            todo = later & like.lengths(sizes, sizes[tested, None]) & wanted(tested)
            for row in np.flatnonzero(todo.any(axis=1)):
                at = int(tested[row])
                own = group[starts[at] : starts[at + 1]]
                counts = lasts[own] - firsts[own]
                places = np.repeat(firsts[own] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                shared = np.bincount(holders[places], minlength=len(rows))
                found += [(rows[at][1], rows[other][1]) for other in np.flatnonzero(todo[row] & like.linked(shared, sizes[at], sizes)).tolist() if told(at, other)]
        return found

    def test(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        clusters: dict[bytes, dict[bytes, tuple]] = {}
        for cluster, sid, note, block, tokens in zip(*(table.column(name).to_pylist() for name in ("cluster", "sid", "note", "block", "tokens")), strict=True):
            clusters.setdefault(cluster, {})[sid] = (block, sid, note, tokens)
        found = [pair for own in clusters.values() for pair in links(list(own.values()), i, j)]
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    joined = units.join(arrays, "sid")
    return joined.groupBy("unit", "i", "j").applyInArrow(test, "a binary, b binary")
