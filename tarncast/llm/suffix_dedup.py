"""Repeated byte passages by sorting suffixes, exactly, over all documents.

Which suffixes. Every window of ``length`` bytes has one place chosen by its content alone: of its
``stride`` k-mers (k = length - stride + 1) the one of the lowest hash, the first of equals. Equal
windows have equal places at equal offsets, so it is enough to sort the suffixes that begin at such
places, about 2 in ``stride`` bytes, and to compare them with what stands around them.

Sorting. Suffix rows are range-partitioned by their leading bytes with splitters that Spark samples,
place included, so that even one passage that fills a third of the corpus is cut over many buckets.
A bucket is sorted by multikey quicksort over its 8-byte characters: the leading bytes, then hashes
of the whole k-mer and of the whole context. Neighbours in that order share k-mer and context. The
runs at the two ends of a bucket may go on in the next one: they are compared across boundaries by
one aggregate over those rows only.

Comparing. A context holds every window that contains the place: a k-mer of bytes and ``length - k``
bytes on both sides. Where a context occurs twice, all of it is covered. A context that occurs once,
while its k-mer occurs again, is compared byte for byte with the others of its k-mer, window by window.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarncast.llm.words import BASE, BASE_INVERSE, BYTE_VALUES, PLACES, SEGMENT, mix, power_table, text_batches
from tarncast.session import durable, work_path

BUCKET_ROWS = 400_000
SMALL = 12
GROUP_CONTEXTS = 20_000
PAIRED = 6
SECOND = int(PLACES[13])
SECOND_INVERSE = pow(SECOND, -1, 1 << 64)


def running(buffer: np.ndarray, base: int) -> np.ndarray:
    sums = np.zeros(len(buffer) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[buffer] * power_table(base, len(buffer)), out=sums[1:])
    return sums


def between(sums: np.ndarray, inverse: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (sums[last] - sums[first]) * power_table(inverse, len(sums))[first]


def places(buffer: np.ndarray, starts: np.ndarray, length: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """The chosen places of all windows inside texts that begin at ``starts`` (with the end as last), and the k-mer hashes."""
    k = length - stride + 1
    sums = running(buffer, BASE)
    count = len(buffer) - k + 1
    inverse = power_table(BASE_INVERSE, len(buffer) + 1)
    kmers = mix((sums[k : k + count] - sums[:count]) * inverse[:count])
    bits = np.uint64(max(24, int(count).bit_length()))  # the same for every buffer but of a text of over 16 MB
    keys = (kmers >> bits << bits) | np.arange(count, dtype=np.uint64)
    # The least key of each stride: the least of a block's tail and of the next block's head.
    padded = np.full(-(-count // stride) * stride, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:count] = keys
    blocks = padded.reshape(-1, stride)
    heads = np.minimum.accumulate(blocks, axis=1).ravel()
    tails = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(buffer) - length + 1
    least = np.minimum(tails[:windows], heads[stride - 1 : stride - 1 + windows])
    inside = np.zeros(windows + 1, dtype=np.int32)
    firsts, lasts = starts[:-1], starts[1:] - length + 1
    fits = lasts > firsts
    np.add.at(inside, firsts[fits], 1)
    np.add.at(inside, lasts[fits], -1)
    chosen = np.unique(least[np.cumsum(inside[:-1]) > 0] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return chosen, kmers


def suffix_rows(docs: DataFrame, length: int, stride: int) -> DataFrame:
    """For each chosen place: id, tag, at (its place in the text), lead (its first 8 bytes), kmer, ctx, ctx2."""
    k = length - stride + 1

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, limit=SEGMENT // 2):
            bounds = np.concatenate([[0], np.cumsum([len(text) for text in texts])])
            buffer = np.frombuffer(b"".join(texts), dtype=np.uint8)
            if len(buffer) < length:
                continue
            chosen, kmers = places(buffer, bounds, length, stride)
            owner = np.searchsorted(bounds, chosen, "right") - 1
            first = np.maximum(bounds[owner], chosen - (length - k))
            last = np.minimum(bounds[owner + 1], chosen + length)
            shape = ((chosen - first) * (2 * length) + (last - chosen)).astype(np.uint64)
            one = mix(between(running(buffer, BASE), BASE_INVERSE, first, last) + shape * PLACES[12])
            two = mix(between(running(buffer, SECOND), SECOND_INVERSE, first, last) + shape * PLACES[11])
            lead = np.zeros(len(chosen), dtype=np.uint64)
            for step in range(8):
                lead = (lead << np.uint64(8)) | buffer[chosen + step]
            rows = pa.array(owner)
            yield pa.record_batch(
                {
                    "id": batch.column(batch.schema.get_field_index("id")).take(rows),
                    "tag": batch.column(batch.schema.get_field_index("tag")).take(rows),
                    "at": pa.array(chosen - bounds[owner], pa.int32()),
                    "lead": pa.array((lead ^ np.uint64(1 << 63)).view(np.int64)),
                    "kmer": pa.array(kmers[chosen].view(np.int64)),
                    "ctx": pa.array(one.view(np.int64)),
                    "ctx2": pa.array(two.view(np.int64)),
                }
            )

    keyed = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("tag"), "text")
    return keyed.mapInArrow(emit, "id bigint, tag bigint, at int, lead bigint, kmer bigint, ctx bigint, ctx2 bigint")


def multikey_quicksort(characters: list[np.ndarray]) -> np.ndarray:
    """The order of suffixes given as columns of 8-byte characters: three-way splits on one character at a time."""
    order = np.arange(len(characters[0]))
    todo = [(0, len(order), 0)]
    while todo:
        first, last, depth = todo.pop()
        own = order[first:last]
        if last - first <= 1 or depth == len(characters):
            continue
        if last - first <= SMALL:
            order[first:last] = own[np.lexsort([column[own] for column in characters[depth:][::-1]])]
            continue
        values = characters[depth][own]
        probe = values[:: max(1, len(values) // 9)]
        pivot = np.sort(probe)[len(probe) // 2]
        less, same = values < pivot, values == pivot
        order[first:last] = np.concatenate([own[less], own[same], own[~(less | same)]])
        low, mid = first + int(less.sum()), first + int(less.sum() + same.sum())
        todo += [(first, low, depth), (low, mid, depth + 1), (mid, last, depth)]
    return order


OCCURRENCE = "id bigint, tag bigint, at int, kmer bigint, ctx bigint, ctx2 bigint, state int"
#: What a bucket says of an occurrence: all of its context is covered; to be compared in detail; alone of its context in
#: a run at the bucket's end; one for several of its context there.
COVERED, OPEN, EDGE, EDGES = 0, 1, 2, 3


def sort_buckets(rows: DataFrame, buckets: int) -> DataFrame:
    """Occurrences whose k-mer occurs again, with a state. A context that occurs twice in its bucket is settled there; of the
    first and last run of a bucket one row for each context goes on as EDGE or EDGES.
    """

    def settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        table = pa.Table.from_batches(got)
        column = {name: table.column(name).to_numpy() for name in ("lead", "kmer", "ctx", "ctx2")}
        if not len(table):
            return
        order = multikey_quicksort([column["lead"], column["kmer"], column["ctx"], column["ctx2"]])
        kmer, ctx, ctx2, lead = (column[name][order] for name in ("kmer", "ctx", "ctx2", "lead"))
        new_kmer = np.concatenate([[True], (kmer[1:] != kmer[:-1]) | (lead[1:] != lead[:-1])])
        new_ctx = new_kmer | np.concatenate([[True], (ctx[1:] != ctx[:-1]) | (ctx2[1:] != ctx2[:-1])])
        run, own = np.cumsum(new_kmer) - 1, np.cumsum(new_ctx) - 1
        run_size, own_size = np.bincount(run)[run], np.bincount(own)[own]
        contexts = np.bincount(run[new_ctx])[run]
        edge = (run == 0) | (run == run[-1])
        state = np.where(own_size > 1, COVERED, np.where(edge, EDGE, OPEN))
        kept = edge | (run_size > 1)
        # One of a repeated context also stands for it where its k-mer has, or may have, other contexts.
        extra = np.flatnonzero(new_ctx & (own_size > 1) & (edge | (contexts > 1)))
        at = np.concatenate([np.flatnonzero(kept), extra])
        states = np.concatenate([state[kept], np.where(edge[extra], EDGES, OPEN)])
        picked = table.take(pa.array(order[at]))
        yield from (
            pa.table([picked.column(name) for name in ("id", "tag", "at", "kmer", "ctx", "ctx2")] + [pa.array(states, pa.int32())], names=["id", "tag", "at", "kmer", "ctx", "ctx2", "state"])
            .combine_chunks()
            .to_batches()
        )

    return rows.repartitionByRange(buckets, "lead", "kmer", "ctx", "id", "at").mapInArrow(settle, OCCURRENCE)


def merge_edges(found: DataFrame) -> DataFrame:
    """Settle the rows of runs at buckets' ends by counting over all buckets, one row for each context and bucket."""
    edge = found.filter(F.col("state") >= EDGE)
    classes = edge.groupBy("kmer", "ctx", "ctx2").agg(F.sum(F.when(F.col("state") == EDGES, 2).otherwise(1)).alias("own"), F.min(F.struct("id", "tag", "at")).alias("one"))
    kmers = classes.groupBy("kmer").agg(F.sum("own").alias("run"), F.count("*").alias("contexts"))
    classes = durable(classes.join(kmers, "kmer").filter("run > 1"))
    alone = edge.filter(F.col("state") == EDGE).drop("state")
    members = alone.join(classes.filter("own > 1").select("kmer", "ctx", "ctx2"), ["kmer", "ctx", "ctx2"]).withColumn("state", F.lit(COVERED))
    one = classes.filter("contexts > 1").select("one.*", "kmer", "ctx", "ctx2", F.lit(OPEN).alias("state"))
    names = [part.split()[0] for part in OCCURRENCE.split(", ")]
    return members.select(names).unionByName(one.select(names))


def agreement(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    size = min(len(a), len(b))
    a, b = a[:size], b[:size]
    if a == b:
        return size
    return int((np.frombuffer(a, np.uint8) != np.frombuffer(b, np.uint8)).argmax())


def compare_group(contexts: list[tuple[bytes, int]], length: int, k: int) -> list[list[tuple[int, int]]]:
    """For each (context, place in it) of one k-mer the covered runs as (first, last) places in the context.

    A few contexts are compared by pairs: how far both sides agree. Of more, the windows that begin the same distance before the
    place are compared as whole strings.
    """
    marks = [np.zeros(len(text) + 1, dtype=np.int32) for text, _ in contexts]
    if len(contexts) <= PAIRED:
        for (one, (a, at)), (two, (b, place)) in itertools.combinations(enumerate(contexts), 2):
            right = agreement(a[at:], b[place:])
            left = agreement(a[:at][::-1], b[:place][::-1])
            if left + right >= length:
                for which, middle in ((one, at), (two, place)):
                    marks[which][middle - left] += 1
                    marks[which][middle + right] -= 1
    for back in range(length - k + 1 if len(contexts) > PAIRED else 0):
        seen: dict[bytes, int] = {}
        for at, (text, place) in enumerate(contexts):
            begin = place - back
            if begin < 0 or begin + length > len(text):
                continue
            window = text[begin : begin + length]
            other = seen.setdefault(window, at)
            if other != at:
                for which in (at, other):
                    begin = contexts[which][1] - back
                    marks[which][begin] += 1
                    marks[which][begin + length] -= 1
    runs = []
    for mark in marks:
        covered = np.concatenate([[False], np.cumsum(mark[:-1]) > 0, [False]])
        edges = np.flatnonzero(covered[1:] != covered[:-1])
        runs.append([(int(a), int(b)) for a, b in zip(edges[0::2], edges[1::2], strict=True)])
    return runs


def compare_contexts(docs: DataFrame, opened: DataFrame, length: int, stride: int) -> DataFrame:
    """Covered runs (id, tag, first, last) of the contexts that share only their k-mer with others."""
    k = length - stride + 1
    asked = opened.groupBy("id", "tag").agg(F.collect_set(F.struct("at", "kmer")).alias("ats"))  # at most a text's places

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            ids, tags, ats = (batch.column(batch.schema.get_field_index(name)).to_pylist() for name in ("id", "tag", "ats"))
            out = [(id_, tag, x["at"], x["kmer"], text[max(0, x["at"] - (length - k)) : x["at"] + length]) for id_, tag, own, text in zip(ids, tags, ats, texts, strict=True) for x in own]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value, kind) for value, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["id", "tag", "at", "kmer", "context"]
                )

    keyed = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("tag"), "text")
    joined = keyed.join(asked.withColumnRenamed("id", "oid").withColumnRenamed("tag", "otag"), F.col("id").eqNullSafe(F.col("oid")) & (F.col("tag") == F.col("otag")))
    path = work_path(docs.sparkSession, "contexts")
    joined.select("id", "tag", "ats", "text").mapInArrow(cut, "id bigint, tag bigint, at int, kmer bigint, context binary").dropDuplicates(["id", "tag", "at"]).write.parquet(path)
    contexts = docs.sparkSession.read.schema("id bigint, tag bigint, at int, kmer bigint, context binary").parquet(path)
    size = contexts.groupBy("kmer").agg(F.count("*").alias("size"))
    sized = contexts.join(size, "kmer")

    def small(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by k-mer; a k-mer's contexts are at most GROUP_CONTEXTS."""
        group: list[tuple] = []

        def close():
            runs = compare_group([(context, min(at, length - k)) for _, _, at, _, context in group], length, k)
            return [(id_, tag, max(0, at - (length - k)) + first, max(0, at - (length - k)) + last) for (id_, tag, at, _, _), own in zip(group, runs, strict=True) for first, last in own]

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["id", "tag", "first", "last"])

        out: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(name).to_pylist() for name in ("id", "tag", "at", "kmer", "context")), strict=True):
                if group and group[0][3] != row[3]:
                    out += close()
                    group = []
                group.append(row)
            if out:
                yield batch_of(out)
                out = []
        if group:
            out += close()
        if out:
            yield batch_of(out)

    ordinary = sized.filter(F.col("size") <= GROUP_CONTEXTS).drop("size").repartition("kmer").sortWithinPartitions("kmer")
    runs = ordinary.mapInArrow(small, "id bigint, tag bigint, first int, last int")
    # A k-mer of more contexts: its windows are counted as rows, length - k + 1 for each context.
    begin = F.greatest(F.lit(0), F.col("at") - (length - k))
    crowded = sized.filter(F.col("size") > GROUP_CONTEXTS).withColumn("begin", begin)
    windows = crowded.withColumn("back", F.explode(F.sequence(F.lit(0), F.lit(length - k)))).withColumn("from", F.col("at") - F.col("back"))
    windows = windows.filter((F.col("from") >= F.col("begin")) & (F.col("from") - F.col("begin") + length <= F.octet_length("context")))
    windows = windows.select("id", "tag", "from", F.sha2(F.substring("context", F.col("from") - F.col("begin") + 1, F.lit(length)), 256).alias("window")).distinct()  # two places may bring one window
    often = windows.groupBy("window").agg(F.count("*").alias("n")).filter("n > 1").select("window")
    more = windows.join(often, "window").select("id", "tag", F.col("from").alias("first"), (F.col("from") + length).alias("last"))
    return runs.unionByName(more)


def repeated_passages(docs: DataFrame, length: int = 400, stride: int | None = None) -> DataFrame:
    """One row for each row of ``docs`` (``doc_id``, ``text``): doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept.

    A byte is removed when it lies in a string of ``length`` bytes of the UTF-8 text that begins at
    another place of any text too, the same text included; matches never cross documents and are
    judged on the input. ``kept`` holds the bytes that stay (they may split a character). A null text is empty; texts shorter than
    ``length`` stay whole; equal rows, also under one doc_id or a null one, are copies of each other.
    Other columns are ignored; an empty table gives no rows.
    """
    stride = stride or length // 2 + 1
    k = length - stride + 1
    if length < 16 or k < 8:
        raise ValueError("length must be 16 or more, and its k-mers 8 bytes or more")
    spark = docs.sparkSession
    path = work_path(spark, "suffixes")
    suffix_rows(docs, length, stride).write.parquet(path)
    rows = spark.read.schema("id bigint, tag bigint, at int, lead bigint, kmer bigint, ctx bigint, ctx2 bigint").parquet(path)
    path = work_path(spark, "runs")
    sort_buckets(rows, max(2, math.ceil(rows.count() / BUCKET_ROWS))).write.parquet(path)
    found = spark.read.schema(OCCURRENCE).parquet(path)
    settled = durable(found.filter(F.col("state") < EDGE).unionByName(merge_edges(found)))
    covered = settled.filter(F.col("state") == COVERED).select("id", "tag", F.greatest(F.lit(0), F.col("at") - (length - k)).alias("first"), (F.col("at") + length).alias("last"))
    detail = compare_contexts(docs, settled.filter(F.col("state") == OPEN), length, stride)
    runs = covered.unionByName(detail).groupBy("id", "tag").agg(F.collect_set(F.struct("first", "last")).alias("runs"))  # at most a text's places
    runs = durable(runs)

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            out = []
            for text, own in zip(texts, batch.column(batch.schema.get_field_index("runs")).to_pylist(), strict=True):
                spans: list[list[int]] = []
                for first, last in sorted((run["first"], min(run["last"], len(text))) for run in own or []):
                    if spans and first <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], last)
                    else:
                        spans.append([first, last])
                at, kept = 0, []
                for first, last in spans:
                    kept.append(text[at:first])
                    at = last
                kept = b"".join([*kept, text[at:]])
                out.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, kind) for v, kind in zip(zip(*out, strict=True), kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("own"), "text")
    joined = keyed.join(runs, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("tag")), "left")
    return joined.select("doc_id", "text", "runs").mapInArrow(remove, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
