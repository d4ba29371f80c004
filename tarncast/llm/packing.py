"""Best-fit packing of tokenised documents after a dominance reduction.

Only lengths matter to packing, and there are at most ``capacity`` of them: the instance is a
histogram of bounded size whatever the corpus. The plan is made on the histogram and applies to
runs of equal pieces at once; each piece finds its place by its rank among the pieces of its length.

Reduction (after Martello and Toth): a sequence's content dominates another that could be replaced
by it piece for piece. For the longest piece j left: if nothing fits beside it, {j} is fixed; if the longest
piece k that fits fills the sequence, or no two pieces fit beside j, or no two that fit together
are longer than k while three never fit, {j, k} dominates every other choice and is fixed for as many copies as there are. The
rest goes by best fit, longest first.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarncast.llm.tokens import word_ids
from tarncast.llm.words import give_back, text_batches
from tarncast.session import work_path

RANK_ROWS = 100_000
PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
RUN = ("length", "rank", "n", "sequence", "offset")


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32."""

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        for batch, texts in text_batches(batches):
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            out = []
            for doc_id, text in zip(ids, texts, strict=True):
                tokens = np.append(words.encode(text.decode("utf-8", "replace")), np.uint32(end_id)).astype("<u4")
                for number, first in enumerate(range(0, len(tokens), capacity)):
                    part = tokens[first : first + capacity]
                    out.append((doc_id, number, first, len(part), zlib.crc32(part.tobytes())))
            columns = zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in columns], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(pieces, PIECE)


class Plan:
    """Runs of pieces and where they go: pieces [rank, rank + n) of a length go to sequences [sequence, sequence + n) at one offset."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, count in counts.items():
            self.left[length] = count
        self.ranks = np.zeros(capacity + 1, dtype=np.int64)
        self.sequences = 0
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.reduce()
        self.reduced = self.sequences
        self.best_fit()

    def place(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.runs.append((length, int(self.ranks[length]), count, sequence, offset))
        self.ranks[length] += count
        self.left[length] -= count

    def fix(self, first: int, second: int | None) -> None:
        if second is None:
            count = int(self.left[first])
        elif first == second:
            count = int(self.left[first]) // 2
        else:
            count = int(min(self.left[first], self.left[second]))
        self.place(first, count, self.sequences, 0)
        if second is not None:
            self.place(second, count, self.sequences, first)
        self.sequences += count

    def fitting(self, room: int, but: int | None = None) -> int:
        """The longest length left that fits, 0 if none; ``but``: one piece of that length is in use."""
        present = np.flatnonzero(self.left[: max(0, room) + 1])
        for length in present[::-1]:
            if length != but or self.left[length] > 1:
                return int(length)
        return 0

    def smallest(self, number: int, but: int) -> list[int]:
        """Lengths of the smallest pieces left beside one of ``but``."""
        found: list[int] = []
        for length in np.flatnonzero(self.left):
            found += [int(length)] * min(number, int(self.left[length]) - (length == but))
            if len(found) >= number:
                break
        return found[:number]

    def best_pair(self, room: int, but: int) -> int:
        """The longest two pieces that fit together beside one of ``but``."""
        best = 0
        for one in np.flatnonzero(self.left[: room + 1]):
            if one == but and self.left[one] < 2:
                continue
            for two in np.flatnonzero(self.left[: room - one + 1])[::-1]:
                if two <= one and int(self.left[two]) >= 1 + (two == one) + (two == but):
                    best = max(best, int(one + two))
                    break
        return best

    def reduce(self) -> None:
        for longest in range(self.capacity, 0, -1):
            while self.left[longest]:
                room = self.capacity - longest
                beside = self.fitting(room, longest)
                small = self.smallest(3, longest)
                if not beside:
                    self.fix(longest, None)
                elif beside == room or len(small) < 2 or small[0] + small[1] > room:
                    self.fix(longest, beside)
                elif (len(small) < 3 or sum(small) > room) and self.best_pair(room, longest) <= beside:
                    self.fix(longest, beside)
                else:
                    break

    def best_fit(self) -> None:
        rooms: dict[int, list[tuple[int, int]]] = {}
        open_rooms = np.zeros(self.capacity + 1, dtype=bool)
        for length in range(self.capacity, 0, -1):
            while self.left[length]:
                at = np.flatnonzero(open_rooms[length:])
                if len(at):
                    room = length + int(at[0])
                    first, count = rooms[room].pop()
                    used = min(count, int(self.left[length]))
                    if used < count:
                        rooms[room].append((first + used, count - used))
                    open_rooms[room] = bool(rooms[room])
                else:
                    room = self.capacity
                    used = -(-int(self.left[length]) // (room // length))
                    first, self.sequences = self.sequences, self.sequences + used
                self.place(length, used, first, self.capacity - room)
                rooms.setdefault(room - length, []).append((first, used))
                open_rooms[room - length] = room > length


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are those of its whole text and ``end_id``; a null or empty text is that one id.
    Only documents longer than ``capacity`` are cut. Every sequence is gapless from 0. A repeated or
    null doc_id is a document of its own for each row; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    path = work_path(spark, "pieces")
    cut_pieces(docs, tokenizer, capacity, end_id).write.parquet(path)
    pieces = spark.read.schema(PIECE).parquet(path)
    counts = {row["length"]: row["n"] for row in pieces.groupBy("length").agg(F.count("*").alias("n")).toLocalIterator()}  # at most ``capacity`` rows
    plan = Plan(counts, capacity)
    # An Arrow table: a list of rows would start a second set of Python workers on every executor.
    runs = spark.createDataFrame(pa.table(dict(zip(RUN, zip(*plan.runs or [(0,) * len(RUN)], strict=True), strict=True)), pa.schema([(name, pa.int64()) for name in RUN]))).filter("n > 0")

    # The rank of a piece among those of its length: dealt to slots, counted, then numbered inside each slot.
    slots = max(1, math.ceil(sum(counts.values()) / RANK_ROWS))
    dealt = pieces.withColumn("slot", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slots)).cast("int"))
    before = Window.partitionBy("length").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("length", "slot").agg(F.count("*").alias("n")).select("length", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("length", "slot").orderBy("doc_id", "piece", "ids_crc32")) - 1
    path = work_path(spark, "ranks")
    dealt.withColumn("number", number).join(sizes, ["length", "slot"]).withColumn("rank", F.col("before") + F.col("number")).drop("slot", "number", "before").write.parquet(path)
    ranked = spark.read.parquet(path)

    # Each run of ranks is found by the last run that begins at or before the piece.
    marks = runs.select("length", F.col("rank").alias("rank"), F.struct(F.col("rank").alias("from"), "sequence", "offset").alias("run"))
    starts = marks.groupBy("length").agg(F.sort_array(F.collect_list("run")).alias("runs"))  # a plan's runs of one length
    found = ranked.join(starts, "length").withColumn("run", F.expr("element_at(filter(runs, x -> x.from <= rank), -1)"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("run.sequence") + F.col("rank") - F.col("run.from")).alias("sequence_id"), F.col("run.offset").alias("offset"))
