"""Token ids in length-delimited binary record files, with a separate offset index.

File format: a file is a run of frames, each
    length of the payload, unsigned 64-bit
    masked crc32 of those 8 bytes, unsigned 32-bit
    payload
    masked crc32 of the payload, unsigned 32-bit
    one newline byte
Payload: doc_id (signed 64-bit), 1 if there is a doc_id else 0 (one byte), bytes of an id, 2 or 4 (one
byte), ids. All integers are little-endian. A masked checksum is the crc32 turned right by 15 bits plus
0xA282EAD8, so that a checksum over data that hold checksums stays meaningful.

Files are written by Spark's text writer, one frame a row: its commit protocol and any file system
that it reaches serve the binary files too. They are read whole by the binaryFile source; on a mounted
file system ``read_record`` reads one frame by its index entry.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarncast.llm.tokens import word_ids
from tarncast.llm.words import text_batches

SHARD_BYTES = 16 << 20
INDEX = "file string, offset bigint, size bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint, in_file bigint"


def masked(data: bytes) -> int:
    value = zlib.crc32(data)
    return (((value >> 15) | (value << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = len(ids) and int(ids.max()) > 0xFFFF
    payload = struct.pack("<qBB", doc_id or 0, doc_id is not None, 4 if wide else 2) + ids.astype("<u4" if wide else "<u2").tobytes()
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked(head)) + payload + struct.pack("<I", masked(payload)) + b"\n"


def parse(data: bytes, at: int = 0) -> tuple[int | None, np.ndarray, int]:
    """doc_id, ids and the end of the frame at ``at``; ValueError when a checksum or the frame is wrong."""
    head = data[at : at + 8]
    if len(data) < at + 12 or struct.unpack_from("<I", data, at + 8)[0] != masked(head):
        raise ValueError(f"broken frame length at byte {at}")
    size = struct.unpack("<Q", head)[0]
    payload = data[at + 12 : at + 12 + size]
    end = at + 12 + size
    if len(data) < end + 5 or struct.unpack_from("<I", data, end)[0] != masked(payload) or data[end + 4] != 10:
        raise ValueError(f"broken frame at byte {at}")
    doc_id, known, width = struct.unpack_from("<qBB", payload)
    ids = np.frombuffer(payload, dtype=f"<u{width}", offset=10).astype("<u4")
    return (doc_id if known else None), ids, end + 5


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode every whole text, append ``end_id``, and write frames in ascending doc_id order, file after file.

    A null or empty text is ``end_id`` alone; a null doc_id comes first; rows of one doc_id go by text. The documents are
    range-partitioned before they are encoded, so each text is encoded once.
    """
    size = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        for batch, texts in text_batches(batches):
            doc_ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            frames = [frame(doc_id, np.append(words.encode(text.decode("utf-8", "replace")), np.uint32(end_id)))[:-1] for doc_id, text in zip(doc_ids, texts, strict=True)]
            yield pa.record_batch({"frame": pa.array(frames, pa.binary())})

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = rows.repartitionByRange(max(1, math.ceil(size / shard_bytes)), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows.mapInArrow(encode, "frame binary").select(F.col("frame").cast("string")).write.option("compression", "none").text(path)


def write_index(spark: SparkSession, path: str, index: str) -> None:
    """Read all files, check every frame and write where each record is; ``in_file``: ids before it in its file."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                data, at, before, out = data.as_py(), 0, 0, []
                while at < len(data):
                    doc_id, ids, end = parse(data, at)
                    out.append((name.as_py().rsplit("/", 1)[-1], at, end - at, doc_id, len(ids), zlib.crc32(ids.tobytes()), before))
                    at, before = end, before + len(ids)
                if out:
                    kinds = (pa.string(), *[pa.int64()] * 6)
                    yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=[part.split()[0] for part in INDEX.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    files.select("path", "content").mapInArrow(scan, INDEX).write.parquet(index)


def read_index(spark: SparkSession, index: str) -> DataFrame:
    """One row for each record: doc_id, start (ids of all records before it), n_tokens, ids_crc32, file, offset, size."""
    rows = spark.read.schema(INDEX).parquet(index)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(files, "file").select("doc_id", (F.col("before") + F.col("in_file")).alias("start"), "n_tokens", "ids_crc32", "file", "offset", "size")


def read_record(folder: str, file: str, offset: int, size: int) -> tuple[int | None, np.ndarray]:
    """One record of a mounted folder, as a shuffled reader asks for it."""
    with open(f"{folder.removeprefix('file://')}/{file}", "rb") as source:
        source.seek(offset)
        doc_id, ids, _ = parse(source.read(size))
    return doc_id, ids
