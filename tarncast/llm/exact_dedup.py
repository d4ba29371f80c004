"""Exact duplicates by a 128-bit content hash, with the bytes compared inside each hash.

Everything is DataFrame functions. Equal texts are grouped by (hash, bytes): map-side aggregation
folds the copies of a task into one row, so a group that holds a third of all rows sends one row per
task. Documents then find their group by the hash alone; two different texts under one hash are
found by counting and resolved by their bytes.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarncast.session import durable


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does that for texts of one-byte characters, ``translate`` for the rest."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def equal_groups(docs: DataFrame, keep: str = "max", digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row for each row of ``docs`` (``doc_id``, ``text``): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. ``keep`` is
    "max" or "min": which doc_id of a group stays. A null doc_id is kept only when its group has no
    other. Rows that repeat a doc_id count as members each. Other columns are ignored; an empty table gives no rows.
    """
    keyed = docs.select(F.col("doc_id").alias("doc_id"), ascii_lower(F.coalesce(F.col("text"), F.lit(""))).alias("body"))
    keyed = keyed.select("doc_id", "body", digest(F.col("body")).alias("hash"))
    pick = F.max if keep == "max" else F.min
    groups = keyed.groupBy("hash", "body").agg(pick("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = durable(groups.select("hash", "keep_id", "group_size", F.sha2("body", 256).alias("text_sha256")))
    clash = durable(groups.groupBy("hash").count().filter("count > 1").select("hash"))
    ids = keyed.select("doc_id", "hash")
    if clash.isEmpty():
        found = ids.join(groups, "hash")
    else:
        clean = ids.join(clash, "hash", "left_anti").join(groups, "hash")
        mixed = keyed.join(clash, "hash", "left_semi")
        classes = mixed.groupBy("hash", "body").agg(pick("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        apart = mixed.join(classes.withColumn("text_sha256", F.sha2("body", 256)), ["hash", "body"])
        found = clean.select("doc_id", "keep_id", "group_size", "text_sha256").unionByName(apart.select("doc_id", "keep_id", "group_size", "text_sha256"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
