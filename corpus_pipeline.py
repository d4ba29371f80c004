"""The corpus pipeline: toxic documents go, repeated lines go, one of each group of near copies stays,
documents that hold benchmark passages go, and the rest is packed into sequences.

Every stage takes (spark, docs, sf_dir); its result is stored and read again as the next one's docs.
All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tarncast.llm import decontaminate, jaccard_join, line_dedup, packing, toxicity
from tarncast.llm.catalog import share_of
from tarncast.llm.setjoin import NULL_ID, release
from tarncast.session import work_path

#: No stage is plain SQL from end to end: scores are learnt and tokens come from a vocabulary.
ORACLE_SQL = None


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until ``docs`` has no such column."""
    taken = {column.lower() for column in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs`` whose ``key``, a column that is never null, is not in ``dropped``'s only column."""
    gone = free_name(docs, "dropped_key")
    return docs.join(dropped.toDF(gone).distinct(), F.col(key) == F.col(gone), "left_anti").drop(key)


def own_ids(docs: DataFrame) -> bool:
    """Whether every row has a doc_id of its own, a whole number, so that it needs no other and no stored copy; ``NULL_ID`` stands for no id in the operators."""
    ids = docs.select("doc_id")
    if not isinstance(ids.schema[0].dataType, IntegralType):
        return False
    return ids.groupBy("doc_id").count().filter((F.col("count") > 1) | F.col("doc_id").isNull() | (F.col("doc_id") == NULL_ID)).isEmpty()


def numbered(spark: SparkSession, docs: DataFrame, nulls_last: bool) -> tuple[DataFrame, str]:
    """``docs``, stored, with a number for each row, and its column's name. Numbers rise by doc_id, then by content hash.

    A doc_id may be null or repeated; equal rows get numbers of their own.
    """
    key = free_name(docs, "row_key")
    doc_id = F.col("doc_id").asc_nulls_last() if nulls_last else F.col("doc_id").asc_nulls_first()
    order = [doc_id, F.sha2(F.coalesce("text", F.lit("")), 256), F.xxhash64(*[F.col(f"`{name}`") for name in docs.columns]), F.col(key)]
    path = work_path(spark, "numbered")
    docs.withColumn(key, F.monotonically_increasing_id()).sort(*order).withColumn(key, F.monotonically_increasing_id()).write.parquet(path)
    release(spark)
    return spark.read.parquet(path), key


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier rejects go; a document without words stays."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rated = toxicity.score(docs, labels, "toxic", share_of("doc_id", 3, 1), passed=docs.columns)
    return rated.filter("predicted <> 1").select("passed.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go, by doc_id (null first), content hash and line number, short lines too; every row stays, with n_chars counted anew where lines went."""
    own, rows = free_name(docs, "own_id"), docs.withColumn(free_name(docs, "own_id"), F.col("doc_id"))
    if not own_ids(docs):
        rows, key = numbered(spark, docs, nulls_last=False)
        rows = rows.withColumnsRenamed({"doc_id": own, key: "doc_id"})
    cleaned = line_dedup.clean_lines(rows, passed=[own, *[name for name in docs.columns if name not in ("doc_id", "text")]], short=True)
    columns = {"doc_id": F.col("passed").getField(own), "text": F.col("kept")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept")).otherwise(F.col("passed.n_chars")).cast(docs.schema["n_chars"].dataType)
    return cleaned.select(*[columns[name].alias(name) if name in columns else F.col("passed").getField(name).alias(name) for name in docs.columns])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: of the smallest doc_id that is not null, then of the smallest content hash. All rows without words stay."""
    if own_ids(docs):
        key = free_name(docs, "row_key")
        rows = docs.withColumn(key, F.col("doc_id"))
    else:
        rows, key = numbered(spark, docs, nulls_last=True)
    groups = jaccard_join.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"))
    return without(rows, groups.filter("component_id <> doc_id").select("doc_id"), key)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark passage go. That is told from the text alone, so its hash is the key."""
    key = free_name(docs, "text_key")
    rows = docs.withColumn(key, F.sha2(F.coalesce("text", F.lit("")), 256))
    leaks = decontaminate.find_leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=key)
    return without(rows, leaks.select("key"), key)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
