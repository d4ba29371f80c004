"""Every stage of the corpus pipeline, and the whole, against brute force, with null and repeated ids inside groups."""

import hashlib
from collections import Counter

import corpus_pipeline
import pytest
from conftest import invented
from pyspark.sql import functions as F
from test_copies import linked, shingles

from tarncast.llm import toxicity
from tarncast.llm.catalog import share_of
from tarncast.llm.decontaminate import align
from tarncast.llm.words import word_hashes

COPY, LINE, ITEM = invented(60, 1), invented(9, 2), invented(30, 3)
DOCS = [
    (None, COPY, "a"), (4, COPY, "b"), (5, f"{COPY} tail", "c"), (None, f"{COPY} end", "d"), (4, f"{COPY} more", "e"), (4, COPY, "b"),
    (7, f"{invented(40, 10)}\n{LINE}", "f"), (7, f"{invented(40, 11)}\n{invented(12, 12)}", "g"), (None, f"{invented(40, 13)}\n{LINE}\nAll rights reserved.", "h"), (2, f"{invented(40, 14)}\n{LINE}\n\nall rights  reserved.\n\nrights reserved.", "i"),
    (8, f"{invented(40, 15)} {ITEM}", "j"), (8, invented(40, 16), "k"), (None, f"{invented(40, 17)} {ITEM}", "l"), (None, invented(40, 18), "m"),
    (None, invented(50, 19), "n"), (None, invented(50, 19), "o"),
    (9, "", "p"), (9, None, "q"), (None, " \n ", "r"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The rows, some toxic ones of sf0.1 under ids that clean rows have too, and labels to learn from."""
    path = str(tmp_path_factory.mktemp("pipeline"))
    full, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet") for name in ("documents", "labels"))
    own = spark.createDataFrame([(*row, None if row[1] is None else len(row[1])) for row in DOCS], "doc_id bigint, text string, source string, n_chars bigint")
    known = full.join(labels, "doc_id").filter("doc_id < 1500").select((F.col("doc_id") + 10_000).alias("doc_id"), "text", F.lit("known").alias("source"), "n_chars")
    bad = full.join(labels.filter("toxic = 1"), "doc_id").orderBy("doc_id").limit(4).select(F.when(F.col("doc_id") % 2 == 0, 8).cast("bigint").alias("doc_id"), "text", F.lit("bad").alias("source"), "n_chars")
    own.unionByName(known).unionByName(bad).repartition(4).write.parquet(f"{path}/documents.parquet")
    labels.withColumn("doc_id", F.col("doc_id") + 10_000).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows_of(docs):
    return [tuple(row) for row in docs.collect()]


def same(got, want):
    assert Counter(map(str, got)) == Counter(map(str, want))


def without_source(rows):
    """Rows of one id and text may change places."""
    return [(row[0], row[1], row[3]) for row in rows]


def digest(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def lines_brute(rows):
    order = sorted(rows, key=lambda row: (row[0] is not None, row[0] or 0, digest(row[1])))
    lines = [[shingles(line) for line in (row[1] or "").split("\n")] for row in order]
    seen, out = [], []
    for row, own in zip(order, lines, strict=True):
        kept = []
        for line, tokens in zip((row[1] or "").split("\n"), own, strict=True):
            if not any(linked(tokens, other) for other in seen):
                kept.append(line)
            seen.append(tokens)
        text = "\n".join(kept)
        out.append((row[0], text, row[2], row[3] if len(kept) == len(own) else len(text)))
    return out


def copies_brute(rows):
    sets = [shingles(row[1] or "") for row in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and linked(sets[i], sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    out = []
    for one in set(label):
        group = [rows[i] for i in range(len(rows)) if label[i] == one]
        least = min((row[0] is None, row[0] or 0, digest(row[1])) for row in group)
        out.append((len(group), least))
    return Counter(out)


def test_toxic_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rated = toxicity.score(docs, spark.read.parquet(f"{folder}/labels.parquet"), "toxic", share_of("doc_id", 3, 1), passed=docs.columns).collect()
    got = rows_of(corpus_pipeline.drop_toxic(spark, docs, folder))
    same(got, [tuple(row.passed) for row in rated if row.predicted != 1])
    assert len(rated) == docs.count() and not [row for row in got if row[2] == "bad"]
    gone = {row.doc_id for row in rated if row.predicted == 1}
    assert {row[0] for row in got} & gone >= {8}  # of a repeated id only the toxic row goes


def test_lines_of_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("source not in ('known', 'bad')")
    got = rows_of(corpus_pipeline.drop_lines(spark, docs, folder))
    same(without_source(got), without_source(lines_brute(rows_of(docs))))


def stays(got, rows):
    """One row of each group, the least one."""
    groups = copies_brute(rows)
    with_words = [row for row in got if (row[1] or "").split()]
    want = Counter(least for (_, least), n in groups.items() for _ in range(n))
    assert Counter((row[0] is None, row[0] or 0, digest(row[1])) for row in got) == want
    assert set(got) <= set(rows) and len(with_words) < len(rows)


def test_one_row_of_near_copies(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("source not in ('known', 'bad')")
    stays(rows_of(corpus_pipeline.keep_one_of_near_copies(spark, docs, folder)), rows_of(docs))


def leaks_brute(rows):
    item = word_hashes([ITEM.encode()])[0]
    return [row for row in rows if align(item, word_hashes([(row[1] or "").encode()])[0])[0] < 0.5 * len(item)]


def test_leaking_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = rows_of(corpus_pipeline.drop_leaks(spark, docs, folder))
    same(got, leaks_brute(rows_of(docs)))
    assert {row[2] for row in got} >= {"k", "m"} and not {row[2] for row in got} & {"j", "l"}


def test_whole(spark, folder, monkeypatch):
    """Stage by stage, each on what brute force left; the packing stage keeps every row."""
    seen = []
    stages = [(name, lambda spark, docs, at, stage=stage: seen.append(rows_of(docs)) or stage(spark, docs, at)) for name, stage in corpus_pipeline.STAGES]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    packed = corpus_pipeline.run(spark, folder)
    _, clean, lined, single, whole = seen
    same(without_source(lined), without_source(lines_brute(clean)))
    stays(single, lined)
    same(whole, leaks_brute(single))
    same([row.doc_id for row in packed.filter("piece = 0").collect()], [row[0] for row in whole])
