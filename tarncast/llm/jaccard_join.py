"""Grouped prefix join: near-duplicate documents by the Jaccard similarity of word shingles, exactly.

Documents of one size and one prefix form a group and post their prefix once. Token lists give pairs
of groups, which the length and positional filters thin out; those left are expanded to their
members and verified on the full sets.

Only connectivity is asked for, so a list is first tested as a star around its smallest group; lists whose
members are then in one component are done. What still spans components is tested block against
block, so that a group of near copies of any size is never written out as pairs. Before tokens are
fetched, a pair must pass a bound from the parities that every set carries.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarncast.llm.components import components
from tarncast.llm.setjoin import NULL_ID, Similarity, Trees, fetch, likely, post, rarity, release, settle, verify_pairs
from tarncast.llm.words import shingles
from tarncast.session import durable


def document_items(words: int):
    def items(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        rows = np.arange(len(texts))
        return *shingles(texts, words, short=True), rows, np.zeros_like(rows)

    return items


def differing(notes: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    labels = np.unique(notes, return_inverse=True)[1]
    return lambda own: labels != labels[own, None]


def joining(notes: np.ndarray) -> Callable[[int, int], bool]:
    """Links that join components: of those between the same two, or around a circle of them, the first ones."""
    first: dict[bytes, int] = {}
    return Trees([first.setdefault(note, at) for at, note in enumerate(notes)]).join


def near_duplicates(docs: DataFrame, words: int = 5, like: Similarity | None = None) -> DataFrame:
    """One row for each row of ``docs`` (``doc_id``, ``text``): doc_id, n_shingles, component_id.

    Words are runs of bytes outside ASCII white space, A-Z lower-cased; a document's set is its distinct
    shingles of ``words`` words, or its whole sequence if it has fewer. Two documents are linked when
    their similarity is 0.75 or more; component_id is the smallest doc_id reachable. A document without
    words has 0 shingles and its own doc_id. A null text is empty, a null doc_id counts as the
    smallest id and comes back null; a repeated doc_id is a document for each of its rows. Other columns
    are ignored; an empty table gives no rows.
    """
    like = like or Similarity()
    items = document_items(words)
    lists, found = post(docs, items, rarity(docs, items), like, grouped=True)
    sets = durable(found.groupBy("sid").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("g").alias("g"), F.first("bits").alias("bits")))

    # Pairs of groups: every member of a list beside the list's smallest group.
    centre = lists.groupBy("tok").agg(F.min(F.struct("g", "n", "rem")).alias("c"))
    pairs = (
        lists.join(centre, "tok")
        .filter(F.col("g") != F.col("c.g"))
        .filter(like.pair(F.col("n"), F.col("rem"), F.col("c.n"), F.col("c.rem")))
        .select(F.col("c.g").alias("g_a"), F.col("g").alias("g_b"))
        .distinct()
    )
    a = sets.select(F.col("g").alias("g_a"), F.col("sid").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    b = sets.select(F.col("g").alias("g_b"), F.col("sid").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    crowd = sets.groupBy("g").agg(F.min(F.struct("sid", "n", "bits")).alias("c"), F.count("*").alias("size")).filter("size > 1")
    inside = sets.join(crowd, "g").filter(F.col("sid") != F.col("c.sid"))
    inside = inside.select(F.col("c.sid").alias("a"), F.col("c.n").alias("n_a"), F.col("sid").alias("b"), F.col("n").alias("n_b"), F.col("c.bits").alias("bits_a"), F.col("bits").alias("bits_b"))
    star = durable(likely(pairs.join(a, "g_a").join(b, "g_b").select("a", "n_a", "b", "n_b", "bits_a", "bits_b").unionByName(inside), like))

    def fetched(wanted):
        return fetch(docs, items, sets.join(wanted, "sid").select("id", "sid"))

    links = durable(verify_pairs(star, fetched(star.select(F.explode(F.array("a", "b")).alias("sid")).distinct()), like))
    release(docs.sparkSession)
    labels = components(links)

    # Every set of a list, or of a group of several sets, may be linked with any other of it.
    spread = (
        lists.select("tok", "g", "rem")
        .unionByName(crowd.select((-F.abs(F.xxhash64("g"))).alias("tok"), "g", F.lit(None).cast("int").alias("rem")))
        .join(sets, "g")
        .select("tok", "sid", "n", F.coalesce("rem", "n").alias("rem"))
    )

    # What still spans components.
    placed = spread.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    open_lists = placed.groupBy("tok").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    rest = placed.join(open_lists.select("tok"), "tok").select("tok", "sid", "n", "rem", F.col("label").alias("note"))
    more = durable(settle(rest, sets.select("sid", "bits"), fetched, like, differing, joining))
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    named = sets.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    lowest = named.groupBy("label").agg(F.min("id").alias("component_id"))
    answer = named.select("sid", "label").join(lowest, "label").select("sid", "component_id")
    with_words = found.join(answer, "sid").select(F.col("id").alias("doc_id"), F.col("n").cast("bigint").alias("n_shingles"), "component_id")
    blank = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).filter(~F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    blank = blank.select("doc_id", F.lit(0).cast("bigint").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    null = lambda name: F.when(F.col(name) != NULL_ID, F.col(name)).alias(name)
    return with_words.select(null("doc_id"), "n_shingles", null("component_id")).unionByName(blank)
