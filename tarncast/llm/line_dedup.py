"""Near-duplicate lines over all documents by an exact set-similarity join; later matches are removed.

A line's tokens are its distinct shingles of ``words`` words, ordered by rarity. Lines of equal
sets form a class, which stands where its first line stands (doc_id, line number). Prefix, length and
positional filters give pairs of classes, verified by Jaccard similarity on the full sets.

Only whether a class has a similar one before it matters. A list is tested as a star around its
earliest class, which settles most; the classes still open are tested, block against block, with all
classes before them that share a list.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarncast.llm.setjoin import NULL_ID, Similarity, fetch, likely, post, rarity, release, settle, verify_pairs
from tarncast.llm.words import shingles, text_batches
from tarncast.session import durable, work_path

CLEANED = "doc_id bigint, n_lines bigint, n_removed bigint, kept_sha256 string, kept string"


def line_items(words: int, short: bool = False):
    """Items of documents: the lines of ``words`` words or more, with ``short`` of any word, by their place."""

    def items(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        lines = [text.split(b"\n") for text in texts]
        counts = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
        parts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return *shingles(list(itertools.chain.from_iterable(lines)), words, short=short), np.repeat(np.arange(len(texts)), counts), parts

    return items


def still_open(notes: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Pairs whose later class is not yet removed; a note is (doc_id, line, removed)."""
    ids, parts, gone = (np.array([note[name] for note in notes]) for name in ("id", "part", "gone"))
    place = np.empty(len(notes), np.int64)
    place[np.lexsort((parts, ids))] = np.arange(len(notes))
    return lambda own: np.where(place > place[own, None], ~gone, ~gone[own, None])


def removing(notes: np.ndarray) -> Callable[[int, int], bool]:
    """Links that remove a class: one for each later class."""
    gone = set()

    def told(at: int, other: int) -> bool:
        later = max(at, other, key=lambda place: (notes[place]["id"], notes[place]["part"]))
        fresh = later not in gone
        gone.add(later)
        return fresh

    return told


def removed_lines(docs: DataFrame, words: int = 5, like: Similarity | None = None, short: bool = False) -> DataFrame:
    """The lines to remove: id, part (line number from 0), with null ids as the smallest id."""
    like = like or Similarity()
    items = line_items(words, short)
    lists, found = post(docs, items, rarity(docs, items), like, grouped=False)
    classes = durable(found.groupBy("sid").agg(F.min(F.struct("id", "part")).alias("first"), F.first("n").alias("n"), F.first("g").alias("g"), F.first("bits").alias("bits"), F.count("*").alias("lines")))
    placed = durable(lists.join(classes.select("g", "sid", "first", "bits"), "g"))  # few classes have lists, and only those are looked at from here on

    centre = placed.groupBy("tok").agg(F.min(F.struct("first", "sid", "n", "rem", "bits")).alias("c"))
    star = placed.join(centre, "tok").filter(F.col("sid") != F.col("c.sid")).filter(like.pair(F.col("n"), F.col("rem"), F.col("c.n"), F.col("c.rem")))
    ends = [F.col(f"{side}{name}").alias(f"{to}{end}") for side, end in (("c.", "a"), ("", "b")) for name, to in (("sid", ""), ("n", "n_"), ("first", "first_"), ("bits", "bits_"))]
    star = durable(likely(star.select(*ends).distinct(), like))

    def fetched(wanted: DataFrame) -> DataFrame:
        return fetch(docs, items, wanted.select("sid", F.col("note.id").alias("id")))

    members = star.select(F.explode(F.array(*[F.struct(F.col(end).alias("sid"), F.col(f"first_{end}").alias("note")) for end in "ab"])).alias("x"))
    later = verify_pairs(star, fetched(members.select("x.*").distinct()), like).select("b").distinct()  # b is always the later one
    gone = durable(later.join(star.select("b", "first_b").distinct(), "b").toDF("sid", "first"))
    release(docs.sparkSession)

    # Lists that hold an open class behind the first: those classes and all before them.
    marked = placed.join(gone.select("sid", F.lit(True).alias("gone")), "sid", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    open_lists = marked.groupBy("tok").agg(
        F.min(F.struct("first", "sid")).alias("c"), F.max(F.when(~F.col("gone"), F.struct("first", "sid"))).alias("open"), F.count("*").alias("size")
    )
    open_lists = open_lists.filter((F.col("size") > 2) & F.col("open").isNotNull() & (F.col("open.sid") != F.col("c.sid")))
    note = F.struct(F.col("first.id").alias("id"), F.col("first.part").alias("part"), "gone")
    rest = marked.join(open_lists.select("tok", F.col("open.first").alias("until")), "tok").filter(F.col("first") <= F.col("until"))
    rest = durable(rest.select("tok", "sid", "n", "rem", note.alias("note"), "first", "bits"))
    more = settle(rest.drop("first", "bits"), rest.select("sid", "bits").distinct(), fetched, like, still_open, removing)
    order = rest.select("sid", "first").distinct()
    later = (
        more.join(order.select(F.col("sid").alias("a"), F.col("first").alias("first_a")), "a")
        .join(order.select(F.col("sid").alias("b"), F.col("first").alias("first_b")), "b")
        .select(F.greatest("first_a", "first_b").alias("first"))
    )
    gone = gone.select("first").unionByName(later).distinct().select("first.*")

    # Of a class all lines but the first repeat it.
    repeats = found.select("id", "part", "sid").join(classes.filter("lines > 1").select("sid", "first"), "sid")
    return gone.unionByName(repeats.filter((F.col("id") != F.col("first.id")) | (F.col("part") != F.col("first.part"))).select("id", "part"))


def clean_lines(docs: DataFrame, words: int = 5, like: Similarity | None = None, passed: list[str] | None = None, short: bool = False) -> DataFrame:
    """One row for each row of ``docs`` (``doc_id``, ``text``): doc_id, n_lines, n_removed, kept_sha256, kept.

    With ``passed``, those columns of the row follow as a struct ``passed``.

    A line (between line feeds) is removed when an earlier line, by doc_id and line number, has a Jaccard similarity of 0.75 or more
    to it; similarity is judged on the input, so a removed line still removes later ones. Lines of fewer
    than ``words`` words are never removed, or, with ``short``, where an earlier line has the same words (a line without
    words always stays). ``kept`` is the text without those lines. A null text is empty (one
    empty line), a null doc_id counts as the smallest; rows that repeat a doc_id go by the hash of their text, equal ones in any order, and
    each loses its own lines; other columns are ignored; an empty table gives no rows.
    """
    beside = [F.struct(*[F.col(f"`{name}`") for name in passed]).alias("passed")] if passed else []
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *beside)
    repeated = not keyed.groupBy("doc_id").count().filter("count > 1").isEmpty()
    if repeated:  # then a row goes by its number in that order
        path = work_path(docs.sparkSession, "numbered")
        order = [F.col("doc_id").asc_nulls_first(), F.sha2(F.coalesce("text", F.lit("")), 256), F.monotonically_increasing_id()]
        keyed.sort(*order).withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
        keyed = docs.sparkSession.read.parquet(path)
    key = "row" if repeated else "doc_id"
    lines = removed_lines(keyed.select(F.col(key).alias("doc_id"), "text"), words, like, short)
    lost = durable(lines.groupBy("id").agg(F.collect_set("part").alias("lost")))  # at most the lines of a document
    del lines
    release(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            out = []
            for text, gone in zip(texts, batch.column(batch.schema.get_field_index("lost")).to_pylist(), strict=True):
                own = text.split(b"\n")
                left = [line for number, line in enumerate(own) if number not in gone] if (gone := set(gone or ())) else own
                kept = b"\n".join(left)
                out.append((len(own), len(own) - len(left), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array(v, kind) for v, kind in zip(zip(*out, strict=True), kinds, strict=True)]
            beside = [batch.column(3)] if passed else []
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *beside], names=[*(part.split()[0] for part in CLEANED.split(", ")), *["passed"] * len(beside)])

    joined = keyed.join(lost, F.coalesce(key, F.lit(NULL_ID)) == F.col("id"), "left")
    schema = CLEANED + (f", passed {keyed.schema['passed'].dataType.simpleString()}" if passed else "")
    return joined.select("doc_id", "text", "lost", *["passed"] * len(beside)).mapInArrow(run, schema)
