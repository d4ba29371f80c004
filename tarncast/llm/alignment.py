"""Alignment of two tokenizers over the same texts, and how steadily their tokens go together.

Interval coalescing: the tokens of both sides, as byte ranges, are sorted by start; a running maximum of
their ends is kept, and a group breaks where a start reaches it. Those are the offsets where tokens of
both sides end. Inside a group every token of one side is linked with every token of the other.

Documents are aligned in slices of a few MB. A slice keeps its distinct id pairs once; only those are
counted over the corpus and sent back to the slice, so what is shuffled is far less than the links.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarncast.llm.tokens import byte_letters
from tarncast.llm.words import text_batches
from tarncast.session import work_path

SLICE_BYTES = 2 << 20
#: Parts of texts that are remembered, and the characters from which one is not.
CACHE_PARTS = 400_000
LONG_PART = 100
#: The pre-tokenizer of byte-level files whose pattern begins every piece at such a space.
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
CUT = re.compile(r"(?<=\S) (?=\S)")
BESIDE_SPACE = re.compile(r"^\s|\s | \s|\s\Z")
#: A group of more links than this is linked by distinct ids with their numbers, so that one long group stays small.
WIDE_LINKS = 1 << 12
#: Ids of both sides are packed into 32 bits.
MOST_IDS = 1 << 16

FIGURES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs")
SLICE = (
    "slice bigint, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>,"
    " groups_sha256 array<string>, n_pairs array<bigint>, at binary, times binary, pairs array<int>, holders array<int>"
)
ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


class Sides:
    """Both tokenizers, the bytes that each of their ids stands for, and the ids of parts of texts, remembered.

    A text is cut at every space between two characters that are not white space. Neither side has a token across
    such a place, so the ids of a text are those of its parts in order; where a file gives no such promise, a
    text is one part. Every part goes through the libraries' own encoders, once while it is remembered.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = {letter: byte for byte, letter in enumerate(byte_letters())}
        added = self.a.get_added_tokens_decoder().values()
        names = {token.content for token in added}
        entries = self.a.get_vocab()
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, at in entries.items():
            self.a_bytes[at] = entry.encode() if entry in names else bytes(letters[letter] for letter in entry)
        pieces = [self.b.id_to_piece(at) for at in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(piece[3:5], 16)]) if self.b.is_byte(at) else piece.replace("▁", " ").encode() for at, piece in enumerate(pieces)]
        if max(len(self.a_bytes), len(self.b_bytes)) > MOST_IDS:
            raise ValueError(f"a vocabulary of more than {MOST_IDS} ids")
        self.a_size = np.array([len(own) for own in self.a_bytes], dtype=np.int64)
        self.b_size = np.array([len(own) for own in self.b_bytes], dtype=np.int64)
        #: Every id as text with the sign that may follow it: in a group, before the other side, and at the end of a group.
        self.shown = [str(at).encode() + sign for sign in (b",", b"|", b";") for at in range(MOST_IDS)]
        stated = json.loads(self.a.to_str())
        plain = stated["normalizer"] is None and stated["pre_tokenizer"] == PRE_TOKENIZER and all(token.special for token in added)
        same = "".join(self.b.encode("a  ﬁ b ", out_type=str)) == "▁a▁▁ﬁ▁b▁"  # no normalising, no white space dropped
        self.cuts = plain and same and not any(re.search("[^▁]▁", piece) for piece in pieces)
        self.a_known: dict[str, bytes] = {}
        self.b_known: dict[str, bytes] = {}
        self.inexact: set[str] = set()

    def parts(self, text: str) -> list[str]:
        """The parts of a text, each without the space before it."""
        if not text or not self.cuts:
            return [text] if text else []
        if BESIDE_SPACE.search(text) is None:
            return text.split(" ")
        first, *rest = CUT.split(" " + text)
        return [first[1:], *rest]

    def learn(self, parts: list[str]) -> None:
        """Encode parts and remember their ids, packed, and which parts a side does not give back byte for byte."""
        whole = [f" {part}".encode() for part in parts]
        size = np.fromiter(map(len, whole), np.int64, len(whole))
        found = [[own.ids for own in self.a.encode_batch_fast([" " + part for part in parts], add_special_tokens=False)], self.b.encode(parts, num_threads=1)]
        for ids, known, tokens, sizes in zip(found, (self.a_known, self.b_known), (self.a_bytes, self.b_bytes), (self.a_size, self.b_size), strict=True):
            ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat = np.fromiter(itertools.chain.from_iterable(ids), np.int64)
            at = np.concatenate([[0], np.cumsum(sizes[flat])])
            spelled = b"".join(map(tokens.__getitem__, flat.tolist()))
            if spelled != b"".join(whole) or (np.diff(at[ends], prepend=0) != size).any():
                cuts = [0, *at[ends].tolist()]
                self.inexact.update(part for part, own, first, last in zip(parts, whole, cuts, cuts[1:], strict=False) if spelled[first:last] != own)
            packed, cuts = flat.astype("<u2").tobytes(), [0, *(2 * ends).tolist()]
            known.update(zip(parts, [packed[first:last] for first, last in itertools.pairwise(cuts)], strict=True))

    def forget(self, slice_parts: set[str]) -> None:
        """Long parts are not remembered; the memory is emptied when full."""
        if len(self.a_known) > CACHE_PARTS:
            slice_parts = set(self.a_known)
        for part in [part for part in slice_parts if len(part) > LONG_PART or len(self.a_known) > CACHE_PARTS]:
            del self.a_known[part], self.b_known[part]
            self.inexact.discard(part)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids of A and how many each text has, the same of B; a text has none where a side's bytes are not those of a space and the text."""
        parts = [self.parts(text.decode("utf-8", "replace")) for text in texts]
        needed = set(itertools.chain.from_iterable(parts))
        self.learn([part for part in needed if part not in self.a_known])
        a = [b"".join(map(self.a_known.__getitem__, own)) for own in parts]
        b = [b"".join(map(self.b_known.__getitem__, own)) for own in parts]
        if self.inexact & needed:
            for at, text in enumerate(texts):
                if not self.inexact.isdisjoint(parts[at]):
                    for ids, tokens in ((a[at], self.a_bytes), (b[at], self.b_bytes)):
                        if b"".join([tokens[token] for token in np.frombuffer(ids, "<u2").tolist()]) != b" " + text:
                            a[at] = b[at] = b""
        self.forget(needed)
        ids = [np.frombuffer(b"".join(side), "<u2").astype(np.int64) for side in (a, b)]
        counts = [np.fromiter(map(len, side), np.int64, len(texts)) // 2 for side in (a, b)]
        return ids[0], counts[0], ids[1], counts[1]


@dataclass
class Groups:
    """All tokens by group, side (A first) and place, and what is counted for each document."""

    ids: np.ndarray
    side: np.ndarray
    group: np.ndarray
    owner: np.ndarray  # the document of each group


def coalesce(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of all tokens (A's, then B's) by start, and the group of each in that order. Both sides cover the same bytes without gaps."""
    starts = np.concatenate([np.concatenate([[0], a_ends[:-1]]), np.concatenate([[0], b_ends[:-1]])]) if len(a_ends) else np.zeros(0, np.int64)
    ends = np.concatenate([a_ends, b_ends])
    side = np.repeat(np.array([0, 1], np.int8), [len(a_ends), len(b_ends)])
    order = np.lexsort((side, starts))
    reach = np.maximum.accumulate(ends[order])
    breaks = np.zeros(len(order), np.int64)
    breaks[1:] = starts[order][1:] >= reach[:-1]
    return order, np.cumsum(breaks)


def group_tokens(a_ids: np.ndarray, n_a: np.ndarray, b_ids: np.ndarray, sides: Sides) -> Groups:
    a_owner = np.repeat(np.arange(len(n_a)), n_a)
    order, group = coalesce(np.cumsum(sides.a_size[a_ids]), np.cumsum(sides.b_size[b_ids]))
    side = (order >= len(a_ids)).astype(np.int8)
    by = np.argsort(2 * group + side, kind="stable")
    order, group, side = order[by], group[by], side[by]
    firsts = np.flatnonzero(np.diff(group, prepend=-1))
    return Groups(np.concatenate([a_ids, b_ids])[order], side, group, a_owner[order[firsts]])  # a group begins with a token of A


def group_texts(groups: Groups, sides: Sides, counts: np.ndarray) -> list[str]:
    """The hex digest of each document's groups as ``a1,a2|b1;a3|b2``; empty without tokens. ``counts``: tokens of both sides."""
    last_of_side = np.ones(len(groups.ids), dtype=np.int64)
    last_of_side[:-1] = (groups.side[1:] != groups.side[:-1]) | (groups.group[1:] != groups.group[:-1])
    shown = list(map(sides.shown.__getitem__, (groups.ids + MOST_IDS * last_of_side * (1 + groups.side)).tolist()))
    ends = np.cumsum(counts)
    return [hashlib.sha256(b"".join(shown[end - count : end])[:-1]).hexdigest() if count else "" for end, count in zip(ends.tolist(), counts.tolist(), strict=True)]


def distinct(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of ``times`` of each."""
    if not len(keys):
        return keys, times
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    firsts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[firsts], np.add.reduceat(times[by], firsts)


def outer(group: np.ndarray, ids: np.ndarray, times: np.ndarray, other_group: np.ndarray, other_ids: np.ndarray, other_times: np.ndarray):
    """Every pair of two entries of one group (ids in order of their groups): group, both ids, the product of their numbers."""
    first = np.searchsorted(other_group, group, "left")
    reps = np.searchsorted(other_group, group, "right") - first
    at = np.repeat(first - np.cumsum(reps) + reps, reps) + np.arange(reps.sum())
    return np.repeat(group, reps), np.repeat(ids, reps), other_ids[at], np.repeat(times, reps) * other_times[at]


def linked_pairs(groups: Groups) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each document and id pair linked in it: document, pair (A's id times 65,536 and B's), number of links; and the links of each group."""
    in_a = groups.side == 0
    links = np.bincount(groups.group[in_a], minlength=len(groups.owner)) * np.bincount(groups.group[~in_a], minlength=len(groups.owner))
    wide = (links > WIDE_LINKS)[groups.group]
    found = []
    for chosen, fold in ((~wide, False), (wide, True)):
        entries = []
        for own in (in_a & chosen, ~in_a & chosen):
            group, ids, times = groups.group[own], groups.ids[own], np.ones(int(own.sum()), np.int64)
            if fold:
                keys, times = distinct(group * MOST_IDS + ids, times)
                group, ids = keys // MOST_IDS, keys % MOST_IDS
            entries += [group, ids, times]
        group, a, b, times = outer(*entries)
        found.append(distinct((groups.owner[group] << 32) | (a << 16) | b, times))
    keys, times = distinct(*(np.concatenate(part) for part in zip(*found, strict=True)))
    return keys >> 32, keys & 0xFFFFFFFF, times, links


def align_slice(texts: list[bytes], sides: Sides) -> dict[str, np.ndarray | list]:
    """What a slice keeps: figures of each document, its links as places among the slice's distinct pairs, and how many documents hold each pair."""
    a_ids, n_a, b_ids, n_b = sides.encode(texts)
    groups = group_tokens(a_ids, n_a, b_ids, sides)
    doc, pair, times, links = linked_pairs(groups)
    pairs, at = np.unique(pair, return_inverse=True)
    n_links = np.zeros(len(texts), np.int64)
    np.add.at(n_links, groups.owner, links)
    return {
        "n_a": n_a,
        "n_b": n_b,
        "n_groups": np.bincount(groups.owner, minlength=len(texts)),
        "n_links": n_links,
        "groups_sha256": group_texts(groups, sides, n_a + n_b),
        "n_pairs": np.bincount(doc, minlength=len(texts)),
        "at": at.astype("<u4").tobytes(),
        "times": times.astype("<u4").tobytes(),
        "pairs": pairs.astype(np.uint32).view(np.int32),
        "holders": np.bincount(at, minlength=len(pairs)).astype(np.int32),
    }


def align_slices(docs: DataFrame, a_path: str, b_path: str) -> str:
    """Where the aligned slices are stored; a row is bounded by ``SLICE_BYTES`` of text or one document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, number = Sides(a_path, b_path), TaskContext.get().partitionId() << 32
        for batch, texts in text_batches(batches, limit=SLICE_BYTES):
            own = {"slice": number, "doc_id": batch.column(0)} | align_slice(texts, sides)
            number += 1
            arrays = []
            for name, kind in zip(schema.names, schema.types, strict=True):
                value = own[name]
                arrays.append(pa.ListArray.from_arrays(pa.array([0, len(value)], pa.int32()), pa.array(value, kind.value_type)) if pa.types.is_list(kind) else pa.array([value], kind))
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    lists = {"array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "binary": pa.binary(), "bigint": pa.int64()}
    schema = pa.schema([(name, lists[kind]) for name, kind in (column.split() for column in SLICE.split(","))])
    path = work_path(docs.sparkSession, "aligned")
    docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SLICE).write.parquet(path)
    return path


def pair_counts(slices: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked), best (whether n is the highest of its A id, ties included)."""
    each = slices.select(F.explode(F.arrays_zip("pairs", "holders")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.holders").alias("n"))
    counted = each.withColumn("a", F.shiftrightunsigned("pair", 16))
    most = counted.groupBy("a").agg(F.max("n").alias("most"))  # at most MOST_IDS rows
    return counted.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row for each row of ``docs`` (``doc_id``, ``text``): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is a byte-level file of the tokenizers library and reads a space and the text; B is a sentencepiece model, which adds that
    space itself. No special tokens are set; their strings in a text are plain text. The offsets where tokens of both end cut
    the tokens into groups; links are all pairs of an A and a B token of a group. A pair's count is the number of rows that
    hold it linked; ``n_best`` counts links of the highest count of their A id, ties included, ``count_sum`` adds the
    counts over all links. A text that is null, empty, or that a side does not give back byte for byte has no tokens: zeros and an
    empty digest. Texts of any length are read whole; a repeated or null doc_id gives a row each and counts each time; other columns are
    ignored; an empty table gives no rows.

    A group of many tokens (text on which both sides share no boundary) is linked by distinct ids.
    """
    stored = docs.sparkSession.read.schema(SLICE)
    path = align_slices(docs, a_path, b_path)
    slices = stored.parquet(path)
    asked = slices.select("slice", F.posexplode("pairs").alias("place", "pair"))
    answers = asked.join(pair_counts(slices), "pair").select("slice", "place", "n", "best")

    def figures(key: tuple, found: pa.Table, own: pa.Table) -> pa.Table:
        n, best = np.zeros(found.num_rows, np.int64), np.zeros(found.num_rows, np.int64)
        place = found.column("place").to_numpy()
        n[place], best[place] = found.column("n").to_numpy(), found.column("best").to_numpy()
        values = {name: own.column(name).combine_chunks().flatten() for name in FIGURES}
        at, times = (np.frombuffer(own.column(name)[0].as_py(), dtype="<u4").astype(np.int64) for name in ("at", "times"))
        owner = np.repeat(np.arange(len(values["doc_id"])), values["n_pairs"].to_numpy())
        for name, part in (("n_best", best), ("count_sum", n)):
            total = np.zeros(len(values["doc_id"]), np.int64)
            np.add.at(total, owner, times * part[at])
            values[name] = pa.array(total)
        return pa.table([values[column.split()[0]] for column in ALIGNED.split(", ")], names=[column.split()[0] for column in ALIGNED.split(", ")])

    own = stored.parquet(path).select("slice", *FIGURES, "at", "times")
    return answers.groupBy("slice").cogroup(own.groupBy("slice")).applyInArrow(figures, ALIGNED)
