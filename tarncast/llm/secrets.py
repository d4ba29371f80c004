"""Secrets in texts: credential patterns, and random strings found by their token efficiency.

A byte-pair vocabulary spells words of any language it has seen in a few long tokens; a random
string falls into tokens of one or two characters. A run of key characters whose characters per
token stay below a limit is therefore reported, unless it has the form of a known digest or
identifier.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarncast.llm.words import text_batches

KINDS = ("assign", "access", "hex", "random")
SPANS = "doc_id bigint, spans array<struct<kind: string, start: bigint, end: bigint>>"

#: The patterns of credentials, the characters that must be there, and the group that is counted.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
BASE = ((0, ASSIGN, 2, 6), (1, ACCESS, 0, 20), (2, HEX, 0, 24))

#: A run of characters that keys are written in, from its first character on.
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: Lengths in hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_DIGITS = (32, 40, 56, 64, 96, 128)
DIGEST = re.compile(r"[0-9a-fA-F]+")
NAMED_DIGEST = re.compile(r"(md5|sha1|sha224|sha256|sha384|sha512)[-=_]", re.IGNORECASE)
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
NUMBERS = re.compile(r"[0-9+/_=-]+")


def known_form(run: str) -> bool:
    """Whether a run is a digest by its length or name, a UUID, or digits and signs only (dates, numbers, rulers)."""
    if NUMBERS.fullmatch(run) or UUID.fullmatch(run) or NAMED_DIGEST.match(run):
        return True
    return len(run) in DIGEST_DIGITS and DIGEST.fullmatch(run) is not None


class Efficiency:
    """Characters per token of a string under a vocabulary of ranks. A long string is judged in slices of 256 characters, all of them."""

    SLICE = 256

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as source:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, source)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, run: str) -> float:
        tokens = sum(len(self.encoding.encode_ordinary(run[at : at + self.SLICE])) for at in range(0, len(run), self.SLICE))
        return len(run) / max(1, tokens)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the credential patterns: leftmost matches of each kind that do not overlap, short ones dropped."""
    return [(found.start(), kind, found.end()) for kind, pattern, group, least in BASE for found in pattern.finditer(text) if found.end(group) - found.start(group) >= least]


def find_in(text: str, efficiency: Efficiency, limit: float, known: frozenset[str] = frozenset()) -> list[tuple[int, int, int]]:
    """All spans of a text by start, then kind: those of the patterns, and random runs that touch none of them."""
    spans = base_spans(text)
    taken, covered = sorted((start, end) for start, _, end in spans), 0
    for found in RUN.finditer(text):
        start, end = found.span()
        while covered < len(taken) and taken[covered][1] <= start:
            covered += 1
        run = found.group()
        free = covered == len(taken) or taken[covered][0] >= end
        if free and run not in known and not known_form(run) and efficiency(run) < limit:
            spans.append((start, 3, end))
    return sorted(spans)


def find_secrets(docs: DataFrame, vocabulary: str, pattern: str, limit: float = 2.0, known: frozenset[str] = frozenset()) -> DataFrame:
    """One row for each row of ``docs`` (``doc_id``, ``text``): doc_id, spans (kind, start, end in code points, end exclusive).

    Spans are ordered by start, then kind: ``assign``, ``access`` and ``hex`` by their patterns, ``random`` for a run of 20 or more
    key characters of fewer than ``limit`` characters a token that touches no span of a pattern, has no known form and is not in
    ``known`` (strings of the caller's own: published digests, test keys). ``vocabulary`` is a file of ranks, ``pattern`` its pre-token pattern.
    A null or empty text has no spans; a text of any length is read whole; rows are independent, so repeated and null ids
    give a row each; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        efficiency = Efficiency(vocabulary, pattern)
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch, texts in text_batches(batches):
            found = [[{"kind": KINDS[kind], "start": start, "end": end} for start, kind, end in find_in(text.decode("utf-8", "replace"), efficiency, limit, known)] for text in texts]
            yield pa.record_batch({"doc_id": batch.column(0), "spans": pa.array(found, pa.list_(span))})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SPANS)


def joined(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda one: F.concat_ws(":", one["kind"], one["start"].cast("string"), one["end"].cast("string"))), ",")


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda one: one["kind"].isin(*kinds))
