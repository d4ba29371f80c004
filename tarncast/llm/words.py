"""Words of many texts and 64-bit hashes of words and word n-grams, as numpy arrays.

A word is a run of bytes outside space and 0x09-0x0D of the UTF-8 text, with A-Z lower-cased: what
``bytes.lower().split()`` gives. Hashes are polynomials over fixed random byte values, so a whole
buffer is hashed with one running sum instead of a call for each word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RANDOM = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACES = _RANDOM.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(PLACES[15])
BASE_INVERSE = pow(BASE, -1, 1 << 64)
MIX = np.uint64(0xBF58476D1CE4E5B9)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SEGMENT = 1 << 21
#: Bytes that are hashed at once: their sums fit a processor's cache. Hashes do not depend on it.
HASHED = 1 << 17
LOWERED_VALUES = BYTE_VALUES[LOWER]


def mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * MIX
    return values ^ (values >> np.uint64(29))


def powers(base: int, count: int) -> np.ndarray:
    steps = np.full(count, base, dtype=np.uint64)
    if count:
        steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


class Powers(dict):
    """Tables of powers by base, of this process only: a copy that travels with a function is empty."""

    def __reduce__(self):
        return Powers, ()


_POWERS = Powers()


def power_table(base: int, count: int) -> np.ndarray:
    """Powers 0 .. count - 1 of ``base`` modulo 2**64, kept for the next call unless very long."""
    table = _POWERS.get(base)
    if table is None or len(table) < count:
        table = powers(base, max(count, min(2 * count, SEGMENT + 1)))
        if len(table) <= 4 * SEGMENT:
            _POWERS[base] = table
    return table[:count]


def _hash_segment(segment: np.ndarray, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Starts and hashes of the words of one segment that ends with a space, and hashes of their first bytes."""
    blank = SPACE[segment]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    sums = np.zeros(len(segment) + 1, dtype=np.uint64)
    np.cumsum(LOWERED_VALUES[segment] * power_table(BASE, len(segment)), out=sums[1:])
    back = power_table(BASE_INVERSE, len(segment))[starts]
    hashes = [mix((sums[last] - sums[starts]) * back + (last - starts).astype(np.uint64) * PLACES[14]) for last in (ends, *(np.minimum(ends, starts + stem) for stem in stems))]
    return starts, hashes[0], hashes[1:]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin and end (len(texts) + 1 bounds)."""
    hashes, _, bounds = word_features(texts)
    return hashes, bounds


def word_features(texts: list[bytes], stems: tuple[int, ...] = ()) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Hashes of all words in order, for each length in ``stems`` of their first bytes, and the texts' bounds."""
    buffer = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    starts, hashes, firsts, at = [], [], [[] for _ in stems], 0
    while at < len(buffer):
        end = min(at + HASHED, len(buffer))
        cut = end
        if end < len(buffer):
            blanks = np.flatnonzero(SPACE[buffer[at:end]])
            while not len(blanks) and end < len(buffer):  # one very long word: widen until it ends
                end = min(2 * end - at, len(buffer))
                blanks = np.flatnonzero(SPACE[buffer[at:end]])
            cut = at + int(blanks[-1]) + 1
        first, found, parts = _hash_segment(buffer[at:cut], stems)
        starts.append(first + at)
        hashes.append(found)
        for own, part in zip(firsts, parts, strict=True):
            own.append(part)
        at = cut
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    text_ends = np.cumsum(lengths + 1)
    bounds = np.concatenate([[0], np.searchsorted(np.concatenate(starts), text_ends, "left")])
    return np.concatenate(hashes), [np.concatenate(own) for own in firsts], bounds


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` word hashes; with fewer words, of the whole sequence as one; empty without words."""
    if len(hashes) == 0:
        return hashes
    n = min(n, len(hashes))
    count = len(hashes) - n + 1
    total = np.full(count, n, dtype=np.uint64)
    for place in range(n):  # word hashes are mixed already
        total += hashes[place : place + count] * PLACES[place + 7]
    return mix(total)


def shingles(texts: list[bytes], n: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of all texts, and the text that each belongs to, in order.

    A text of fewer words has its whole sequence as one if ``short``, else none.
    """
    hashes, bounds = word_hashes(texts)
    counts = np.diff(bounds)
    owner = np.repeat(np.arange(len(texts)), counts)
    grams = np.zeros(len(hashes), np.uint64)
    if len(hashes) >= n:
        grams[: len(hashes) - n + 1] = ngrams(hashes, n)
    whole = np.arange(len(hashes)) + n <= np.repeat(bounds[1:], counts)
    if short:
        for text in np.flatnonzero((counts > 0) & (counts < n)):
            first, last = bounds[text], bounds[text + 1]
            grams[first] = ngrams(hashes[first:last], n)[0]
            whole[first] = True
    return grams[whole], owner[whole]


def text_batches(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SEGMENT) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut Arrow batches into slices of about ``limit`` bytes of text; a null text is empty. Only one slice's texts are Python objects at a time."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
        first, size = 0, 0
        for at, own in enumerate(pc.binary_length(column).fill_null(0).to_pylist()):
            if at > first and size + own > limit:
                yield batch.slice(first, at - first), plain_bytes(column.slice(first, at - first))
                first, size = at, 0
            size += own
        if first < len(batch):
            yield batch.slice(first), plain_bytes(column.slice(first))


def plain_bytes(column: pa.Array) -> list[bytes]:
    return [value or b"" for value in column.to_pylist()]


def give_back() -> None:
    """Hand freed memory back to the system: Python workers stay between tasks and would keep it beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)
