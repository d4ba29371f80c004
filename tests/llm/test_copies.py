"""Exact copies, near copies, repeated lines and repeated passages against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarncast.llm import exact_dedup, jaccard_join, line_dedup, setjoin, suffix_dedup, words
from tarncast.llm.components import components


def pairs_of(docs):
    return [(row["doc_id"], row["text"] or "") for row in docs.select("doc_id", "text").collect()]


def lower(text):
    return text.encode().lower()


def test_words_and_shingles():
    texts = [b"One two  three\tfour five six", b"", b"  ", b"one TWO three four five six ", b"x" * 5_000_000 + b" y"]
    hashes, bounds = words.word_hashes(texts)
    assert np.diff(bounds).tolist() == [len(text.lower().split()) for text in texts]
    assert (hashes[0:6] == hashes[6:12]).all()
    grams, owner = words.shingles(texts, 5, short=True)
    assert owner.tolist() == [0, 0, 3, 3, 4] and (grams[:2] == grams[2:4]).all()
    assert words.shingles(texts, 5, short=False)[1].tolist() == [0, 0, 3, 3]


def equal_brute(docs, keep):
    groups = defaultdict(list)
    for doc_id, text in docs:
        groups[lower(text)].append(doc_id)
    return sorted(
        (str(doc_id), str(keep([m for m in groups[lower(text)] if m is not None], default=None)), len(groups[lower(text)]), hashlib.sha256(lower(text)).hexdigest()) for doc_id, text in docs
    )


@pytest.mark.parametrize("keep", ["max", "min"])
@pytest.mark.parametrize("digest", [exact_dedup.content_hash, lambda text: F.md5(F.substring(text, 1, 1)).cast("binary")])
def test_exact_copies(docs, keep, digest):
    """The second hash makes most different texts collide."""
    got = exact_dedup.equal_groups(docs, keep, digest).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == equal_brute(pairs_of(docs), {"max": max, "min": min}[keep])
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def shingles(text, n=5):
    own = lower(text).split()
    return {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if len(own) >= n else ({tuple(own)} if own else set())


def linked(a, b):
    return 100 * len(a & b) >= 75 * len(a | b) and bool(a)


def near_brute(docs):
    sets = [shingles(text) for _, text in docs]
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if linked(sets[i], sets[j]) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    order = lambda doc_id: -1 if doc_id is None else doc_id
    least = {one: min((docs[i][0] for i in range(len(docs)) if label[i] == one), key=order) for one in set(label)}
    return sorted((str(doc_id), len(sets[i]), str(least[label[i]] if sets[i] else doc_id)) for i, (doc_id, _) in enumerate(docs))


@pytest.mark.parametrize("small", [False, True])
def test_near_copies(docs, monkeypatch, small):
    """With small units and lists the paths for large groups are taken."""
    if small:
        monkeypatch.setattr(setjoin, "UNIT_SETS", 3)
        monkeypatch.setattr(setjoin, "SHIFTS", 2)
        monkeypatch.setattr(setjoin, "UNIT_ROWS", 20)
        monkeypatch.setattr(setjoin, "UNIT_TOKENS", 500)
    got = jaccard_join.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == near_brute(pairs_of(docs))


def lines_brute(docs):
    lines = [(doc_id, number, shingles(line) if len(lower(line).split()) >= 5 else set()) for doc_id, text in docs for number, line in enumerate(text.split("\n"))]
    return {(d, n) for d, n, s in lines if any((e, m) < (d, n) and linked(s, t) for e, m, t in lines)}


@pytest.mark.parametrize("small", [False, True])
def test_lines(docs, monkeypatch, small):
    if small:
        monkeypatch.setattr(setjoin, "UNIT_SETS", 3)
        monkeypatch.setattr(setjoin, "SHIFTS", 2)
        monkeypatch.setattr(setjoin, "UNIT_ROWS", 20)
        monkeypatch.setattr(setjoin, "UNIT_TOKENS", 300)
    texts = sorted(pairs_of(docs), key=lambda row: (row[0] is not None, row[0] or 0, hashlib.sha256(row[1].encode()).hexdigest()))
    gone = lines_brute([(place, text) for place, (_, text) in enumerate(texts)])
    want = []
    for place, (doc_id, text) in enumerate(texts):
        own = text.split("\n")
        kept = "\n".join(line for number, line in enumerate(own) if (place, number) not in gone)
        want.append((str(doc_id), len(own), text, kept))
    got = line_dedup.clean_lines(docs, passed=["text", "lang"]).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.passed.text or "", r.kept) for r in got) == sorted(want)
    assert all(r.kept_sha256 == hashlib.sha256(r.kept.encode()).hexdigest() for r in got) and sum(r.n_removed for r in got) > 5


def test_lines_of_rows_under_one_id(spark):
    """A line that only one of the rows under an id holds stays in it, whatever the others lose."""
    one, two, three = ("alpha beta gamma delta epsilon", "one two three four five six", "red green blue black white grey")
    texts = [(1, one), (2, f"{two}\n{one}"), (2, f"{one}\n{three}"), (2, f"{one}\n{three}"), (None, f"{two}\n{two}"), (None, three), (None, None)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    order = sorted(texts, key=lambda row: (row[0] is not None, row[0] or 0, hashlib.sha256((row[1] or "").encode()).hexdigest()))
    seen, want = set(), []
    for doc_id, text in order:
        kept = []
        for line in (text or "").split("\n"):
            if line not in seen:
                kept.append(line)
            seen |= {line} - {""}
        want.append((str(doc_id), "\n".join(kept)))
    assert sorted((str(row.doc_id), row.kept) for row in line_dedup.clean_lines(docs).collect()) == sorted(want)


def test_parities_never_say_more_than_the_sets():
    random = np.random.Generator(np.random.PCG64(4))
    for _ in range(200):
        shared, one, two = (random.integers(0, 1 << 63, random.integers(0, most), dtype=np.uint64) for most in (300, 40, 400))
        own = [np.unique(np.concatenate([shared, part])) for part in (one, two)]
        if not all(map(len, own)):
            continue
        sets = setjoin.Sets(np.concatenate(own), np.cumsum([0, len(own[0]), len(own[1])]), np.zeros((2, 2), np.uint64), np.arange(2), np.zeros(2))
        bits = sets.parities()
        assert all(len(part) * 8 >= 2 * len(tokens) for part, tokens in zip(bits, own, strict=True))
        least = setjoin.Parities(bits).differ(0, np.array([1]))[0]
        assert least <= len(np.setxor1d(*own)) and setjoin.Parities(bits).differ(1, np.array([0]))[0] == least
        assert setjoin.Parities([bits[0]] * 2).differ(0, np.array([1]))[0] == 0


def passages_brute(docs, length):
    texts = [text.encode() for _, text in docs]
    count = Counter(text[i : i + length] for text in texts for i in range(len(text) - length + 1))
    out = []
    for (doc_id, _), text in zip(docs, texts, strict=True):
        covered = np.zeros(len(text) + 1, dtype=bool)
        for i in range(len(text) - length + 1):
            if count[text[i : i + length]] > 1:
                covered[i : i + length] = True
        kept = bytes(byte for byte, gone in zip(text, covered, strict=False) if not gone)
        out.append((str(doc_id), len(text), int(covered.sum()), int((np.diff(covered.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("length", "bucket", "crowd"), [(400, 400_000, 2_000), (100, 500, 3), (64, 100, 1)])
def test_passages(docs, monkeypatch, length, bucket, crowd):
    """Small buckets cut runs of equal suffixes at boundaries; a small crowd takes the path for many contexts."""
    monkeypatch.setattr(suffix_dedup, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(suffix_dedup, "GROUP_CONTEXTS", crowd)
    got = suffix_dedup.repeated_passages(docs, length).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == passages_brute(pairs_of(docs), length)


def test_multikey_quicksort():
    random = np.random.Generator(np.random.PCG64(1))
    columns = [random.integers(0, 4, 3000), random.integers(-3, 3, 3000), random.integers(0, 1 << 60, 3000)]
    order = suffix_dedup.multikey_quicksort(columns)
    assert (np.stack(columns, 1)[order] == np.stack(columns, 1)[np.lexsort(columns[::-1])]).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 200), (None, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_nothing(nothing):
    assert exact_dedup.equal_groups(nothing).count() == 0
    assert jaccard_join.near_duplicates(nothing).count() == 0
    assert line_dedup.clean_lines(nothing).count() == 0
    assert suffix_dedup.repeated_passages(nothing).count() == 0
