"""What lies on disks while a step runs, and which pairs of a list are looked at."""

import random

import numpy as np
import pytest
from conftest import invented

from tarncast.llm import line_dedup, setjoin


@pytest.fixture(scope="module")
def plain(spark):
    """Rows with ids of their own, repeated lines and a near copy."""
    texts = ["\n".join([invented(30, n), invented(30, 900), "short line"]) for n in range(12)] + [invented(90, 50), invented(90, 50) + " tail"]
    return spark.createDataFrame([(3 * n + 1, text, "s", len(text)) for n, text in enumerate(texts)], "doc_id bigint, text string, source string, n_chars bigint")


def test_shuffle_files_go_before_texts_are_dealt_again(spark, plain, monkeypatch):
    """Files of the token lists lay on disk while texts were shuffled for tokens and for the answer."""
    steps, release = [], setjoin.release

    def watched(name, module, function):
        def run(*args, **more):
            steps.append(name)
            return function(*args, **more)

        monkeypatch.setattr(module, function.__name__, run)

    watched("release", setjoin, release)
    watched("release", line_dedup, release)
    watched("arrays", setjoin, setjoin.work_path)
    durable = setjoin.durable
    watched("query", setjoin, durable)
    watched("query", line_dedup, line_dedup.durable)
    line_dedup.clean_lines(plain)
    first = steps.index("arrays", steps.index("arrays") + 1)
    assert "release" in steps[steps.index("query") + 1 : first + 2]  # behind a query, before the texts are dealt
    assert steps[-2:] == ["query", "release"]


@pytest.mark.parametrize("cells", [1, 7, 1 << 18])
def test_open_pairs_in_steps_of_any_size(monkeypatch, cells):
    monkeypatch.setattr(setjoin, "CELLS", cells)
    pick = random.Random(4)
    notes = np.array([{"id": pick.randrange(4), "part": number, "gone": pick.random() < 0.5} for number in range(9)] + [None], dtype=object)[:-1]
    blocks = np.array([0] * 5 + [1] * 4)
    wanted, key = line_dedup.still_open(notes), lambda at: (notes[at]["id"], notes[at]["part"])
    for i, j in ((-1, -1), (0, 1)):
        got = {(int(at), other) for places, later in setjoin.pairings(blocks if i != j else blocks * 0 - 1, i, j) for at, own in zip(places, later & wanted(places), strict=True) for other in np.flatnonzero(own).tolist()}
        pairs = [(a, b) for a in range(9) for b in range(a + 1, 9) if i == j or (a < 5 <= b)]
        assert got == {(a, b) for a, b in pairs if not notes[max(a, b, key=key)]["gone"]}
