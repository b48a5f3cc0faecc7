"""The pipeline's near_dedup stage against brute-force Jaccard similarity."""

from fractions import Fraction

import corpus_pipeline
import numpy as np
import pytest

COLUMNS = "doc_id long, text string"


def slow_sets(texts):
    words = {i: t.split() for i, t in texts.items()}
    return {i: {tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} for i, w in words.items()}


def similarity(a, b):
    return Fraction(len(a & b), len(a | b))


def changed(words, at, mark):
    return " ".join(f"{mark}{i}" if i in at else w for i, w in enumerate(words))


def planted(similar: bool):
    """Pairs whose similarity is in 0.8-0.84 or in 0.74-0.8, and the texts by id."""
    r, texts, low, high = np.random.default_rng(5), {}, *((0.8, 0.84) if similar else (0.74, 0.7999))
    while len(texts) < 200:
        words = [f"w{x}" for x in r.integers(0, 10**6, r.integers(100, 300))]
        at = {int(x) for x in r.choice(len(words), len(words) // (45 if similar else 36), replace=False)}
        pair = {0: " ".join(words), 1: changed(words, at, f"new{len(texts)}-")}
        sets = slow_sets(pair)
        if low <= similarity(sets[0], sets[1]) <= high:
            texts |= {len(texts) + k: t for k, t in pair.items()}
    return texts


@pytest.fixture(scope="module")
def survivors(spark):
    return lambda rows: sorted((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, COLUMNS), None).collect())


def test_pairs_just_above_the_limit_link(survivors):
    texts = planted(True)
    assert survivors(list(texts.items())) == [(i, texts[i]) for i in sorted(texts) if i % 2 == 0]


def test_pairs_below_the_limit_all_stay(survivors):
    texts = planted(False)
    assert survivors(list(texts.items())) == sorted(texts.items())


def test_rows_of_repeated_ids_are_judged_apart(survivors):
    x, y, z = ("one two three four five six", "some other words that stay here", "and a third text of seven words")
    assert survivors([(3, x), (5, x), (5, y), (6, z), (6, y)]) == [(3, x), (5, y), (6, z)]
