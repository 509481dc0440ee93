"""Recall of near copies by similarity: every pair at 0.8 or more is linked, none below is."""

import random

import pytest

from maskwright.llm import op3_bagminhash

from . import brute


@pytest.mark.parametrize("low, high", [(0.8, 0.82), (0.82, 0.85), (0.85, 0.9), (0.9, 0.95), (0.95, 1.0)])
def test_band(spark, low, high):
    rng, rows, sims = random.Random(int(low * 100)), [], []
    while len(sims) < 100:
        n = rng.randint(40, 400)
        words = [f"{len(sims)}w{rng.randrange(n)}" for _ in range(n)]
        other = list(words)
        for _ in range(rng.randint(1, 1 + n // 20)):
            i = rng.randrange(len(other))
            other[i : i + 1] = rng.choice([["new"], [], [other[i], "more"]])
        a, b = " ".join(words), " ".join(other)
        s = op3_bagminhash.similarity(brute.bag(a), brute.bag(b))
        if low <= s < high:
            rows += [(2 * len(sims), a), (2 * len(sims) + 1, b)]
            sims.append(s)
    got = {r.doc_id: r.class_id for r in op3_bagminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = sum(got[2 * i] == got[2 * i + 1] for i in range(len(sims)))
    assert caught >= 99 and all(got[2 * i] == 2 * i for i in range(len(sims)))
