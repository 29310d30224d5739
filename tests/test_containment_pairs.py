"""Containment by pairs in small groups and by grams in large ones, against plain loops."""

import random

import pytest

from quiltlens.operators import containment as N


@pytest.mark.parametrize("limit", [0, 1, 128])
def test_both_ways_give_the_same(spark, monkeypatch, limit):
    monkeypatch.setattr(N, "PAIRS_PER_TEXT", limit)
    made = []
    index = N._index
    monkeypatch.setattr(N, "_index", lambda *a: made.append(1) or index(*a))
    r = random.Random(2)
    word = lambda: "".join(r.choice("ab c") for _ in range(r.choice([0, 1, 2, 3, 4, 6, 11])))
    texts = [(k, word()) for k in (0, 1) for _ in range(3 + 60 * k)]
    rows = [(k, word(), i) for k in (0, 1) for i in range(2 + 60 * k)]
    t, v = spark.createDataFrame(texts, "k long, text string"), spark.createDataFrame(rows, "k long, text string, v long")
    for name, holds in (("around", lambda a, b: a in b), ("within", lambda a, b: b in a)):
        want = {}
        for k, a in texts:
            hits = [i for kk, b, i in rows if a and b and k == kk and holds(a, b)]
            if hits:
                want[k, a] = (min(hits), max(hits))
        assert {(x.k, x.text): (x.lo, x.hi) for x in getattr(N, name)(t, v, ["k"], "v").collect()} == want, name
    assert bool(made) == (limit < 128)  # small groups need no grams
