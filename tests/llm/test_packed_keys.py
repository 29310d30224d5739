"""Stretches meet by key as packed numbers: nothing is shuffled stretch by stretch before it is known to repeat."""

import random

import numpy as np
from pyspark.sql import functions as F

from quiltlens.llm import fm_index


def test_packed_numbers_come_back():
    for values in ([0], [0, 255, 256], [5, 1 << 47, 3], [(1 << 62) + 1] * 3):
        data = fm_index._packed(np.array(values, dtype=np.int64))
        assert fm_index._unpacked(data, len(values)).tolist() == values
    assert len(fm_index._packed(np.arange(200))) == 200


def test_repeated_keys_equal_plain_loops(spark, monkeypatch):
    r = random.Random(6)
    words = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    shared = [words(40) for _ in range(4)]
    texts = [f"{words(30)} {r.choice(shared)} {words(r.randrange(30))}" for _ in range(60)] + ["", "short text", words(200)]
    own = spark.createDataFrame([((i * 37 % 64) << 33 | i, t.encode()) for i, t in enumerate(texts)], "uid long, body binary").repartition(3)
    uids = {t.encode(): u for u, t in [(x.uid, x.body.decode()) for x in own.collect()]}
    key, text, at, n = fm_index.stretches([t.encode() for t in texts])
    owners: dict = {}
    for k, t in zip(key.tolist(), text.tolist()):
        owners.setdefault(k, set()).add(t)
    want = sorted((k, uids[texts[t].encode()], a, m) for k, t, a, m in zip(key.tolist(), text.tolist(), at.tolist(), n.tolist()) if len(owners[k]) > 1)
    for size in (12_000_000, 40):
        monkeypatch.setattr(fm_index, "PART_BYTES", size)
        assert sorted(tuple(x) for x in fm_index._repeated(own).collect()) == want and want
    assert fm_index._repeated(own.filter(F.lit(False))).count() == 0
