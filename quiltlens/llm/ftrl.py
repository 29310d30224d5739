"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from quiltlens.llm.rows import only, slices, word_cache

BITS = 18
SHARD_ROWS = 3_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5
SCALE = 4.0
CACHE = 400_000

_RUNS = [(re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"0")]


class _Codes(dict):
    """word -> its hash (low 32 bits) and the hash of its shape (high 32 bits)."""

    def __missing__(self, word: bytes) -> int:
        shape = word
        for runs, letter in _RUNS:
            shape = runs.sub(letter, shape)
        code = xxhash.xxh32_intdigest(word.lower()) | xxhash.xxh32_intdigest(shape, 1) << 32
        if len(self) >= CACHE:
            self.clear()
        self[word] = code
        return code


_CODES = word_cache(_Codes())
_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _slot(value: np.ndarray, kind: int, bits: int) -> np.ndarray:
    mixed = (value + np.uint64(kind * 0x51ED27)) * _MIX[0]
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * _MIX[1]) >> np.uint64(64 - bits)).astype(np.int64)


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """``(slots, n_words)``: one column of ``slots`` per word of all texts, one row per n-gram kind.

    Kinds: word, word pair, the shapes of two and of three words, and whether a word repeats one of the two before it.
    An n-gram that would cross the end of its document has slot ``2**bits``, which has no weight.
    """
    only(_CODES)
    words = [t.split() for t in texts]
    n_words = np.array([len(w) for w in words], dtype=np.int64)
    total = int(n_words.sum())
    codes = np.fromiter((c for w in words for c in map(_CODES.__getitem__, w)), dtype=np.uint64, count=total)
    word, shape = codes & np.uint64(0xFFFFFFFF), codes >> np.uint64(32)
    left = np.arange(total, 0, -1) - np.repeat(total - np.cumsum(n_words), n_words)  # words from here to the end of the document
    none = 1 << bits
    out = np.full((6, total), none, dtype=np.int64)
    out[0] = _slot(word, 1, bits)
    two, three = left[:-1] > 1, left[:-2] > 2
    out[1, :-1] = np.where(two, _slot(word[:-1] * _MIX[2] + word[1:], 2, bits), none)
    out[2, :-1] = np.where(two, _slot(shape[:-1] * _MIX[2] + shape[1:], 3, bits), none)
    out[3, :-2] = np.where(three, _slot((shape[:-2] * _MIX[2] + shape[1:-1]) * _MIX[3] + shape[2:], 4, bits), none)
    out[4, :-1] = np.where(two, _slot((word[:-1] == word[1:]).astype(np.uint64), 5, bits), none)
    out[5, :-2] = np.where(three, _slot((word[:-2] == word[2:]).astype(np.uint64), 6, bits), none)
    return out, n_words


def sparse_rows(texts: list[bytes], bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its n-gram slots and their values: counts over the number of words, and the bias slot with 1."""
    slots, n_words = features(texts, bits)
    ends = np.cumsum(n_words)
    rows = []
    for end, n in zip(ends, n_words):
        own, counts = np.unique(slots[:, end - n:end], return_counts=True)
        keep = own < (1 << bits)
        rows.append((np.append(own[keep], (1 << bits) + 1), np.append(counts[keep] * (SCALE / max(1, n)), 1.0)))
    return rows


def ftrl_fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights after ``epochs`` passes of per-coordinate follow-the-regularised-leader updates; the last is the bias."""
    z, n = np.zeros((1 << bits) + 2), np.zeros((1 << bits) + 2)

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for (at, value), label in zip(rows, labels):
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - label) * value
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    return weights(np.arange(len(z)))


def shards_of(rows: int) -> int:
    return max(1, -(-rows // SHARD_ROWS))


def fit(labelled: DataFrame, bits: int = BITS, dealt: bool = False) -> np.ndarray:
    """Weights from all rows of ``labelled(id, text, label)``.

    Shards of about 3,000 rows train on their own and their weights are averaged, so more rows make more tasks; with
    ``dealt`` the partitions of ``labelled`` are the shards.
    Without rows every weight is 0 and every score 0.5.
    """

    def train(batches):
        kept = pd.concat([b for b in batches] or [pd.DataFrame({"id": [], "text": [], "label": []})])
        if not len(kept):
            return
        kept = kept.iloc[np.argsort([xxhash.xxh64_intdigest(str(i)) for i in kept["id"]], kind="stable")]
        texts, rows = [t or b"" for t in kept["text"]], []
        for a, b in slices(texts):
            rows += sparse_rows(texts[a:b], bits)
        w = ftrl_fit(rows, list(kept["label"]), bits)
        at = np.flatnonzero(w)
        yield pd.DataFrame({"at": at, "w": w[at]})
        yield pd.DataFrame({"at": [-1], "w": [1.0]})  # shards that had rows

    shaped = labelled.select("id", F.col("text").cast("binary").alias("text"), "label")
    parts = (shaped if dealt else shaped.repartition(shards_of(labelled.count()))).mapInPandas(train, "at long, w double")
    summed = parts.groupBy("at").agg(F.sum("w").alias("w")).toPandas()  # at most 2**bits + 3 rows, whatever the input
    out = np.zeros((1 << bits) + 2)
    if len(summed):
        at, w = summed["at"].to_numpy(), summed["w"].to_numpy()
        out[at[at >= 0]] = w[at >= 0] / w[at < 0].sum()
    out[1 << bits] = 0.0
    return out


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", name: str = "score", bits: int = BITS, without: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with a score from 0 to 1 as column ``name``: a sparse dot product of each whole text with the weights.

    A null or empty text has the score of the bias. Only words of the text are read. An existing column ``name`` is
    replaced; columns in ``without`` are left out of the result.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(weights.astype(np.float32))  # 2**bits + 2 numbers
    rest = [c for c in docs.columns if c != name]
    shown = [c for c in rest if c not in without]
    schema = docs.select(shown).schema.add(name, "double")

    def dot(batches):
        w = held.value
        for batch in batches:
            texts, scores = [t.encode() if t else b"" for t in batch[text_col]], np.empty(len(batch))
            for a, b in slices(texts):
                slots, n_words = features(texts[a:b], bits)
                sums = np.zeros(b - a)
                full = n_words > 0
                if full.any():
                    starts = (np.cumsum(n_words) - n_words)[full]
                    sums[full] = np.add.reduceat(w[slots].sum(axis=0, dtype=np.float64), starts) * SCALE / n_words[full]
                scores[a:b] = 1 / (1 + np.exp(-np.clip(sums + w[-1], -35, 35)))
            yield batch[shown].assign(**{name: scores})

    return docs.select(rest).mapInPandas(dot, schema)


def held_out(id_col: str):
    """Rows never learned from: crc32 of the id as text is divisible by 5 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``id, text, label`` of the labelled documents that are not held out, dealt to shards by id.

    Repeated labels count once, the lower one. Texts move once, straight to their shard, whatever the size of ``labels``;
    how many shards there are comes from the ids alone.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label")).dropna()
    texts = docs.filter(~held_out("doc_id")).select(F.col("doc_id").alias("id"), "text")
    shards = shards_of(texts.select("id").join(known, "id", "left_semi").count())
    met = texts.select("*", F.lit(None).cast("int").alias("label"), F.lit(True).alias("_doc")).unionByName(known.select("id", F.lit(None).cast("string").alias("text"), "label", F.lit(False).alias("_doc")))
    told = met.repartition(shards, "id").withColumn("label", F.min("label").over(Window.partitionBy("id")))
    return told.filter(F.col("_doc") & F.col("label").isNotNull()).drop("_doc")


def fit_quality(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights for ``labels(doc_id, quality)`` from documents that are not held out."""
    return fit(training_rows(docs, labels), dealt=True)
