"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quiltlens.session import materialize


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_CACHES: list[dict] = []


def word_cache(cache: dict) -> dict:
    """Registers a cache of words that lives as long as its Python worker."""
    _CACHES.append(cache)
    return cache


def only(cache: dict) -> None:
    """Empties the other caches: a worker goes from one operator's tasks to the next one's and should not hold the words of both."""
    for other in _CACHES:
        if other is not cache and other:
            other.clear()


def dense_rows(df: DataFrame, order: list[str], group: list[str] | None = None, name: str = "row_no", label: str = "rows") -> DataFrame:
    """``df`` with gapless numbers from 0 (per ``group``) in the given order, without gathering a group in one task.

    Rows are range-partitioned by (group, order), so a group of any size is split over tasks. The position inside
    the partition is known there; the counts of earlier partitions, at most one row per partition and group, are
    added by a join. ``order`` has to be total but for rows that are alike.
    """
    group = group or []
    keys = [*group, *order]
    sorted_rows = df.repartitionByRange(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    marked = materialize(
        sorted_rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), label
    )
    sizes = marked.groupBy(*group, "_part").agg(F.min("_at").alias("_lo"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    own = {g: f"_group{i}" for i, g in enumerate(group)}
    sizes = sizes.select(*[F.col(g).alias(k) for g, k in own.items()], F.col("_part").alias("_of"), "_lo", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    on = F.col("_part") == F.col("_of")
    for g, k in own.items():
        on = on & F.col(g).eqNullSafe(F.col(k))
    return marked.join(sizes, on).select(*df.columns, (F.col("_at") - F.col("_lo") + F.col("_before")).alias(name))


def slices(texts: list, budget: int = 2_000_000):
    """``(start, end)`` runs of ``texts`` of about ``budget`` bytes each, so that word lists of a batch stay small."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= budget:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


SPACES = b" \t\n\x0b\x0c\r"
_rng = np.random.default_rng(20240917)
_LETTERS = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15  # odd, so its powers have inverses modulo 2^64
_POWERS = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_prints(texts: list[bytes], reads_as: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit prints of all words of ``texts``, one text after the other, and the number of words of each text.

    Words are what ``bytes.split()`` gives. A print is a polynomial of the word's bytes, computed for all words at once:
    place values count from the first byte of the slice and are taken back to the word's own start. ``reads_as`` maps
    bytes before printing (0: left out); a word that has no bytes left has print 0.
    """
    raw = np.frombuffer(b" ".join([b"", *texts, b""]), dtype=np.uint8)
    space = _IS_SPACE[raw]
    begins = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    counts = np.diff(np.append(0, np.searchsorted(begins, ends + 1)))
    if reads_as is None:
        keep = ~space
        body = raw[keep]
    else:
        read = reads_as[raw]
        keep = read > 0
        body = read[keep]
    if not len(begins):
        return np.zeros(0, dtype=np.uint64), counts
    up, down = _powers(len(body) + 1)
    before = np.cumsum(keep, dtype=np.int64)
    at = before[begins] - keep[begins]  # kept bytes before each word
    values = np.append(_LETTERS[body] * up[:-1], np.uint64(0))
    prints = np.add.reduceat(values, at) * down[at]
    prints[np.append(at[1:], len(body)) == at] = 0
    prints ^= prints >> np.uint64(32)
    prints *= np.uint64(0xD6E8FEB86659FD93)
    prints ^= prints >> np.uint64(32)
    return prints, counts


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
