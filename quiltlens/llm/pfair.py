"""Mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

import uuid
from fractions import Fraction
from heapq import heappop, heappush
from itertools import islice
from math import lcm

from pyspark.sql import DataFrame, SparkSession, functions as F

from quiltlens.llm.rows import dense_rows, partitions
from quiltlens.session import shared_dir

BLOCK_ROWS = 64
TEMPERATURE = 0.7
CHUNK = 200_000  # blocks that the driver holds at once


def exact(weights: dict[str, float]) -> dict[str, int]:
    """The weights over a common denominator: nothing is rounded."""
    parts = {s: Fraction(w) for s, w in weights.items()}
    if bad := [s for s, w in parts.items() if w <= 0]:
        raise ValueError(f"weights have to be positive: {sorted(bad)[:5]}")
    common = lcm(*(w.denominator for w in parts.values()))
    return {s: w.numerator * (common // w.denominator) for s, w in parts.items()}


class _Line:
    """Sources, the heaviest first; one that is used up leaves in constant time."""

    def __init__(self, whole: dict[str, int]):
        order = [None, *sorted(whole, key=lambda s: (-whole[s], s)), None]
        self.after, self.before = dict(zip(order[:-1], order[1:])), dict(zip(order[1:], order[:-1]))

    def leave(self, s: str) -> None:
        a, b = self.before.pop(s), self.after.pop(s)
        self.after[a], self.before[b] = b, a


def turns(whole: dict[str, int], total: int, line: _Line):
    """The source of slot 0, 1, 2, ...: earliest deadline first among released blocks.

    Block k of a source with the share w = whole / total is released at floor(k / w) and due at ceil((k + 1) / w), in
    integers. The shares add up to one, so every block meets its deadline and no source is ever a block ahead or behind.
    First blocks are all released at once and due by weight, so sources whose turn has not come yet cost nothing.
    """
    taken: dict[str, int] = {}
    ready: list[tuple[int, str]] = []
    waiting: list[tuple[int, str]] = []
    fresh, t = line.after[None], 0
    while True:
        while waiting and waiting[0][0] <= t:
            s = heappop(waiting)[1]
            heappush(ready, (-(-(taken[s] + 1) * total // whole[s]), s))
        if fresh is not None and (not ready or (-(-total // whole[fresh]), fresh) < ready[0]):
            due, s = -(-total // whole[fresh]), fresh
            fresh = line.after[fresh]
        else:
            due, s = heappop(ready)
        if due <= t:
            raise AssertionError("a deadline was missed")
        taken[s] = taken.get(s, 0) + 1
        heappush(waiting, (taken[s] * total // whole[s], s))
        yield s
        t += 1


def one_period(quota: dict[str, int]) -> dict[str, list[int]]:
    """Slots of each source's blocks in one period of as many slots as the quotas add up to."""
    slots: dict[str, list[int]] = {s: [] for s in quota}
    period = sum(quota.values())
    for t, s in enumerate(islice(turns(quota, period, _Line(quota)), period)):
        slots[s].append(t)
    return slots


def schedule(blocks: dict[str, int], weights: dict[str, float]):
    """``(source, block, phase, slot)`` of every block, slot by slot.

    A phase lasts until one of its sources has no block left; then the others go on with their weights, from a share of
    nothing. A block costs some integer arithmetic and two heap steps, whatever the number of sources and phases.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    if not left:
        return
    whole, done = exact({s: weights[s] for s in left}), dict.fromkeys(left, 0)
    total, line, slot, phase = sum(whole.values()), _Line(whole), 0, 0
    while left:
        for s in turns(whole, total, line):
            yield s, done[s], phase, slot
            slot += 1
            done[s] += 1
            if done[s] == left[s]:
                break
        del left[s]
        line.leave(s)
        total -= whole[s]
        phase += 1


def pfair_mix(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id",
              source_col: str = "source", tie_cols: list[str] | None = None) -> DataFrame:
    """``docs`` with ``mix_block`` (number in its source), ``mix_phase``, ``mix_slot`` and ``mix_offset`` (row in its block).

    Read in the order (mix_slot, mix_offset), the sources come at their target weights: after any number of slots of a
    phase each source is less than one block from its share. Every row is used once; a source that is used up leaves
    its share to the others (a new phase). ``weights`` are relative and positive; without them a source weighs its
    number of rows to the power 0.7. Sources are split into blocks of 64 rows by id (ties by ``tie_cols``), a source's
    last block may be shorter. A null source is the source "". Sources without a given weight are an error. The driver
    works out the slot of each block of 64 rows from the exact weights and writes them 200,000 at a time, so its memory is
    bounded by the number of sources, its time by the number of blocks; a hot source is numbered and joined over many
    tasks. Columns of ``docs`` with the names of the results are replaced; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.drop("mix_block", "mix_phase", "mix_slot", "mix_offset")
    own = {f"_own{i}": c for i, c in enumerate(docs.columns)}
    back = {c: k for k, c in own.items()}
    inner = docs.select(*[docs[c].alias(k) for k, c in own.items()]).withColumn("src", F.coalesce(F.col(back[source_col]).cast("string"), F.lit("")))
    rows = dense_rows(inner, [back[id_col], *[back[c] for c in tie_cols or []]], ["src"], "src_row", "pfair")
    counts = {r["src"]: r["n"] for r in rows.groupBy("src").agg(F.count("*").alias("n")).collect()}  # one row per source
    weights = weights or {s: n ** TEMPERATURE for s, n in counts.items()}
    if missing := set(counts) - set(weights):
        raise ValueError(f"no weight for sources {sorted(missing)[:5]}")
    slots = _written(spark, schedule({s: -(-n // block_rows) for s, n in counts.items()}, weights))
    b = rows.withColumn("block", F.expr(f"src_row div {block_rows}L")).join(slots, (F.col("src") == F.col("slot_src")) & (F.col("block") == F.col("slot_block")))
    return b.select(*[F.col(k).alias(c) for k, c in own.items()], F.col("block").alias("mix_block"), F.col("phase").alias("mix_phase"),
                    F.col("at").alias("mix_slot"), (F.col("src_row") % block_rows).alias("mix_offset"))


def _written(spark: SparkSession, slots) -> DataFrame:
    """``slot_src, slot_block, phase, at`` from ``(source, block, phase, slot)``, a bounded part in the driver at a time."""
    path, kind = f"{shared_dir(spark)}/quiltlens/slots-{uuid.uuid4().hex}", "slot_src string, slot_block long, phase int, at long"
    while True:
        part = list(islice(slots, CHUNK))
        spark.createDataFrame(part, kind, verifySchema=False).write.mode("append").parquet(path)
        if len(part) < CHUNK:
            return spark.read.schema(kind).parquet(path)


def in_mix_order(mixed: DataFrame) -> DataFrame:
    """The rows range-partitioned and sorted into the mixed order, so that files and the rows in them follow it."""
    return mixed.repartitionByRange(partitions(mixed.sparkSession), "mix_slot", "mix_offset").sortWithinPartitions("mix_slot", "mix_offset")

