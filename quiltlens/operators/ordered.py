"""Running computations over an order, safe for groups of any size.

A plain window sorts one whole group inside one task. Here rows are range
partitioned by (keys, order), so one large group spreads over many chunks; each
chunk computes its local running values and then receives the carry of the
chunks before it. A chunk continues at most one group from the chunk before
(or after) it, so the carry table has no more rows than there are chunks.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quiltlens.session import materialize

_CHUNK = "_chunk"


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    outputs: dict[str, tuple[str, Column | None]],
    label: str = "running",
    small: bool = False,
) -> DataFrame:
    """Add running columns to ``df``.

    With ``small`` the caller knows that every group fits a task: plain windows, no chunks, no table is written.

    ``order`` must make rows unique inside a group. ``outputs`` maps a new column to
    ``(kind, expr)``; kinds: ``lag``, ``lead``, ``sum`` (up to this row), ``max``
    (up to this row), ``max_before`` (rows before this one), ``last`` (last non-null
    before this row), ``next`` (first non-null after this row), ``row_number``.
    """
    prepared = df
    for name, (kind, expr) in outputs.items():
        prepared = prepared.withColumn(f"_in_{name}", F.lit(1) if kind == "row_number" else expr)
    chunked = prepared.withColumn(_CHUNK, F.lit(0)) if small else materialize(
        prepared.repartitionByRange(*[F.col(c) for c in [*keys, *order]]).withColumn(_CHUNK, F.spark_partition_id()),
        label,
    )
    local = W.partitionBy(*([] if small else [_CHUNK]), *keys).orderBy(*order)
    upto = local.rowsBetween(W.unboundedPreceding, 0)
    before = local.rowsBetween(W.unboundedPreceding, -1)
    after = local.rowsBetween(1, W.unboundedFollowing)
    spot = F.struct(*[F.col(c) for c in order])
    across = W.partitionBy(*keys).orderBy(_CHUNK)
    earlier = across.rowsBetween(W.unboundedPreceding, -1)
    later = across.rowsBetween(1, W.unboundedFollowing)

    own, edge, carry, final = [], [], [], {}
    for name, (kind, _) in outputs.items():
        src, loc, brought = F.col(f"_in_{name}"), f"_loc_{name}", f"_car_{name}"
        boxed = F.struct(src.alias("v"))
        if kind in ("sum", "row_number"):
            own.append(F.sum(src).over(upto).alias(loc))
            edge.append(F.sum(src).alias(f"_e_{name}"))
            carry.append(F.sum(f"_e_{name}").over(earlier).alias(brought))
            final[name] = F.coalesce(F.col(loc), F.lit(0)) + F.coalesce(F.col(brought), F.lit(0))
        elif kind in ("max", "max_before"):
            own.append(F.max(src).over(upto if kind == "max" else before).alias(loc))
            edge.append(F.max(src).alias(f"_e_{name}"))
            carry.append(F.max(f"_e_{name}").over(earlier).alias(brought))
            final[name] = F.greatest(F.col(loc), F.col(brought))
        elif kind == "lag":
            own.append(F.lag(boxed).over(local).alias(loc))
            edge.append(F.max_by(boxed, spot).alias(f"_e_{name}"))
            carry.append(F.last(f"_e_{name}").over(earlier).alias(brought))
            final[name] = F.coalesce(F.col(loc), F.col(brought))["v"]
        elif kind == "lead":
            own.append(F.lead(boxed).over(local).alias(loc))
            edge.append(F.min_by(boxed, spot).alias(f"_e_{name}"))
            carry.append(F.first(f"_e_{name}").over(later).alias(brought))
            final[name] = F.coalesce(F.col(loc), F.col(brought))["v"]
        elif kind == "last":
            own.append(F.last(src, ignorenulls=True).over(before).alias(loc))
            edge.append(F.max_by(src, F.when(src.isNotNull(), spot)).alias(f"_e_{name}"))
            carry.append(F.last(f"_e_{name}", ignorenulls=True).over(earlier).alias(brought))
            final[name] = F.coalesce(F.col(loc), F.col(brought))
        elif kind == "next":
            own.append(F.first(src, ignorenulls=True).over(after).alias(loc))
            edge.append(F.min_by(src, F.when(src.isNotNull(), spot)).alias(f"_e_{name}"))
            carry.append(F.first(f"_e_{name}", ignorenulls=True).over(later).alias(brought))
            final[name] = F.coalesce(F.col(loc), F.col(brought))
        else:
            raise ValueError(f"unknown running kind: {kind}")

    if small:
        boxes = ("lag", "lead")
        return chunked.select("*", *own).select(*df.columns, *[
            (F.col(f"_loc_{n}")["v"] if kind in boxes else F.coalesce(f"_loc_{n}", F.lit(0)) if kind in ("sum", "row_number") else F.col(f"_loc_{n}")).alias(n)
            for n, (kind, _) in outputs.items()])
    brought_cols = [f"_car_{n}" for n in outputs]
    carries = (
        chunked.groupBy(*keys, _CHUNK).agg(*edge, F.lit(1).alias("_one"))
        .withColumn("_spans", F.count("_one").over(W.partitionBy(*keys)))
        .filter("_spans > 1")
        .select(*keys, _CHUNK, *carry)
    )
    with_local = chunked.select("*", *own)
    # at most two group edges per chunk: bounded by the partition count, not by the data
    own_keys = {c: f"_key{i}" for i, c in enumerate([*keys, _CHUNK])}
    brought = carries.select(*[F.col(c).alias(k) for c, k in own_keys.items()], *brought_cols)
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(k)) for c, k in own_keys.items()])  # null is a key like any other
    joined = with_local.join(F.broadcast(brought), same, "left")
    return joined.select(*df.columns, *[final[n].alias(n) for n in outputs])
