"""Overlap joins on a grid of several levels.

A box lies in the level whose cells are at least as large as the box, so it touches at most two cells a side. Two boxes
of one level meet in a cell they share. Boxes of different levels meet where the larger one looks for the smaller: the
smaller one is also filed under the cells of the coarser levels that hold boxes, one or two a side, and again at most
four in all for each level there is. Levels are a factor of four apart; how many there are grows with the logarithm of
the ratio of sizes, not with the sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

STEP = 4  # cell sides of neighbouring levels


def _level(side: Column, cell: float) -> Column:
    """The first level whose cells are at least ``side`` long."""
    raw = F.ceil(F.log(F.greatest(side, F.lit(float(cell))) / cell) / F.log(F.lit(float(STEP)))).cast("int")
    return F.when(F.lit(float(cell)) * F.pow(F.lit(float(STEP)), raw) < side, raw + 1).otherwise(raw)  # rounding never makes it too fine


def _cells(start: Column, length: Column, side: Column) -> Column:
    return F.sequence(F.floor(start / side), F.floor((start + length) / side))


def _first(a: Column, b: Column, side: Column) -> Column:
    """The cell in which an overlap begins, so that a pair that shares several is told once."""
    return F.floor(F.greatest(a, b) / side)


def _filed(df: DataFrame, keys: list[str], axes: list[tuple[str, str]], cell: float) -> tuple[DataFrame, DataFrame]:
    """Rows with their level, and ``keys, level`` of the levels in use."""
    size = F.greatest(*[F.col(n) for _, n in axes], F.lit(0.0))
    placed = df.withColumn("_level", _level(size, cell))
    return placed, placed.select(*keys, F.col("_level").alias("_at")).distinct()


def _in_cells(df: DataFrame, axes: list[tuple[str, str]], cell: float) -> DataFrame:
    out = df.withColumn("_side", F.lit(float(cell)) * F.pow(F.lit(float(STEP)), F.col("_at")))
    for i, (at, n) in enumerate(axes):
        out = out.withColumn(f"_c{i}", F.explode(_cells(F.col(at), F.col(n), F.col("_side"))))
    return out


def _meet(left: DataFrame, right: DataFrame, keys: list[str], axes: list[tuple[str, str]], cell: float) -> DataFrame:
    """Pairs of ``left`` rows, each in its own level, and ``right`` rows of the same or a finer level, filed under all coarser levels of ``left``."""
    a, used = _filed(left, keys, axes, cell)
    b, _ = _filed(right, keys, axes, cell)
    a = _in_cells(a.withColumn("_at", F.col("_level")), axes, cell)
    b = _in_cells(b.join(used, keys).filter("_level <= _at"), axes, cell)  # a few rows for each box: one a level in use
    slot = [*keys, "_at", *[f"_c{i}" for i in range(len(axes))]]
    pack = lambda df, columns, name: df.select(*slot, "_side", F.struct(*columns, "_level").alias(name))
    met = pack(a, left.columns, "a").join(pack(b, right.columns, "b").drop("_side"), slot)
    for i, (at, n) in enumerate(axes):
        begins = F.col(f"_c{i}") == _first(F.col(f"a.{at}"), F.col(f"b.{at}"), F.col("_side"))
        met = met.filter(begins & (F.col(f"a.{at}") < F.col(f"b.{at}") + F.col(f"b.{n}")) & (F.col(f"b.{at}") < F.col(f"a.{at}") + F.col(f"a.{n}")))
    return met


def overlapping_boxes(boxes: DataFrame, keys: list[str], id_col: str, cell: float = 256) -> DataFrame:
    """``keys, a, b``: pairs of ``boxes(keys, id, x, y, w, h)`` of one key that overlap, the smaller id as ``a``."""
    axes = [("x", "w"), ("y", "h")]
    met = _meet(boxes, boxes, keys, axes, cell)
    finer = F.col("b._level") < F.col("a._level")
    one = met.filter(finer | ((F.col("a._level") == F.col("b._level")) & (F.col(f"a.{id_col}") < F.col(f"b.{id_col}"))))
    turned = F.col(f"a.{id_col}") > F.col(f"b.{id_col}")
    return one.select(*keys, F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"))


def overlapping_spans(left: DataFrame, right: DataFrame, keys: list[str], cell: float = 512) -> DataFrame:
    """``keys, a, b``: pairs of ``left(keys, at, size)`` and ``right(keys, at, size)`` spans of one key that overlap."""
    axes = [("at", "size")]
    met = _meet(left, right, keys, axes, cell).select(*keys, "a", "b")
    other = _meet(right, left, keys, axes, cell).filter("b._level < a._level").select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))
    return met.unionByName(other)
