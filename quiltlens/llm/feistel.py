"""Sharding by a Feistel permutation with cycle walking over global row numbers (native)."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame, functions as F

from quiltlens.llm.rows import dense_rows

ROUNDS = 6
P31 = 2147483647
SHARDS = 16
KEY = 20231


def sides(n: int) -> tuple[int, int]:
    """``a * b >= n`` with fewer than ``a`` values too many, so that walks are rare and short."""
    a = max(1, isqrt(max(0, n - 1)) + 1) if n > 1 else 1
    return a, max(1, -(-n // a))


def round_keys(key: int) -> list[int]:
    return [(key * 7919 + 104729 * (i + 1)) % P31 for i in range(ROUNDS)]


def _mix(v: int, k: int) -> int:
    u = ((v + k) % P31) * 48271 % P31
    u ^= u >> 13
    u = u * 69621 % P31
    return u ^ (u >> 11)


def permute(x: int, a: int, b: int, key: int) -> int:
    """One pass of the permutation of ``0 .. a*b-1``; the column form below is the same arithmetic."""
    left, right = divmod(x, b)
    for i, k in enumerate(round_keys(key)):
        if i % 2 == 0:
            left = (left + _mix(right, k)) % a
        else:
            right = (right + _mix(left, k)) % b
    return left * b + right


def longest_walk(n: int, key: int) -> int:
    """How many extra passes any row needs: the longest chain through the fewer than sqrt(n) + 1 values outside.

    A chain that a row enters loses a value with each pass; what no longer shrinks are cycles that no row enters.
    """
    a, b = sides(n)
    outside, steps = list(range(n, a * b)), 0
    while outside:
        moved = [y for x in outside if (y := permute(x, a, b, key)) >= n]
        if len(moved) == len(outside):
            break
        outside, steps = moved, steps + 1
    return steps


def step_sql(a: str, b: str, key: int, xor: str = "({0} ^ {1})", shift: str = "shiftright({0}, {1})", div: str = "{0} div {1}") -> list[dict[str, str]]:
    """The rounds as SQL: each entry sets ``l`` and ``r`` (and helpers ``u``, ``w``) from the ones before."""
    steps = []
    for i, k in enumerate(round_keys(key)):
        src = "r" if i % 2 == 0 else "l"
        steps.append({"u": f"((({src} + {k}) % {P31}) * 48271) % {P31}"})
        steps.append({"u": f"({xor.format('u', shift.format('u', 13))} * 69621) % {P31}"})
        mixed = xor.format("u", shift.format("u", 11))
        steps.append({"l": f"(l + {mixed}) % {a}"} if i % 2 == 0 else {"r": f"(r + {mixed}) % {b}"})
    return steps


def _pass(df: DataFrame, n: int, a: int, b: int, key: int, first: bool) -> DataFrame:
    """One pass over ``x``; later passes move only what is still outside."""
    df = df.withColumns({"l": F.expr(f"x div {b}L"), "r": F.expr(f"x % {b}L")})
    for step in step_sql(f"{a}L", f"{b}L", key):
        df = df.withColumns({c: F.expr(e) for c, e in step.items()})
    moved = f"l * {b}L + r"
    return df.withColumn("x", F.expr(moved if first else f"CASE WHEN x < {n}L THEN x ELSE {moved} END")).drop("l", "r", "u")


def feistel_shards(docs: DataFrame, id_col: str = "doc_id", shards: int = SHARDS, key: int = KEY, tie_cols: list[str] | None = None) -> DataFrame:
    """``docs`` with ``row_no`` (rank by id), ``place`` (its permuted number), ``shard`` and ``slot``.

    Shard sizes differ by at most one row and slots are gapless from 0. ``(row_no, number of rows, key)`` alone give
    ``place``, so any reader can compute shard and slot of a row number, and the shuffle is reproducible.
    Rows that share an id are ordered by ``tie_cols``; null ids come first. Columns of ``docs`` with the names of the
    results are replaced. An empty table gives an empty result.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    docs = docs.drop("row_no", "place", "shard", "slot")
    own = {f"_own{i}": c for i, c in enumerate(docs.columns)}
    inner = docs.select(*[docs[c].alias(k) for k, c in own.items()])
    back = {c: k for k, c in own.items()}
    numbered = dense_rows(inner, [back[id_col], *[back[c] for c in tie_cols or []]], name="row_no", label="feistel")
    n = numbered.count()
    a, b = sides(n)
    walked = numbered.withColumn("x", F.col("row_no"))
    for i in range(1 + longest_walk(n, key)):
        walked = _pass(walked, n, a, b, key, i == 0)
    return walked.select(*[F.col(k).alias(c) for k, c in own.items()], "row_no", F.col("x").alias("place"),
                         (F.col("x") % shards).cast("int").alias("shard"), F.expr(f"x div {shards}L").alias("slot"))
