"""Query registry: each entry pairs a Spark query with the SQL that must agree with it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
VIEWS: dict[str, str] = {}
DUCK_VIEWS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def define_view(name: str, sql: str, spark: str | None = None) -> None:
    """A derived input in SQL that both engines read the same way; ``{x}`` names its inputs.

    ``spark`` says the same to Spark where it reads an expression of ``sql`` in other types.
    """
    VIEWS[name] = spark or sql
    if spark:
        DUCK_VIEWS[name] = sql


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    inputs = set(re.findall(r"\{(\w+)\}", sql))
    frames = {i: view(spark, sf_dir, i) if i in VIEWS else table(spark, sf_dir, i) for i in inputs}
    return spark.sql(sql, **frames)


def _text(name: str) -> str:
    return DUCK_VIEWS.get(name) or VIEWS[name]


def _collect(names: list[str], out: list[str]) -> None:
    for n in names:
        if n in out or (n not in VIEWS and n not in DUCK_VIEWS):
            continue
        text = _text(n)
        inner = re.findall(r"\{(\w+)\}", text)
        _collect(inner, out)
        out.append(n)


def duck(sql: str) -> str:
    """Expand ``{view}`` names into leading common table expressions."""
    names: list[str] = []
    _collect(re.findall(r"\{(\w+)\}", sql), names)
    plain = lambda s: re.sub(r"\{(\w+)\}", r"\1", s)
    ctes = ",\n".join(f"{n} AS ({plain(_text(n))})" for n in names)
    body = plain(sql).strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = duck(oracle)
        return fn

    return register
