"""Which texts contain which.

In groups of few pairs for their rows each text meets each other and is looked at; in all others an index on character
grams is asked for each text's rarest gram, so that no large group costs its square. Both ways are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quiltlens.session import materialize

GRAM = 3
PAIRS_PER_TEXT = 128  # a group with no more pairs than this for each of its texts is compared whole


def _grams(text: Column, n: int) -> Column:
    last = F.length(text) - n + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda s: F.substr(text, s, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def _index(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, text, gram``: the grams of one to three characters of each text, as many as it is long, not one a substring."""
    return materialize(texts.select(*keys, "text", F.explode(F.concat(*[_grams(F.col("text"), n) for n in range(1, GRAM + 1)])).alias("gram")), "grams")


def _rarest(short: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, short, gram``: the gram of each text that the fewest texts of the index have; texts with a gram that none has are left out."""
    rows = short.select(*keys, F.col("text").alias("short"), _grams(F.col("text"), GRAM).alias("_all"))
    rows = rows.withColumn("_all", F.when(F.size("_all") > 0, F.col("_all")).otherwise(F.array("short")))
    counts = index.groupBy(*keys, "gram").agg(F.count("*").alias("_n"))
    asked = rows.select(*keys, "short", F.size("_all").alias("_size"), F.explode("_all").alias("gram")).join(counts.hint("merge"), [*keys, "gram"])
    return asked.groupBy(*keys, "short").agg(F.count("*").alias("_met"), F.min("_size").alias("_size"), F.min_by("gram", F.struct("_n", "gram")).alias("gram")).filter("_met = _size").drop("_met", "_size")


def _by_text(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.filter("text <> ''").groupBy(*keys, "text").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))


def _prepared(texts: DataFrame, rows: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    return materialize(_by_text(rows, keys, value), "containment"), materialize(texts.filter("text <> ''").select(*keys, "text").distinct(), "containment-asked")


def _split(asked: DataFrame, held: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(pairs, asked, held)``: all pairs of the groups that are compared whole, and the texts of the other groups."""
    n, m = asked.groupBy(*keys).agg(F.count("*").alias("_n")), held.groupBy(*keys).agg(F.count("*").alias("_m"))
    few = F.col("_n") * F.col("_m") <= PAIRS_PER_TEXT * (F.col("_n") + F.col("_m"))
    groups = materialize(n.join(m.hint("merge"), keys).select(*keys, few.alias("_few")), "containment-groups")
    many = groups.filter("NOT _few").drop("_few")
    # merge joins: a file of texts that repeat from group to group is far smaller than its rows, too small a measure for a broadcast
    mine = held.join(groups.filter("_few").drop("_few").hint("merge"), keys, "left_semi")
    pairs = asked.withColumnRenamed("text", "_asked").join(mine.hint("merge"), keys)
    return pairs, asked.join(many.hint("merge"), keys, "left_semi"), held.join(many.hint("merge"), keys, "left_semi")


def _ends(met: DataFrame, keys: list[str], text: str) -> DataFrame:
    return met.groupBy(*keys, F.col(text).alias("text")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _around(asked: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """By the index: a text of up to three characters is a gram itself, so least and greatest are taken per gram before the join;
    a longer one meets only the texts that have its rarest gram."""
    index = _index(held, keys)
    small = asked.filter(F.length("text") <= GRAM)
    per_gram = index.join(held.hint("merge"), [*keys, "text"]).groupBy(*keys, "gram").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    direct = small.join(per_gram.withColumnRenamed("gram", "text").hint("merge"), [*keys, "text"])
    rare = _rarest(asked.filter(F.length("text") > GRAM), index, keys)
    met = rare.join(index.hint("merge"), [*keys, "gram"]).filter(F.col("text").contains(F.col("short"))).select(*keys, "short", "text")
    longer = _ends(met.join(held.hint("merge"), [*keys, "text"]), keys, "short")
    return direct.select(*keys, "text", "lo", "hi").unionByName(longer)


def _within(asked: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    index = _index(asked, keys)
    met = _rarest(held, index, keys).join(index.hint("merge"), [*keys, "gram"]).filter(F.col("text").contains(F.col("short"))).select(*keys, "short", "text")
    return _ends(met.join(held.withColumnRenamed("text", "short").hint("merge"), [*keys, "short"]), keys, "text")


def around(texts: DataFrame, rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, text, lo, hi``: for each of ``texts(keys, text)`` the least and greatest ``value`` of ``rows(keys, text, value)`` whose text contains it.

    Rows are reduced to their texts first.
    """
    held, asked = _prepared(texts, rows, keys, value)
    pairs, asked, held = _split(asked, held, keys)
    near = _ends(pairs.filter(F.col("text").contains(F.col("_asked"))), keys, "_asked")
    held = materialize(held, "containment-large")
    return near if held.isEmpty() else near.unionByName(_around(asked, held, keys))


def within(texts: DataFrame, rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, text, lo, hi``: for each of ``texts(keys, text)`` the least and greatest ``value`` of ``rows(keys, text, value)`` whose text it contains."""
    held, asked = _prepared(texts, rows, keys, value)
    pairs, asked, held = _split(asked, held, keys)
    near = _ends(pairs.filter(F.col("_asked").contains(F.col("text"))), keys, "_asked")
    asked = materialize(asked, "containment-large")
    return near if asked.isEmpty() else near.unionByName(_within(asked, held, keys))


def either(texts: DataFrame, rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, text, lo, hi`` over ``around`` and ``within``: texts are prepared and pairs are looked at once for both."""
    held, asked = _prepared(texts, rows, keys, value)
    pairs, asked, held = _split(asked, held, keys)
    near = _ends(pairs.filter(F.col("text").contains(F.col("_asked")) | F.col("_asked").contains(F.col("text"))), keys, "_asked")
    held, asked = materialize(held, "containment-large"), materialize(asked, "containment-asked-large")
    if held.isEmpty() or asked.isEmpty():
        return near
    both = _around(asked, held, keys).unionByName(_within(asked, held, keys))
    return near.unionByName(both.groupBy(*keys, "text").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
