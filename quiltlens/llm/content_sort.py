"""Exact dedup by content sort (native)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from quiltlens.llm.rows import partitions
from quiltlens.session import materialize

SALTS = 64
LEAD = 48


def content_sort_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None,
                       keep: str = "min", salts: int = SALTS) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Sampled splitters range-partition the normalised text by its first characters and, where those agree, by a
    fingerprint, so that the sample the driver sees has short keys; the partitions are sorted externally by these and
    the whole text, so equal texts are adjacent, and the window compares whole neighbouring texts. A text with more rows than a
    quarter of a partition's fair share is hot: its rows are first spread over ``salts`` sub-ranges, which are
    adjacent ranges too; their heads (at most ``salts`` per hot text, and at most four hot texts per partition) are
    compared as whole texts afterwards. Only narrow columns leave the sort.

    Nulls count as empty text. Rows with a null id take part, but represent a group only if all its ids are null.
    Of rows with the same text and id exactly one is kept. An empty table gives an empty result; other columns are ignored.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is min or max")
    spark = docs.sparkSession
    n = partitions(spark)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    base = docs.select(docs[id_col].alias("id"), (normalise(text) if normalise else text).alias("body")).withColumn("print", F.xxhash64("body"))
    fair = max(1, base.count() // (4 * n))
    hot = base.groupBy("print").count().filter(F.col("count") > fair).select("print", F.lit(True).alias("hot"))  # fewer than 4 n rows
    salted = base.join(F.broadcast(hot), "print", "left").select(
        "id", "body", F.substring("body", 1, LEAD).alias("lead"), "print", F.coalesce("hot", F.lit(False)).alias("hot"),
        F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(salts))).otherwise(0).cast("int").alias("salt"))
    best = {"min": F.min, "max": F.max}[keep]
    first = F.col("id").asc_nulls_last() if keep == "min" else F.col("id").desc_nulls_last()
    same = Window.partitionBy("lead", "print", "body", "salt")
    runs = salted.repartitionByRange(n, "lead", "print", "salt").select(
        "id", "body", "hot", best("id").over(same).alias("head"), F.count("*").over(same).alias("run"), F.row_number().over(same.orderBy(first)).alias("at"))
    runs = materialize(runs.select(
        "id", "hot", "head", "run", "at", F.sha2("body", 256).alias("text_sha256"), F.when(F.col("hot") & (F.col("at") == 1), F.col("body")).alias("hot_body")), "content-sort")
    whole = Window.partitionBy("hot_body")
    heads = runs.filter("hot_body IS NOT NULL").select(
        F.col("text_sha256").alias("sha"), F.col("head").alias("part_head"), best("head").over(whole).alias("all_head"), F.sum("run").over(whole).alias("all_run"),
        F.row_number().over(whole.orderBy(F.col("head").asc_nulls_last() if keep == "min" else F.col("head").desc_nulls_last())).alias("part_at"))
    r, h = runs, heads
    joined = r.join(h, r["hot"] & (r["text_sha256"] == h["sha"]) & r["head"].eqNullSafe(h["part_head"]), "left")
    return joined.select(
        r["id"].alias(id_col), F.coalesce(h["all_head"], r["head"]).alias("keep_id"), F.coalesce(h["all_run"], r["run"]).alias("group_size"),
        ((r["at"] == 1) & (F.coalesce(h["part_at"], F.lit(1)) == 1)).alias("kept"), r["text_sha256"])
