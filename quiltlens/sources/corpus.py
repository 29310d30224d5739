"""Page corpus reader: raw HTML rows with their site and path."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quiltlens.functions import urls as U
from quiltlens.session import spread


def page_corpus(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` plus ``site`` (scheme and host) and ``path``.

    Narrow on any input with enough splits: no shuffle, and columns nobody asks for are pruned from the scan.
    """
    return spread(pages).select(
        U.origin("url").alias("site"),
        F.col("page_id"),
        F.col("url"),
        U.page_path("url").alias("path"),
        F.col("html"),
    )
