"""Page metadata: extraction, merge, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quiltlens.functions import markup as M

FIELDS = ["lang", "title", "description", "og_image", "canonical"]


def _some(value: Column) -> Column:
    trimmed = F.trim(value)
    return F.when(trimmed != "", trimmed)


def _meta(html: Column, key: str, name: str) -> Column:
    """Content of the first meta element whose ``key`` attribute is ``name``."""
    tag = F.regexp_extract(html, rf"""(?is)<meta\b[^>]*\s{key}\s*=\s*["']{name}["'][^>]*>""", 0)
    return _some(M.attr(tag, "content"))


def page_meta(corpus: DataFrame) -> DataFrame:
    html = F.col("html")
    lang = _some(M.attr(F.regexp_extract(html, r"(?is)<html\b[^>]*>", 0), "lang"))
    title = _some(M.squeeze(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    link = F.regexp_extract(html, r"""(?is)<link\b[^>]*\srel\s*=\s*["'][^"']*\bcanonical\b[^>]*>""", 0)
    return corpus.select(
        "site", "page_id", "url", "path",
        lang.alias("lang"),
        F.coalesce(title, _meta(html, "property", "og:title")).alias("title"),
        F.coalesce(_meta(html, "name", "description"), _meta(html, "property", "og:description")).alias("description"),
        _meta(html, "property", "og:image").alias("og_image"),
        _some(M.attr(link, "href")).alias("canonical"),
    )


def merge_meta(saved: DataFrame, live: DataFrame, sites: DataFrame) -> DataFrame:
    """Live non-empty values win over saved ones; canonical falls back to the page's URL, lang to the site's.

    ``sites(site, lang)`` gives only the language: home-page titles never reach other pages.
    """
    s, v = saved.alias("s"), live.alias("v")
    both = s.join(v, ["site", "page_id"], "full_outer").select(
        "site", "page_id", F.coalesce("v.url", "s.url").alias("url"),
        *[F.coalesce(f"v.{f}", f"s.{f}").alias(f) for f in FIELDS],
    )
    named = both.join(sites.select("site", F.col("lang").alias("_site_lang")), "site", "left")
    return named.select(
        "site", "page_id", F.coalesce("lang", "_site_lang").alias("lang"), "title", "description", "og_image",
        F.coalesce("canonical", "url").alias("canonical"),
    )


def meta_gaps(meta: DataFrame) -> DataFrame:
    """Missing title, description or image per page, and one total row per site (``page_id`` null)."""
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("title", "description", "og_image")])), ",")
    pages = meta.select("site", "page_id", missing.alias("missing"))
    totals = pages.groupBy("site").agg(
        F.lit(None).cast("bigint").alias("page_id"),
        F.concat_ws("/", F.count_if(F.col("missing") != "").cast("string"), F.count("*").cast("string")).alias("missing"),
    )
    return pages.filter("missing <> ''").unionByName(totals)
