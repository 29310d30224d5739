"""Site inventory: which pages a site has, which are templates, which are missing.

A site may hold a third of all rows, so nothing here sorts or collects a whole site in one
task: firsts and top-k go through ``row_number`` limits that Spark also applies before the
shuffle, and group facts come from partial aggregates joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from quiltlens.functions import markup as M, urls as U
from quiltlens.session import materialize

TEMPLATE_MIN_CHILDREN = 3
PAGE_CAP = 40


def normalize_urls(rows: DataFrame) -> DataFrame:
    """``rows(site, url, pos)`` → clean page records; off-site, root and asset rows dropped."""
    path = F.col("path")
    own = U.origin("url")
    return (
        rows.filter((own == "") | (own == F.col("site")))
        .withColumn("path", U.page_path("url"))
        .filter(~U.is_dropped(path))
        .select(
            "site", "pos",
            F.concat("site", "path").alias("url"),
            "path",
            U.slug(path).alias("slug"),
            U.title_from_path(path).alias("title"),
        )
    )


def sitemap_seeds(sites: DataFrame, robots: DataFrame) -> DataFrame:
    """``/sitemap.xml`` of every site plus each ``Sitemap:`` line of its robots text."""
    lines = robots.select("site", F.explode(F.split("body", r"\r?\n")).alias("line"))
    named = lines.filter(F.col("line").rlike("(?i)^sitemap:")).select(
        "site", F.trim(F.regexp_replace("line", "(?i)^sitemap:", "")).alias("url")
    )
    base = sites.select("site", F.concat("site", F.lit("/sitemap.xml")).alias("url"))
    return base.unionByName(named).filter(F.col("url") != "").dropDuplicates(["site", "url"])


def expand_sitemaps(seeds: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """Follow index files from ``seeds(site, url)`` through ``sitemaps(url, body)``.

    One join per nesting level; each (site, sitemap) is visited once. Returns
    ``(site, sitemap, level, pos, url)`` for every listed page.
    """
    parsed = sitemaps.select(
        F.col("url").alias("sitemap"),
        F.col("body").rlike("(?i)<sitemapindex").alias("is_index"),
        M.all_matches(F.col("body"), r"(?is)<loc>\s*([^<]*?)\s*</loc>", 1).alias("locs"),
    )
    frontier = materialize(seeds.select("site", F.col("url").alias("sitemap")), "sitemap-seeds")
    visited = frontier
    found = None
    level = 0
    while not frontier.isEmpty():
        hit = materialize(
            frontier.join(parsed, "sitemap").select(
                "site", "sitemap", F.lit(level).cast("bigint").alias("level"), "is_index", "locs"
            ),
            "sitemap-level",
        )
        found = hit if found is None else found.unionByName(hit)
        children = (
            hit.filter("is_index").select("site", F.explode("locs").alias("sitemap")).filter("sitemap <> ''").distinct()
        )
        frontier = materialize(children.join(visited, ["site", "sitemap"], "left_anti"), "sitemap-frontier")
        visited = visited.unionByName(frontier)
        level += 1
    if found is None:
        found = frontier.join(parsed, "sitemap").select("site", "sitemap", F.lit(0).cast("bigint").alias("level"), "is_index", "locs")
    return (
        found.filter(~F.col("is_index"))
        .select("site", "sitemap", "level", F.posexplode("locs").alias("pos", "url"))
        .withColumn("pos", F.col("pos").cast("bigint"))
    )


def harvest_links(corpus: DataFrame) -> DataFrame:
    """Same-origin links of each page, first occurrence per (site, page, path)."""
    hrefs = M.all_matches(M.visible(F.col("html")), r"""(?is)<a\b[^>]*?\shref\s*=\s*["']([^"']*)["']""", 1)
    usable = lambda h: (h != "") & ~h.rlike("(?i)^(mailto:|tel:|javascript:|#)")
    # resolved before the explode, so later filters read a finished column
    targets = F.transform(hrefs, lambda h: F.when(usable(h), U.resolve(h, F.col("url"))))
    links = corpus.select("site", "page_id", F.posexplode(targets).alias("pos", "target"))
    same = links.filter(U.origin("target") == F.col("site")).withColumn("path", U.page_path("target"))
    # a page's links come from one row, so this group is bounded by one document
    first = W.partitionBy("page_id", "path").orderBy("pos")
    return (
        same.filter(~U.is_dropped(F.col("path")))
        .withColumn("_n", F.row_number().over(first))
        .filter("_n = 1")
        .select("site", "page_id", F.col("pos").cast("bigint").alias("pos"), "path", F.concat("site", "path").alias("url"))
    )


def dedupe_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row per key. Spark limits each map task to one row per key before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def choose_source(sitemap: DataFrame, crawl: DataFrame) -> DataFrame:
    """Sitemap rows, and crawl rows only for sites whose sitemap gave nothing."""
    listed = sitemap.select("site").distinct()
    return sitemap.withColumn("source", F.lit("sitemap")).unionByName(
        crawl.join(listed, "site", "left_anti").withColumn("source", F.lit("crawl"))
    )


def collapse_templates(rows: DataFrame, min_children: int = TEMPLATE_MIN_CHILDREN) -> DataFrame:
    """Mark template children: ``state`` is ``kept`` (plain page or first child) or ``collapsed``.

    Child counts and the first child come from one partial aggregate per parent.
    """
    with_parent = rows.withColumn("parent", U.parent_path(F.col("path")))
    families = (
        with_parent.filter("parent IS NOT NULL")
        .groupBy("site", "parent")
        .agg(F.count("*").alias("_kids"), F.min("pos").alias("_first"))
        .filter(F.col("_kids") >= min_children)
    )
    joined = with_parent.join(families, ["site", "parent"], "left")
    is_template = F.col("_kids").isNotNull()
    return joined.select(
        *rows.columns,
        F.when(is_template, F.concat("parent", F.lit("/*"))).alias("template"),
        (is_template & (F.col("pos") == F.col("_first"))).alias("template_sample"),
        F.when(is_template & (F.col("pos") > F.col("_first")), "collapsed").otherwise("kept").alias("state"),
    )


def cap_pages(rows: DataFrame, n: int = PAGE_CAP) -> DataFrame:
    """Flag the first ``n`` pages per site as kept, the rest as overflow; no row is lost.

    Only the top-n candidates are ranked; the cut-off position is then joined back.
    """
    w = W.partitionBy("site").orderBy("pos")
    cut = (
        rows.select("site", "pos").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n)
        .groupBy("site").agg(F.max("pos").alias("_cut"))
    )
    return rows.join(cut, "site").withColumn("kept", F.col("pos") <= F.col("_cut")).drop("_cut")


def merge_inventory(existing: DataFrame, extras: DataFrame) -> DataFrame:
    """Union by (site, path); an existing row wins over an extra one."""
    fresh = dedupe_first(extras, ["site", "path"], ["pos"]).join(existing, ["site", "path"], "left_anti")
    return existing.select("site", "path", "url", "title").withColumn("origin", F.lit("existing")).unionByName(
        fresh.select("site", "path", "url", "title").withColumn("origin", F.lit("extra"))
    )


# Markers of an empty content list, of a list, of a list item, and of a section.
DYN_EMPTY = "(?i)w-dyn-empty|w-dyn-bind-empty"
DYN_LIST = "(?i)w-dyn-list"
DYN_ITEM = "(?i)w-dyn-item"
LANDMARK = r"(?i)<(?:section|header|footer|main|nav|article)\b"


def is_empty_page(html):
    return (
        html.isNull()
        | ~html.rlike(r"\S")
        | html.rlike(DYN_EMPTY)
        | (html.rlike(DYN_LIST) & ~html.rlike(DYN_ITEM))
        | ~html.rlike(LANDMARK)
    )


def empty_pages(corpus: DataFrame) -> DataFrame:
    return corpus.withColumn("empty", F.coalesce(is_empty_page(F.col("html")), F.lit(True)))


def export_key(path):
    """The inventory path an exported file answers: ``/x.html`` and ``/x/index.html`` → ``/x``."""
    key = F.regexp_replace(F.regexp_replace(path, r"/index\.html$", ""), r"\.html$", "")
    return F.when(key == "", F.lit("/")).otherwise(key)


def missing_pages(inventory: DataFrame, corpus: DataFrame) -> DataFrame:
    """Inventory paths the corpus lacks (``absent``) or holds only as an empty shell (``empty``).

    Where several files answer one path, ``x.html`` is preferred over ``x/index.html``.
    """
    files = dedupe_first(
        corpus.select(
            "site", export_key(F.col("path")).alias("path"),
            F.when(F.col("path").rlike(r"/index\.html$"), 1).otherwise(0).alias("_rank"), "page_id",
            F.coalesce(is_empty_page(F.col("html")), F.lit(True)).alias("_empty"),
        ),
        ["site", "path"], ["_rank", "page_id"],
    )
    joined = inventory.filter(~F.col("path").isin("", "/")).join(files.select("site", "path", "_empty"), ["site", "path"], "left")
    reason = F.when(F.col("_empty").isNull(), "absent").when(F.col("_empty"), "empty")
    return joined.withColumn("reason", reason).filter("reason IS NOT NULL").select("site", "path", "slug", "reason")


def section_gaps(corpus: DataFrame) -> DataFrame:
    """Content sections an export left without copy, with the reason."""
    sections = corpus.select(
        "site", "page_id", "path",
        F.posexplode(M.all_matches(F.col("html"), r"(?is)<section\b[^>]*>.*?</section>")).alias("_i", "markup"),
    )
    markup = F.col("markup")
    word_count = F.size(F.filter(F.split(M.text_of(markup), " "), lambda w: w != ""))
    reason = (
        F.when(markup.rlike(DYN_EMPTY), "w-dyn-empty")
        .when(markup.rlike(DYN_LIST) & ~markup.rlike(DYN_ITEM), "collection-list-without-items")
        .when((word_count < 4) & markup.contains("w-dyn"), "cms-section-without-copy")
    )
    return (
        sections.select("site", "path", (F.col("_i") + 1).cast("bigint").alias("n"), M.attr(markup, "id").alias("section_id"), reason.alias("reason"))
        .filter("reason IS NOT NULL")
    )


def content_gaps(corpus: DataFrame, inventory: DataFrame) -> DataFrame:
    """Empty pages, empty content sections, and listed pages that are absent."""
    blank = F.lit("")
    whole = empty_pages(corpus).filter("empty AND path <> '/'").select(
        "site", "path", F.lit(0).cast("bigint").alias("n"), blank.alias("section_id"), F.lit("empty-page").alias("reason")
    )
    absent = missing_pages(inventory, corpus).filter("reason = 'absent'").select(
        "site", "path", F.lit(0).cast("bigint").alias("n"), blank.alias("section_id"), "reason"
    )
    return section_gaps(corpus).unionByName(whole).unionByName(absent)


# Runtime markers that give away a framework dump, by marker name.
FRAMEWORK_MARKERS = {
    "__NEXT_DATA__": "(?i)__NEXT_DATA__",
    "__NUXT__": "(?i)__NUXT__",
    "__remixContext": "(?i)__remixContext",
    "__SVELTEKIT": "(?i)__SVELTEKIT",
    "__gatsby": "(?i)__gatsby",
    "data-reactroot": "(?i)data-reactroot",
    "id=__next": """(?i)id=["']__next["']""",
    "framerusercontent": r"(?i)framerusercontent\.com/sites",
    "data-framer-": "(?i)data-framer-",
    "empty root": r"""(?i)<div id=["']root["']>\s*</div>""",
    "empty app": r"""(?i)<div id=["']app["']>\s*</div>""",
}
CLEAN_EXPORT = r"""(?i)data-wf-page|data-wf-site|class=["'][^"']*\bw-(?:container|section|nav)\b"""


def classify_sites(corpus: DataFrame) -> DataFrame:
    """Per site: clean static markup or a framework dump, with the markers seen."""
    html = F.coalesce(F.col("html"), F.lit(""))
    facts = corpus.select(
        "site",
        html.rlike(r"\S").alias("_readable"),
        html.rlike(CLEAN_EXPORT).alias("_clean"),
        F.regexp_count(html, F.lit(LANDMARK)).cast("bigint").alias("_landmarks"),
        *[html.rlike(p).alias(f"_m{i}") for i, p in enumerate(FRAMEWORK_MARKERS.values())],
    ).groupBy("site").agg(
        F.bool_or("_readable").alias("readable"),
        F.bool_or("_clean").alias("webflow"),
        F.sum("_landmarks").alias("landmarks"),
        *[F.bool_or(f"_m{i}").alias(f"_m{i}") for i in range(len(FRAMEWORK_MARKERS))],
    )
    marks = F.array_compact(F.array(*[F.when(F.col(f"_m{i}"), F.lit(name)) for i, name in enumerate(FRAMEWORK_MARKERS)]))
    kind = (
        F.when(~F.col("readable"), "framework-dump").when(F.col("markers") != "", "framework-dump")
        .when(F.col("webflow") | (F.col("landmarks") >= 2), "clean-html").otherwise("framework-dump")
    )
    return facts.withColumn("markers", F.array_join(marks, ", ")).select(
        "site", kind.alias("kind"), "markers", "webflow", "landmarks"
    )
