"""Link graph: routes, link resolution, rewrite plans, link audits.

The same reference repeats on most pages of a site, so resolution runs over distinct
(site, reference) pairs and is joined back to the links once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quiltlens.functions import markup as M, urls as U
from quiltlens.operators.inventory import dedupe_first

REGIONS = r"(?is)<header\b.*?</header\s*>|<footer\b.*?</footer\s*>|<nav\b.*?</nav\s*>"
LOGO = r"""(?i)class=["'][^'"]*\b(logo|brand|site-logo|wordmark)\b"""
LABEL_LIMIT = 60
HOME = "/"


def page_links(corpus: DataFrame) -> DataFrame:
    """Every ``<a href>`` with its region (header, footer, nav or body), label and opening tag."""
    once = lambda c: F.explode(F.array(c))  # noqa: E731  a one-row generator: what follows reads the finished column
    html = F.col("html")
    corpus = corpus.select("site", "page_id", once(M.visible(html)).alias("html"))
    outside = F.struct(F.lit("body").alias("region"), F.regexp_replace(html, REGIONS, " ").alias("markup"))
    inside = F.transform(M.all_matches(html, REGIONS), lambda m: F.struct(M.tag_name(m).alias("region"), m.alias("markup")))
    blocks = corpus.select("site", "page_id", F.posexplode(F.concat(inside, F.array(outside))).alias("_b", "block"))
    links = blocks.select(
        "site", "page_id", "_b", F.col("block.region").alias("region"),
        F.posexplode(M.all_matches(F.col("block.markup"), M.LINK)).alias("_i", "element"),
    )
    el, tag = F.col("element"), F.col("tag")
    links = links.select("site", "page_id", "region", "_b", "_i", "element", once(M.open_tag(el)).alias("tag"))
    return links.filter(tag.rlike(r"""(?is)\shref\s*=\s*["']""")).select(
        "site", "page_id", "region",
        (F.col("_b").cast("bigint") * F.lit(10_000_000_000) + F.col("_i")).alias("pos"),
        F.trim(F.regexp_extract(tag, M.attr_pattern("href"), 1)).alias("href"),
        M.label_of(M.inner(el)).alias("label"),
        "tag",
    )


def route_of(slug: Column) -> Column:
    clean = F.lower(F.regexp_replace(F.trim(slug), "^/+|/+$", ""))
    return F.when(clean.isin("", "home", "index"), F.lit(HOME)).otherwise(F.concat(F.lit("/"), clean, F.lit("/")))


def route_map(inventory: DataFrame) -> DataFrame:
    """``inventory(site, pos, path, slug, title, template)`` → lookup rows ``(site, kind, alias, route, ord)``.

    ``exact`` aliases are slug, path and name (a later page overrides an earlier one);
    ``template`` aliases keep their first page; ``stripped`` lists exact aliases without slashes.
    """
    pages = inventory.filter((F.col("slug") != "") & (F.col("slug") != "home")).withColumn("route", route_of(F.col("slug")))
    path_alias = F.lower(F.regexp_replace("path", "/+$", ""))
    named = pages.select(
        "site", "pos", "route",
        F.posexplode(F.array(F.lower("slug"), path_alias, F.lower(F.trim("title")))).alias("_k", "alias"),
    ).filter("alias <> ''")
    last = dedupe_first(
        named.withColumn("_p", -F.col("pos")).withColumn("_q", -F.col("_k")), ["site", "alias"], ["_p", "_q"]
    ).select("site", "alias", "route", "pos")
    fixed = inventory.select("site").distinct().select(
        "site", F.explode(F.array(*[F.lit(a) for a in ("", "/", "home", "index")])).alias("alias"),
        F.lit(HOME).alias("route"), F.lit(-1).cast("bigint").alias("pos"),
    )
    exact = dedupe_first(fixed.unionByName(last).withColumn("_p", -F.col("pos")), ["site", "alias"], ["_p"]).drop("_p")
    template = dedupe_first(
        pages.filter("template IS NOT NULL").select("site", F.lower("template").alias("alias"), "route", "pos"),
        ["site", "alias"], ["pos"],
    )
    stripped = exact.select("site", F.regexp_replace("alias", "^/+|/+$", "").alias("alias")).distinct().select(
        "site", "alias", F.lit(None).cast("string").alias("route"), F.lit(0).cast("bigint").alias("pos")
    )
    out = None
    for kind, rows in (("exact", exact), ("template", template), ("stripped", stripped)):
        part = rows.select("site", F.lit(kind).alias("kind"), "alias", "route", F.col("pos").alias("ord"))
        out = part if out is None else out.unionByName(part)
    return out


def _norm_path(path: Column) -> Column:
    """``./about``, ``../about/`` and ``about.html`` all become ``/about``; index files become their folder."""
    bare = F.regexp_replace(path, r"^(\.{1,2}/)+", "")
    bare = F.when(bare.isin(".", ".."), "").otherwise(bare)
    file = F.regexp_replace(F.regexp_replace(bare, r"\.html$", ""), "(^|/)index$", "$1")
    bare = F.when(bare.endswith(".html"), file).otherwise(bare)
    return F.concat(F.lit("/"), F.regexp_replace(bare, "^/+|/+$", ""))


def resolve_hrefs(links: DataFrame, routes: DataFrame) -> DataFrame:
    """Destination per distinct ``(site, href)``: a route, ``#`` for off-site, null when unknown.

    Each reference explodes into its ordered candidate keys, one hash join looks all of
    them up, and the best rank wins. Template prefixes become equality keys: every
    ancestor folder of the reference is a candidate.
    """
    raw = F.col("href")
    refs = links.select("site", "href").distinct()
    placeholder = (raw == "") | raw.startswith("#")
    external = raw.rlike("^(mailto:|tel:|javascript:|https://|http://)")
    path = U.raw_path(raw)
    fragment = raw.contains("#")
    pathy = raw.rlike(r"^[./]") | raw.contains("/") | raw.endswith(".html")
    staged = refs.select(
        "site", "href", placeholder.alias("_ph"), external.alias("_ext"), pathy.alias("_pathy"),
        F.lower(_norm_path(path)).alias("_key"),
        F.lower(F.regexp_replace(path, "/+$", "")).alias("_key2"),
        ((path.isin("", "/")) & ~fragment).alias("_rooted"),
        (raw.startswith("/") & raw.endswith("/")).alias("_routed"),
    )
    key, key2 = F.col("_key"), F.col("_key2")
    direct = (
        F.when(F.col("_ph"), F.lit(None).cast("string")).when(F.col("_ext"), "#")
        .when(raw == "/", HOME).when(F.col("_pathy") & (key == "/"), HOME)
    )
    settled = F.col("_ph") | F.col("_ext") | (raw == "/") | (F.col("_pathy") & (key == "/"))
    bare = F.regexp_replace(key, "^/+|/+$", "")
    parts = F.split(bare, "/")
    ancestors = F.transform(
        F.when(F.size(parts) >= 2, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"), F.lit("/*")),
    )
    last = F.regexp_replace(F.element_at(F.split(key2, "/"), -1), r"\.html$", "")

    def cand(on: Column, rank: int, kind: str, alias: Column) -> Column:
        return F.when(on, F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), alias.alias("alias")))

    singles = F.array_compact(F.array(
        cand(F.col("_routed"), 0, "stripped", bare),
        cand(F.col("_pathy"), 1, "exact", key),
        cand(F.col("_pathy"), 2, "exact", bare),
        cand(F.lit(True), 5, "exact", key2),
        cand(F.lit(True), 6, "exact", last),
    ))
    prefixes = F.transform(
        F.when(F.col("_pathy"), ancestors).otherwise(F.array().cast("array<string>")),
        lambda a: F.struct(F.lit(3).alias("rank"), F.lit("template").alias("kind"), a.alias("alias")),
    )
    open_refs = staged.filter(~settled)
    hits = (
        open_refs.select("site", "href", "_rooted", F.explode(F.concat(singles, prefixes)).alias("c"))
        .select("site", "href", "_rooted", "c.rank", "c.kind", "c.alias")
        .join(routes, ["site", "kind", "alias"], "left")
        .withColumn("_hit", F.col("ord").isNotNull())
    )
    best = hits.groupBy("site", "href").agg(
        F.min_by(F.struct("rank", "route"), F.when(F.col("_hit"), F.struct("rank", "ord"))).alias("_b"),
        F.bool_or("_rooted").alias("_rooted"),
    )
    chosen = (
        F.when(F.col("_b.rank") <= 3, F.col("_b.route")).when(F.col("_rooted"), HOME).otherwise(F.col("_b.route"))
    )
    return staged.filter(settled).select("site", "href", direct.alias("dest")).unionByName(
        best.select("site", "href", chosen.alias("dest"))
    )


def with_dest(links: DataFrame, resolved: DataFrame) -> DataFrame:
    return links.join(resolved, ["site", "href"], "left")


def label_routes(links: DataFrame, resolved: DataFrame) -> DataFrame:
    """Labels of at most 60 characters that lead to exactly one internal route."""
    said = links.filter((F.col("label") != "") & (F.length("label") <= LABEL_LIMIT)).select("site", "label", "href").distinct()
    told = said.join(resolved.filter(F.col("dest").isNotNull() & (F.col("dest") != "#")), ["site", "href"])
    return (
        told.groupBy("site", "label").agg(F.min("dest").alias("route"), F.max("dest").alias("_other"))
        .filter(F.col("route") == F.col("_other")).drop("_other")
    )


def is_placeholder(href: Column) -> Column:
    return (href == "") | href.startswith("#")


def href_rewrites(links: DataFrame, resolved: DataFrame, routes: DataFrame, labels: DataFrame) -> DataFrame:
    """Per link the planned new reference, with the rule that chose it; unchanged links are left out."""
    names = routes.filter("kind = 'exact'").select("site", F.col("alias").alias("label"), F.col("route").alias("_name_route"))
    joined = (
        with_dest(links, resolved)
        .join(labels.withColumnRenamed("route", "_label_route"), ["site", "label"], "left")
        .join(names.filter("label <> ''"), ["site", "label"], "left")
    )
    held = is_placeholder(F.col("href"))
    empty = F.col("href").isin("", "#")
    by_label = F.when(held, F.col("_label_route"))
    by_logo = F.when(held & F.col("tag").rlike(LOGO), F.lit(HOME))
    by_name = F.when(empty & F.col("label").isin("home", "homepage"), F.lit(HOME)).when(empty, F.col("_name_route"))
    rule = (
        F.when(F.col("dest").isNotNull(), "route").when(by_label.isNotNull(), "label")
        .when(by_logo.isNotNull(), "logo").when(by_name.isNotNull(), "name")
    )
    return (
        joined.withColumn("rule", rule).withColumn("new_href", F.coalesce("dest", by_label, by_logo, by_name))
        .filter(F.col("new_href").isNotNull() & (F.col("new_href") != F.col("href")))
        .select("site", "page_id", "region", "pos", "href", "new_href", "rule")
    )


def chrome(links: DataFrame) -> DataFrame:
    return links.filter(F.col("region").isin("header", "footer", "nav"))


def _with_slash(href: Column) -> Column:
    return F.when(href.endswith("/"), href).otherwise(F.concat(href, F.lit("/")))


def link_audit(links: DataFrame, labels: DataFrame, wanted: DataFrame) -> DataFrame:
    """``dead`` chrome links (placeholder, yet the label has a route) and ``unreachable`` routes of ``wanted(site, route)``."""
    bars = chrome(links)
    dead = (
        bars.filter(is_placeholder(F.col("href"))).select("site", "label", "href").distinct()
        .join(labels, ["site", "label"])
        .select("site", F.lit("dead").alias("kind"), F.col("label").alias("subject"), "route")
        .distinct()
    )
    linked = bars.filter(F.col("href").startswith("/")).select("site", _with_slash(F.col("href")).alias("route")).distinct()
    lost = wanted.distinct().join(linked, ["site", "route"], "left_anti").select(
        "site", F.lit("unreachable").alias("kind"), F.col("route").alias("subject"), "route"
    )
    return dead.unionByName(lost)


def chrome_link_score(links: DataFrame, labels: DataFrame, known_paths: DataFrame) -> DataFrame:
    """Per page: live, dead and broken links in its chrome. ``known_paths(site, path)`` are the built pages."""
    bars = chrome(links).filter(~F.col("href").rlike("(?i)^(https?:|mailto:|tel:|//)"))
    path = F.regexp_replace(F.regexp_replace("href", "[#?].*$", ""), "/+$", "")
    bars = bars.withColumn("path", F.when(path == "", "/").otherwise(path))
    joined = (
        bars.join(known_paths.select("site", "path").distinct().withColumn("_known", F.lit(True)), ["site", "path"], "left")
        .join(labels.select("site", "label").withColumn("_routed", F.lit(True)), ["site", "label"], "left")
    )
    held = is_placeholder(F.col("href"))
    return joined.groupBy("site", "page_id").agg(
        F.count_if(~held & F.col("_known").isNotNull()).alias("live"),
        F.count_if(held & F.col("_routed").isNotNull()).alias("dead"),
        F.count_if(~held & F.col("_known").isNull()).alias("broken"),
    )


def leftover_file_hrefs(corpus: DataFrame) -> DataFrame:
    """References that still end in ``.html``, with their canonical route."""
    hits = corpus.select(
        "site", "page_id",
        F.posexplode(M.all_matches(F.col("html"), r"""(?i)\b(?:href|src|action)\s*=\s*["']([^'"]+\.html(?:#[^'"]*)?)["']""", 1)).alias("pos", "href"),
    )
    page = r"(?i)^[./]*([A-Za-z0-9_-]+)\.html(?:#(.*))?$"
    slug = F.lower(F.regexp_extract("href", page, 1))
    frag = F.regexp_extract("href", page, 2)
    base = F.when(slug.isin("index", "home"), F.lit("/")).otherwise(F.concat(F.lit("/"), slug, F.lit("/")))
    route = F.when(~F.col("href").rlike(page), F.col("href")).when(frag != "", F.concat(base, F.lit("#"), frag)).otherwise(base)
    return hits.select("site", "page_id", F.col("pos").cast("bigint").alias("pos"), "href", route.alias("route"))
