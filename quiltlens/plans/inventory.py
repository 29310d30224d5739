"""Registered inventory queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiltlens.functions import urls as U
from quiltlens.operators import inventory as I
from quiltlens.plans.registry import DUCK_VIEWS, define_view, query, table, view
from quiltlens.sources.corpus import page_corpus

# page rows as both engines see them
define_view("corpus_keys", r"""
SELECT site, page_id, url, CASE WHEN p = '' THEN '/' ELSE p END AS path FROM (
  SELECT regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) AS site, page_id, url,
         regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS p
  FROM {pages}) t
""")
# every page twice under another reading, to give duplicates, assets, off-site rows and roots
define_view("url_rows", r"""
SELECT site, url, page_id * 4 AS pos FROM {corpus_keys}
UNION ALL SELECT site, site || path || '/' AS url, page_id * 4 + 1 AS pos FROM {corpus_keys} WHERE page_id % 2 = 0
UNION ALL SELECT site, site || '/files/logo-' || CAST(page_id AS STRING) || '.png' AS url, page_id * 4 + 2 AS pos FROM {corpus_keys} WHERE page_id % 3 = 0
UNION ALL SELECT site, CASE WHEN page_id % 2 = 0 THEN 'https://elsewhere.example' || path ELSE site || '/' END AS url, page_id * 4 + 3 AS pos FROM {corpus_keys} WHERE page_id % 5 = 0
""")

NORMALIZED = r"""
SELECT site, pos, site || path AS url, path,
       CASE WHEN slug = '' THEN 'page' ELSE slug END AS slug,
       array_to_string(list_transform(list_filter(string_split(path, '/'), lambda p: p <> ''),
         lambda p: array_to_string(list_transform(string_split(regexp_replace(p, '[-_]', ' ', 'g'), ' '),
           lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')), ' / ') AS title
FROM (
  SELECT site, pos, path, regexp_replace(regexp_replace(lower(array_to_string(list_filter(string_split(path, '/'), lambda p: p <> ''), '-')), '[^a-z0-9-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug
  FROM (
    SELECT site, pos, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) AS own,
           CASE WHEN p = '' THEN '/' ELSE p END AS path
    FROM (SELECT *, regexp_replace(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)', 1), '/+$', '') AS p FROM {url_rows}) a
  ) b
  WHERE (own = '' OR own = site) AND path <> '/'
    AND NOT regexp_matches(path, '(?i)^(/cdn-cgi|/404|/not-found)')
    AND NOT regexp_matches(path, '(?i)[^/]\.(png|jpg|jpeg|gif|webp|svg|ico|pdf|woff|woff2|ttf|css|js|map|xml|json|mp4|webm|zip)$')
) c
"""
DUCK_VIEWS["normalized"] = NORMALIZED
DUCK_VIEWS["deduped"] = "SELECT * FROM {normalized} QUALIFY row_number() OVER (PARTITION BY site, path ORDER BY pos) = 1"
DUCK_VIEWS["templated"] = r"""
SELECT site, pos, url, path, slug, title, CASE WHEN kids >= 3 THEN parent || '/*' END AS template,
       coalesce(kids >= 3 AND pos = first_pos, false) AS template_sample,
       CASE WHEN kids >= 3 AND pos > first_pos THEN 'collapsed' ELSE 'kept' END AS state
FROM (
  SELECT *, CASE WHEN parent IS NOT NULL THEN count(*) OVER (PARTITION BY site, parent) END AS kids,
         min(pos) OVER (PARTITION BY site, parent) AS first_pos
  FROM (SELECT *, CASE WHEN len(list_filter(string_split(path, '/'), lambda p: p <> '')) >= 2
                       THEN regexp_replace(path, '/+[^/]+$', '') END AS parent FROM {deduped}) a) b
"""


def normalized(spark, d):
    return I.normalize_urls(view(spark, d, "url_rows"))


def deduped(spark, d):
    return I.dedupe_first(normalized(spark, d), ["site", "path"], ["pos"])


def corpus(spark, d):
    return page_corpus(table(spark, d, "pages"))


@query("page_corpus", r"""
SELECT k.site, k.page_id, k.url, k.path, CAST(length(p.html) AS BIGINT) AS html_chars
FROM {corpus_keys} k JOIN pages p USING (page_id)""")
def _(spark, d):
    return corpus(spark, d).withColumn("html_chars", F.length("html").cast("bigint")).drop("html")


@query("normalize_urls", "SELECT * FROM {normalized}")
def _(spark, d):
    return normalized(spark, d)


@query("dedupe_first", "SELECT * FROM {deduped}")
def _(spark, d):
    return deduped(spark, d)


@query("collapse_templates", "SELECT * FROM {templated}")
def _(spark, d):
    return I.collapse_templates(deduped(spark, d))


@query("cap_pages", """
SELECT site, path, row_number() OVER (PARTITION BY site ORDER BY pos) <= 5 AS kept FROM {deduped}""")
def _(spark, d):
    return I.cap_pages(deduped(spark, d), 5).select("site", "path", "kept")


@query("template_inventory", """
SELECT site, path, title, template, template_sample,
       CASE WHEN state = 'collapsed' THEN 'collapsed'
            WHEN row_number() OVER (PARTITION BY site, state ORDER BY pos) <= 40 THEN 'kept' ELSE 'overflow' END AS state
FROM {templated}""")
def _(spark, d):
    marked = I.collapse_templates(deduped(spark, d))
    kept = I.cap_pages(marked.filter("state = 'kept'"))
    kept = kept.withColumn("state", F.when(F.col("kept"), "kept").otherwise("overflow"))
    cols = ["site", "path", "title", "template", "template_sample", "state"]
    return kept.select(*cols).unionByName(marked.filter("state = 'collapsed'").select(*cols))


# sitemaps: page lists of at most 16, index files of at most 4 lists, named by robots lines
SITEMAPS = r"""
SELECT site || '/list-' || CAST(CAST(floor(page_id / 16) AS BIGINT) AS STRING) || '.xml' AS url,
       '<urlset>' || {agg1} || '</urlset>' AS body
FROM {corpus_keys} GROUP BY site, CAST(floor(page_id / 16) AS BIGINT)
UNION ALL
SELECT site || '/index-' || CAST(CAST(floor(k / 4) AS BIGINT) AS STRING) || '.xml',
       '<sitemapindex>' || {agg2} || '</sitemapindex>'
FROM (SELECT DISTINCT site, CAST(floor(page_id / 16) AS BIGINT) AS k FROM {corpus_keys}) t
GROUP BY site, CAST(floor(k / 4) AS BIGINT)
"""
_LOC1 = "'<url><loc> ' || url || '</loc></url>'"
_LOC2 = "'<sitemap><loc>' || site || '/list-' || CAST(k AS STRING) || '.xml</loc></sitemap>'"
define_view("sitemaps", SITEMAPS.replace("{agg1}", f"string_agg({_LOC1}, '') WITHIN GROUP (ORDER BY page_id)").replace("{agg2}", f"string_agg({_LOC2}, '') WITHIN GROUP (ORDER BY k)"))
DUCK_VIEWS["sitemaps"] = SITEMAPS.replace("{agg1}", f"string_agg({_LOC1}, '' ORDER BY page_id)").replace("{agg2}", f"string_agg({_LOC2}, '' ORDER BY k)")
define_view("robots", r"""
SELECT DISTINCT site, 'User-agent: *' || chr(10) || 'Sitemap: ' || site || '/index-' || CAST(CAST(floor(page_id / 64) AS BIGINT) AS STRING) || '.xml' AS body FROM {corpus_keys}
""")

DUCK_VIEWS["listed"] = r"""
SELECT site, sitemap, level, CAST(unnest(range(0, len(locs))) AS BIGINT) AS pos, unnest(locs) AS url FROM (
  SELECT r.site, r.sitemap, r.level, regexp_extract_all(s.body, '(?is)<loc>\s*([^<]*?)\s*</loc>', 1) AS locs
  FROM (SELECT site, sitemap, min(level) AS level FROM sitemap_reach GROUP BY ALL) r JOIN {sitemaps} s ON s.url = r.sitemap
  WHERE NOT regexp_matches(s.body, '(?i)<sitemapindex')) t
"""
REACH = r"""WITH RECURSIVE sitemap_reach AS (
  SELECT site, url AS sitemap, CAST(0 AS BIGINT) AS level FROM (
    SELECT DISTINCT site, site || '/sitemap.xml' AS url FROM {corpus_keys}
    UNION SELECT site, trim(substr(line, 9)) FROM (SELECT site, unnest(string_split(body, chr(10))) AS line FROM {robots}) x WHERE lower(line) LIKE 'sitemap:%') s
  UNION
  SELECT r.site, unnest(regexp_extract_all(s.body, '(?is)<loc>\s*([^<]*?)\s*</loc>', 1)) AS sitemap, r.level + 1 AS level
  FROM sitemap_reach r JOIN {sitemaps} s ON s.url = r.sitemap WHERE regexp_matches(s.body, '(?i)<sitemapindex'))
"""
del DUCK_VIEWS["listed"]
LISTED = r"""
SELECT site, sitemap, level, CAST(unnest(range(0, len(locs))) AS BIGINT) AS pos, unnest(locs) AS url FROM (
  SELECT r.site, r.sitemap, r.level, regexp_extract_all(s.body, '(?is)<loc>\s*([^<]*?)\s*</loc>', 1) AS locs
  FROM (SELECT site, sitemap, min(level) AS level FROM sitemap_reach GROUP BY ALL) r JOIN {sitemaps} s ON s.url = r.sitemap
  WHERE NOT regexp_matches(s.body, '(?i)<sitemapindex')) t"""


def listed(spark, d):
    keys = view(spark, d, "corpus_keys")
    seeds = I.sitemap_seeds(keys.select("site").distinct(), view(spark, d, "robots"))
    return I.expand_sitemaps(seeds, view(spark, d, "sitemaps"))


@query("expand_sitemaps", REACH + LISTED)
def _(spark, d):
    return listed(spark, d)


LINKS = r"""
SELECT site, page_id, pos, path, site || path AS url FROM (
  SELECT site, page_id, pos, CASE WHEN p = '' THEN '/' ELSE p END AS path FROM (
    SELECT *, regexp_replace(regexp_extract(target, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS p FROM (
      SELECT site, page_id, pos, CASE WHEN href LIKE '/%' THEN site || regexp_replace(trim(href), '#.*$', '') ELSE trim(href) END AS target FROM (
        SELECT k.site, k.page_id, unnest(hs) AS href, CAST(unnest(range(0, len(hs))) AS BIGINT) AS pos
        FROM (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<!--.*?-->', ' ', 'g'),
               '(?is)<a\b[^>]*?\shref\s*=\s*["'']([^"'']*)["'']', 1) AS hs FROM pages) h JOIN {corpus_keys} k USING (page_id)) a
      WHERE href <> '' AND NOT regexp_matches(href, '(?i)^(mailto:|tel:|javascript:|#)')) b
    WHERE starts_with(target, site || '/')) c
  ) e
WHERE path <> '/' AND NOT regexp_matches(path, '(?i)^(/cdn-cgi|/404|/not-found)')
  AND NOT regexp_matches(path, '(?i)[^/]\.(png|jpg|jpeg|gif|webp|svg|ico|pdf|woff|woff2|ttf|css|js|map|xml|json|mp4|webm|zip)$')
QUALIFY row_number() OVER (PARTITION BY page_id, path ORDER BY pos) = 1
"""
DUCK_VIEWS["harvested"] = LINKS


@query("harvest_links", "SELECT * FROM {harvested}")
def _(spark, d):
    return I.harvest_links(corpus(spark, d))


@query("choose_source", """
WITH sm AS (SELECT site, url, page_id AS pos FROM {corpus_keys} WHERE length(site) % 2 = 0)
SELECT site, url, pos, 'sitemap' AS source FROM sm
UNION ALL SELECT site, url, page_id * 1000 + pos, 'crawl' FROM {harvested} WHERE site NOT IN (SELECT site FROM sm)""")
def _(spark, d):
    keys = view(spark, d, "corpus_keys")
    sitemap = keys.filter(F.length("site") % 2 == 0).select("site", "url", F.col("page_id").alias("pos"))
    crawl = I.harvest_links(corpus(spark, d)).select("site", "url", (F.col("page_id") * 1000 + F.col("pos")).alias("pos"))
    return I.choose_source(sitemap, crawl)


@query("merge_inventory", """
WITH ex AS (SELECT site, path, url, title FROM {deduped} WHERE pos % 8 = 0)
SELECT site, path, url, title, 'existing' AS origin FROM ex
UNION ALL
SELECT site, path, url, title, 'extra' FROM {deduped} n WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.site = n.site AND ex.path = n.path)""")
def _(spark, d):
    rows = deduped(spark, d)
    return I.merge_inventory(rows.filter("pos % 8 = 0"), rows)


# the same pages with content-list markers set by page number
define_view("cms_pages", r"""
SELECT page_id, url,
  CASE WHEN page_id % 11 = 0 THEN '  '
       WHEN page_id % 7 = 0 THEN replace(html, 'class="ad"', 'class="w-dyn-empty"')
       WHEN page_id % 5 = 0 THEN replace(replace(html, '<article>', '<section id="list" class="w-dyn-list">'), '</article>', '</section>')
       WHEN page_id % 5 = 1 THEN replace(replace(html, '<article>', '<section class="w-dyn-list"><i class="w-dyn-item"></i>'), '</article>', '</section>')
       WHEN page_id % 5 = 2 THEN replace(html, '<article>', '<section id="cms" class="w-dyn">one two</section><article data-framer-x>')
       ELSE html END AS html
FROM {pages}
""")
_EMPTY = r"""(html IS NULL OR NOT regexp_matches(html, '\S') OR regexp_matches(html, '(?i)w-dyn-empty|w-dyn-bind-empty')
  OR (regexp_matches(html, '(?i)w-dyn-list') AND NOT regexp_matches(html, '(?i)w-dyn-item'))
  OR NOT regexp_matches(html, '(?i)<(?:section|header|footer|main|nav|article)\b'))"""


def cms(spark, d):
    return page_corpus(view(spark, d, "cms_pages"))


@query("empty_pages", f"SELECT k.site, k.page_id, k.path, {_EMPTY} AS empty FROM {{cms_pages}} p JOIN {{corpus_keys}} k USING (page_id)")
def _(spark, d):
    return I.empty_pages(cms(spark, d)).select("site", "page_id", "path", "empty")


# what each site links or lists: its own paths without file endings, and every linked path
define_view("inventory_paths", r"""
SELECT DISTINCT site, regexp_replace(path, '\.html$', '') AS path FROM {corpus_keys} WHERE path <> '/'
UNION SELECT site, '/gone/' || CAST(page_id AS STRING) AS path FROM {corpus_keys} WHERE page_id % 6 = 0
""")
DUCK_VIEWS["slugged_inventory"] = r"""
SELECT site, path, CASE WHEN s = '' THEN 'page' ELSE s END AS slug FROM (SELECT *,
 regexp_replace(regexp_replace(lower(array_to_string(list_filter(string_split(path, '/'), lambda p: p <> ''), '-')), '[^a-z0-9-]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM {inventory_paths}) t
"""
DUCK_VIEWS["missing"] = rf"""
SELECT i.site, i.path, i.slug, CASE WHEN f.empty IS NULL THEN 'absent' ELSE 'empty' END AS reason
FROM {{slugged_inventory}} i LEFT JOIN (
  SELECT * FROM (SELECT k.site, regexp_replace(regexp_replace(k.path, '/index\.html$', ''), '\.html$', '') AS path, page_id, {_EMPTY} AS empty
  FROM {{cms_pages}} p JOIN {{corpus_keys}} k USING (page_id)) x QUALIFY row_number() OVER (PARTITION BY site, path ORDER BY page_id) = 1
) f ON f.site = i.site AND f.path = i.path
WHERE f.empty IS NULL OR f.empty
"""


def slugged_inventory(spark, d):
    return view(spark, d, "inventory_paths").withColumn("slug", U.slug(F.col("path")))


@query("missing_pages", "SELECT * FROM {missing}")
def _(spark, d):
    return I.missing_pages(slugged_inventory(spark, d), cms(spark, d))


@query("content_gaps", rf"""
SELECT site, path, n, section_id, reason FROM (
  SELECT k.site, k.path, CAST(n AS BIGINT) AS n, regexp_extract(regexp_extract(m, '(?s)^<[^>]*>', 0), '(?is)\sid\s*=\s*["'']([^"'']*)["'']', 1) AS section_id,
    CASE WHEN regexp_matches(m, '(?i)w-dyn-empty|w-dyn-bind-empty') THEN 'w-dyn-empty'
         WHEN regexp_matches(m, '(?i)w-dyn-list') AND NOT regexp_matches(m, '(?i)w-dyn-item') THEN 'collection-list-without-items'
         WHEN contains(m, 'w-dyn') AND len(list_filter(string_split(trim(regexp_replace(regexp_replace(m, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: w <> '')) < 4 THEN 'cms-section-without-copy' END AS reason
  FROM (SELECT page_id, unnest(ms) AS m, unnest(range(1, len(ms) + 1)) AS n FROM (SELECT page_id, regexp_extract_all(html, '(?is)<section\b[^>]*>.*?</section>') AS ms FROM {{cms_pages}}) a) b
  JOIN {{corpus_keys}} k USING (page_id)) s WHERE reason IS NOT NULL
UNION ALL SELECT k.site, k.path, 0, '', 'empty-page' FROM {{cms_pages}} p JOIN {{corpus_keys}} k USING (page_id) WHERE k.path <> '/' AND {_EMPTY}
UNION ALL SELECT site, path, 0, '', reason FROM {{missing}} WHERE reason = 'absent'""")
def _(spark, d):
    return I.content_gaps(cms(spark, d), slugged_inventory(spark, d))


@query("classify_sites", r"""
SELECT site, CASE WHEN NOT readable THEN 'framework-dump' WHEN markers <> '' THEN 'framework-dump'
                  WHEN webflow OR landmarks >= 2 THEN 'clean-html' ELSE 'framework-dump' END AS kind, markers, webflow, landmarks
FROM (
  SELECT k.site, bool_or(regexp_matches(html, '\S')) AS readable,
    bool_or(regexp_matches(html, '(?i)data-wf-page|data-wf-site|class=["''][^"'']*\bw-(?:container|section|nav)\b')) AS webflow,
    CAST(sum(len(regexp_extract_all(html, '(?i)<(?:section|header|footer|main|nav|article)\b'))) AS BIGINT) AS landmarks,
    CASE WHEN bool_or(regexp_matches(html, '(?i)data-framer-')) THEN 'data-framer-' ELSE '' END AS markers
  FROM {cms_pages} p JOIN {corpus_keys} k USING (page_id) GROUP BY k.site) t""")
def _(spark, d):
    return I.classify_sites(cms(spark, d))
