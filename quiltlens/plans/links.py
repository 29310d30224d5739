"""Registered link, navigation and metadata queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiltlens.operators import inventory as I, links as L, meta as D, nav as N
from quiltlens.operators.elements import page_elements
from quiltlens.plans.inventory import corpus, deduped
from quiltlens.plans.registry import DUCK_VIEWS, define_view, query, view
from quiltlens.session import materialize
from quiltlens.sources.corpus import page_corpus

VISIBLE = r"""regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<!--.*?-->', ' ', 'g')"""
TEXT = lambda x: rf"trim(regexp_replace(regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
ATTR = lambda x, a: rf"""regexp_extract(regexp_extract({x}, '(?s)^<[^>]*>', 0), '(?is)\s{a}\s*=\s*["'']([^"'']*)["'']', 1)"""
INNER = lambda x: rf"regexp_replace(regexp_replace({x}, '(?s)^<[^>]*>', ''), '(?s)</[^>]*>$', '')"
REG = r"(?is)<header\b.*?</header\s*>|<footer\b.*?</footer\s*>|<nav\b.*?</nav\s*>"

# pages whose links point at real pages, placeholders, files and templates, by page number
define_view("linked_pages", r"""
SELECT p.page_id, p.url,
  replace(replace(p.html, '</nav>',
    '<a class="site-logo" href="#">Logo ' || CAST(p.page_id % 3 AS STRING) || '</a><a href="#top">Home</a><a href="' || k.path || '">Own ' || CAST(p.page_id % 4 AS STRING) || '</a><a href="#x">Own ' || CAST(p.page_id % 4 AS STRING) || '</a></nav>'),
    '</article>', '<a href="mailto:a@b.c">mail</a><a href="' || k.path || '.html#frag">file</a><a href="about.html#x">about</a><a href="/en/none">none</a><a href="https://else.example/">else</a><a href="' || k.path || '/">slash</a></article>') AS html
FROM {pages} p JOIN {corpus_keys} k ON p.page_id = k.page_id
""")
DUCK_VIEWS["links"] = rf"""
SELECT site, page_id, region, CAST(b AS BIGINT) * 10000000000 + i AS pos, trim({ATTR('el', 'href')}) AS href,
  trim(regexp_replace(regexp_replace(lower({TEXT(INNER('el'))}), '&[a-z#0-9]+;', ' ', 'g'), '\s+', ' ', 'g')) AS label,
  regexp_extract(el, '(?s)^<[^>]*>', 0) AS tag
FROM (
  SELECT page_id, b, region, unnest(els) AS el, unnest(range(0, len(els))) AS i FROM (
    SELECT page_id, b, CASE WHEN b = n THEN 'body' ELSE lower(regexp_extract(m, '^<([a-zA-Z]+)', 1)) END AS region, regexp_extract_all(m, '(?is)<a\b[^>]*>.*?</a\s*>') AS els FROM (
      SELECT page_id, unnest(ms || [rest]) AS m, unnest(range(0, len(ms) + 1)) AS b, len(ms) AS n FROM (
        SELECT page_id, regexp_extract_all(v, '{REG}') AS ms, regexp_replace(v, '{REG}', ' ', 'g') AS rest
        FROM (SELECT page_id, {VISIBLE} AS v FROM {{linked_pages}}) a) b2) c) d2) e
JOIN {{corpus_keys}} k USING (page_id)
WHERE regexp_matches(regexp_extract(el, '(?s)^<[^>]*>', 0), '(?is)\shref\s*=\s*["'']')
"""
DUCK_VIEWS["route_map"] = r"""
SELECT site, kind, alias, route, ord FROM (
 WITH pg AS (SELECT site, pos, path, slug, title, template, '/' || slug || '/' AS route FROM {templated} WHERE slug NOT IN ('', 'home')),
 named AS (SELECT site, slug AS alias, route, pos, 0 AS k FROM pg UNION ALL SELECT site, lower(path), route, pos, 1 FROM pg UNION ALL SELECT site, lower(title), route, pos, 2 FROM pg
   UNION ALL SELECT DISTINCT site, unnest(['', '/', 'home', 'index']), '/', -1, 0 FROM {templated}),
 ex AS (SELECT site, alias, route, pos FROM named QUALIFY row_number() OVER (PARTITION BY site, alias ORDER BY pos DESC, k DESC) = 1)
 SELECT site, 'exact' AS kind, alias, route, CAST(pos AS BIGINT) AS ord FROM ex
 UNION ALL SELECT * FROM (SELECT site, 'template', lower(template) AS alias, route, pos FROM pg WHERE template IS NOT NULL QUALIFY row_number() OVER (PARTITION BY site, lower(template) ORDER BY pos) = 1) t
 UNION ALL SELECT DISTINCT site, 'stripped', trim(alias, '/'), NULL, 0 FROM ex) u
"""
DUCK_VIEWS["resolved"] = r"""
WITH refs AS (SELECT DISTINCT site, href, regexp_extract(href, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)', 1) AS path FROM {links}),
st AS (SELECT *, href = '' OR href LIKE '#%' AS ph, regexp_matches(href, '^(mailto:|tel:|javascript:|https://|http://)') AS ext,
  href LIKE '.%' OR href LIKE '%/%' OR href LIKE '%.html' AS pathy,
  '/' || trim(lower(CASE WHEN path LIKE '%.html' THEN regexp_replace(regexp_replace(path, '\.html$', ''), '(^|/)index$', '\1') ELSE path END), '/') AS key,
  lower(rtrim(path, '/')) AS key2, path IN ('', '/') AND NOT contains(href, '#') AS rooted, href LIKE '/%/' AS routed FROM refs),
ex AS (SELECT * FROM {route_map} WHERE kind = 'exact'),
tp AS (SELECT s.site, s.href, arg_min(t.route, t.ord) AS route FROM st s JOIN {route_map} t ON t.site = s.site AND t.kind = 'template' AND starts_with(s.key, left(t.alias, length(t.alias) - 1)) WHERE s.pathy GROUP BY ALL)
SELECT s.site, s.href, CASE
  WHEN ph THEN NULL WHEN ext THEN '#' WHEN s.href = '/' OR (pathy AND key = '/') THEN '/'
  WHEN routed AND z.alias IS NOT NULL THEN NULL
  WHEN pathy AND a.route IS NOT NULL THEN a.route WHEN pathy AND b.route IS NOT NULL THEN b.route WHEN tp.route IS NOT NULL THEN tp.route
  WHEN rooted THEN '/' WHEN c.route IS NOT NULL THEN c.route ELSE e.route END AS dest
FROM st s LEFT JOIN ex a ON a.site = s.site AND a.alias = key LEFT JOIN ex b ON b.site = s.site AND b.alias = trim(key, '/')
LEFT JOIN tp ON tp.site = s.site AND tp.href = s.href
LEFT JOIN ex c ON c.site = s.site AND c.alias = key2
LEFT JOIN ex e ON e.site = s.site AND e.alias = regexp_replace(regexp_extract(key2, '([^/]*)$', 1), '\.html$', '')
LEFT JOIN (SELECT * FROM {route_map} WHERE kind = 'stripped') z ON z.site = s.site AND z.alias = trim(key, '/')
"""
DUCK_VIEWS["label_routes"] = """
SELECT l.site, label, min(dest) AS route FROM {links} l JOIN {resolved} r ON r.site = l.site AND r.href = l.href
WHERE label <> '' AND length(label) <= 60 AND dest IS NOT NULL AND dest <> '#' GROUP BY l.site, label HAVING count(DISTINCT dest) = 1"""


def linked(spark, d):
    return page_corpus(view(spark, d, "linked_pages"))


def links(spark, d):
    return L.page_links(linked(spark, d))


def routes(spark, d):
    return L.route_map(I.collapse_templates(deduped(spark, d)))


def held_links(spark, d):
    """The links, taken from the pages once for queries that read them several times."""
    return materialize(links(spark, d), "links")


def held_routes(spark, d):
    return materialize(routes(spark, d), "routes")


def resolved(spark, d, held=None, paths=None):
    return L.resolve_hrefs(links(spark, d) if held is None else held, held_routes(spark, d) if paths is None else paths)


def labels(spark, d, held=None, paths=None):
    held = held_links(spark, d) if held is None else held
    return L.label_routes(held, resolved(spark, d, held, paths))


@query("page_links", "SELECT * FROM {links}")
def _(spark, d):
    return links(spark, d)


@query("route_map", "SELECT * FROM {route_map}")
def _(spark, d):
    return routes(spark, d)


@query("resolve_hrefs", "SELECT * FROM {resolved}")
def _(spark, d):
    return resolved(spark, d)


@query("label_routes", "SELECT * FROM {label_routes}")
def _(spark, d):
    return labels(spark, d)


@query("href_rewrites", r"""
SELECT site, page_id, region, pos, href, new_href, rule FROM (
  SELECT l.*, CASE WHEN dest IS NOT NULL THEN 'route' WHEN held AND lr.route IS NOT NULL THEN 'label' WHEN held AND logo THEN 'logo' ELSE 'name' END AS rule,
    coalesce(dest, CASE WHEN held THEN lr.route END, CASE WHEN held AND logo THEN '/' END,
      CASE WHEN l.href IN ('', '#') AND l.label IN ('home', 'homepage') THEN '/' WHEN l.href IN ('', '#') THEN n.route END) AS new_href
  FROM (SELECT *, href = '' OR href LIKE '#%' AS held, regexp_matches(tag, '(?i)class=["''][^''"]*\b(logo|brand|site-logo|wordmark)\b') AS logo FROM {links}) l
  LEFT JOIN {resolved} r ON r.site = l.site AND r.href = l.href
  LEFT JOIN {label_routes} lr ON lr.site = l.site AND lr.label = l.label
  LEFT JOIN {route_map} n ON n.kind = 'exact' AND n.site = l.site AND n.alias = l.label AND n.alias <> '') t
WHERE new_href IS NOT NULL AND new_href <> href""")
def _(spark, d):
    held, paths = held_links(spark, d), held_routes(spark, d)
    dests = materialize(resolved(spark, d, held, paths), "resolved")
    return L.href_rewrites(held, dests, paths, L.label_routes(held, dests))


@query("link_audit", r"""
SELECT DISTINCT l.site, 'dead' AS kind, l.label AS subject, lr.route FROM {links} l JOIN {label_routes} lr ON lr.site = l.site AND lr.label = l.label
WHERE l.region IN ('header', 'footer', 'nav') AND (l.href = '' OR l.href LIKE '#%')
UNION ALL
SELECT * FROM (SELECT DISTINCT site, 'unreachable', route AS subject, route FROM {route_map} WHERE kind = 'exact' AND route <> '/') w
WHERE NOT EXISTS (SELECT 1 FROM {links} l WHERE l.site = w.site AND l.region IN ('header', 'footer', 'nav') AND l.href LIKE '/%' AND CASE WHEN l.href LIKE '%/' THEN l.href ELSE l.href || '/' END = w.route)""")
def _(spark, d):
    held, paths = held_links(spark, d), held_routes(spark, d)
    wanted = paths.filter("kind = 'exact' AND route <> '/'").select("site", "route")
    return L.link_audit(held, labels(spark, d, held, paths), wanted)


@query("chrome_link_score", r"""
SELECT l.site, l.page_id,
  count(*) FILTER (NOT held AND k.path IS NOT NULL) AS live, count(*) FILTER (held AND lr.label IS NOT NULL) AS dead, count(*) FILTER (NOT held AND k.path IS NULL) AS broken
FROM (SELECT *, href = '' OR href LIKE '#%' AS held, CASE WHEN rtrim(regexp_replace(href, '[#?].*$', ''), '/') = '' THEN '/' ELSE rtrim(regexp_replace(href, '[#?].*$', ''), '/') END AS path
      FROM {links} WHERE region IN ('header', 'footer', 'nav') AND NOT regexp_matches(href, '(?i)^(https?:|mailto:|tel:|//)')) l
LEFT JOIN (SELECT DISTINCT site, path FROM {corpus_keys}) k ON k.site = l.site AND k.path = l.path
LEFT JOIN {label_routes} lr ON lr.site = l.site AND lr.label = l.label GROUP BY ALL""")
def _(spark, d):
    held = held_links(spark, d)
    return L.chrome_link_score(held, labels(spark, d, held), view(spark, d, "corpus_keys"))


@query("leftover_file_hrefs", r"""
SELECT site, page_id, pos, href, CASE WHEN NOT ok THEN href WHEN frag <> '' THEN base || '#' || frag ELSE base END AS route FROM (
  SELECT *, CASE WHEN slug IN ('index', 'home') THEN '/' ELSE '/' || slug || '/' END AS base FROM (
    SELECT k.site, page_id, CAST(pos AS BIGINT) AS pos, href, regexp_matches(href, '(?i)^[./]*([A-Za-z0-9_-]+)\.html(?:#(.*))?$') AS ok,
      lower(regexp_extract(href, '(?i)^[./]*([A-Za-z0-9_-]+)\.html(?:#(.*))?$', 1)) AS slug, regexp_extract(href, '(?i)^[./]*([A-Za-z0-9_-]+)\.html(?:#(.*))?$', 2) AS frag
    FROM (SELECT page_id, unnest(h) AS href, unnest(range(0, len(h))) AS pos FROM (SELECT page_id, regexp_extract_all(html, '(?i)\b(?:href|src|action)\s*=\s*["'']([^''"]+\.html(?:#[^''"]*)?)["'']', 1) AS h FROM {linked_pages}) a) b
    JOIN {corpus_keys} k USING (page_id)) c) e""")
def _(spark, d):
    return L.leftover_file_hrefs(linked(spark, d))


# the same navigation, nested under one trigger; the built side loses triggers, panels and items by page number
define_view("menu_pages", r"""
SELECT page_id, url, replace(replace(html, '<nav><ul><li>', '<nav><ul><li><a href="#"><span>Menu - Area ' || CAST(page_id % 3 AS STRING) || '</span></a> <ul><li>'), '</ul></nav>', '</ul></li></ul></nav>') AS html FROM {pages}
""")
define_view("built_menus", r"""
SELECT page_id, url, replace(CASE WHEN page_id % 4 = 0 THEN replace(html, 'Area', 'Zone') WHEN page_id % 4 = 1 THEN replace(html, 'href="/', 'href="/x') ELSE html END, '">a', '">q') AS html FROM {menu_pages}
""")
_INLINE = "span|b|i|em|strong|small|svg|path|img"
_TRIG = rf"(?is)<(?:a|button)\b[^>]*>(?:[^<]|</?(?:{_INLINE})\b[^>]*>)*</(?:a|button)\s*>"
_MENU = rf"(?is)<li\b[^>]*>\s*{_TRIG[5:]}\s*<ul\b[^>]*>.*?</ul\s*>"
KEY = lambda x: rf"regexp_replace(lower(regexp_replace({x}, '(?i)^(nav|menu|link)\s*[-–—:]\s*', '')), '[^a-z0-9]+', '', 'g')"


def _menus(source: str) -> str:
    return rf"""
SELECT site, page_id, label, key, items FROM (
  SELECT page_id, nn, mm, label, key, list_filter(its, lambda i: i <> '' AND {KEY('i')} <> key) AS items FROM (
    SELECT *, {KEY('label')} AS key FROM (
      SELECT page_id, nn, mm, {TEXT(f"regexp_extract(menu, '{_TRIG}', 0)")} AS label,
        list_transform(regexp_extract_all(regexp_extract(menu, '(?is)<ul\b[^>]*>.*</ul\s*>', 0), '(?is)<a\b[^>]*>.*?</a\s*>'), lambda a: {TEXT(INNER('a'))}) AS its
      FROM (SELECT page_id, nn, unnest(ms) AS menu, unnest(range(0, len(ms))) AS mm FROM (
        SELECT page_id, nn, regexp_extract_all(nav, '{_MENU}') AS ms FROM (
          SELECT page_id, unnest(ns) AS nav, unnest(range(0, len(ns))) AS nn FROM (SELECT page_id, regexp_extract_all({VISIBLE}, '(?is)<nav\b.*?</nav\s*>') AS ns FROM {source}) a) b) c) e) f) g) h
JOIN {{corpus_keys}} k USING (page_id) WHERE key <> '' AND len(items) >= 2
QUALIFY row_number() OVER (PARTITION BY page_id, key ORDER BY nn, mm) = 1"""


DUCK_VIEWS["menus"] = _menus("{menu_pages}")
DUCK_VIEWS["built"] = _menus("{built_menus}")
DUCK_VIEWS["nav_expected"] = rf"""
WITH ev AS (SELECT m.*, m.page_id = h.home_id AS home, 'submenu' AS kind, 'source ' || CAST(m.page_id % 2 AS VARCHAR) AS src FROM {{menus}} m JOIN (SELECT site, min(page_id) AS home_id FROM {{corpus_keys}} GROUP BY site) h USING (site)),
al AS (SELECT site, page_id, kind, key, label, items, src FROM ev WHERE NOT home UNION ALL SELECT ev.site, k.page_id, kind, key, label, items, src FROM ev JOIN {{corpus_keys}} k ON k.site = ev.site WHERE home)
SELECT site, page_id, kind, key, min(label) AS trigger, list_sort(list_distinct(flatten(list(items)))) AS items, array_to_string(list_sort(list_distinct(list(src))), '; ') AS evidence FROM al GROUP BY site, page_id, kind, key"""
DUCK_VIEWS["nav_states"] = rf"""
SELECT site, page_id, kind, key, trigger, evidence,
  CASE WHEN b IS NULL THEN 'missing' WHEN len(w) > 0 AND len(ab) = len(w) THEN 'unwired' ELSE 'wired' END AS state,
  CASE WHEN b IS NULL THEN '' ELSE array_to_string(ab, ', ') END AS absent FROM (
  SELECT *, list_filter(w, lambda i: NOT list_contains(list_transform(coalesce(b, []), lambda j: {KEY('j')}), {KEY('i')})) AS ab FROM (
    SELECT e.*, bt.items AS b, list_filter(e.items, lambda i: {KEY('i')} <> '') AS w FROM {{nav_expected}} e LEFT JOIN {{built}} bt ON bt.site = e.site AND bt.page_id = e.page_id AND bt.key = e.key) x) y"""


def menus(spark, d, name="menu_pages"):
    return N.nav_menus(page_elements(page_corpus(view(spark, d, name))))


def expected(spark, d):
    keys = view(spark, d, "corpus_keys")
    home = keys.groupBy("site").agg(F.min("page_id").alias("_home"))
    ev = menus(spark, d).join(home, "site").select(
        "site", "page_id", (F.col("page_id") == F.col("_home")).alias("home"), F.lit("submenu").alias("kind"),
        F.col("label").alias("trigger"), "items", F.concat(F.lit("source "), (F.col("page_id") % 2).cast("string")).alias("source"),
    )
    return N.nav_inventory(ev, keys)


def states(spark, d):
    built = menus(spark, d, "built_menus").withColumn("has_panel", F.lit(True))
    return N.nav_state(expected(spark, d), built)


@query("nav_menus", "SELECT site, page_id, label, key, array_to_string(items, '|') AS items FROM {menus}")
def _(spark, d):
    return menus(spark, d).withColumn("items", F.array_join("items", "|"))


@query("nav_inventory", "SELECT site, page_id, kind, key, trigger, array_to_string(items, '|') AS items, evidence FROM {nav_expected}")
def _(spark, d):
    return expected(spark, d).withColumn("items", F.array_join("items", "|"))


@query("nav_state", "SELECT * FROM {nav_states}")
def _(spark, d):
    return states(spark, d)


@query("nav_audit", r"""
SELECT k.site, k.page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(p.html, '(?s)<!--.*?-->', '', 'g'), '(?i)\b(href|src|action)\s*=\s*["''][^''"]*["'']', '\1="#"', 'g'), '\s+', ' ', 'g'))) AS print,
  coalesce(s.items, 0) AS items, coalesce(s.broken, 0) AS broken, coalesce(s.detail, '') AS detail, s.items IS NULL AS skipped
FROM {built_menus} p JOIN {corpus_keys} k USING (page_id) LEFT JOIN (
  SELECT page_id, count(*) AS items, count(*) FILTER (state <> 'wired') AS broken,
    coalesce(string_agg(kind || ' ' || trigger || ' is ' || state, '; ' ORDER BY kind || ' ' || trigger || ' is ' || state) FILTER (state <> 'wired'), '') AS detail
  FROM {nav_states} GROUP BY page_id) s USING (page_id)""")
def _(spark, d):
    return N.nav_audit(page_corpus(view(spark, d, "built_menus")), states(spark, d))


# head elements set by page number; the second reading is the live fetch
define_view("meta_pages", r"""
SELECT page_id, url, replace(CASE WHEN page_id % 5 = 0 THEN replace(html, '<title>', '<titel>') ELSE html END, '</head>',
  CASE WHEN page_id % 2 = 0 THEN '<meta name="Description" content=" About page ' || CAST(page_id AS STRING) || ' ">' ELSE '' END ||
  CASE WHEN page_id % 3 = 0 THEN '<meta content="https://img.example/' || CAST(page_id AS STRING) || '.png" property="og:image">' ELSE '' END ||
  CASE WHEN page_id % 7 = 0 THEN '<meta property="og:title" content="Social ' || CAST(page_id AS STRING) || '"><meta property="og:description" content="Social text">' ELSE '' END ||
  CASE WHEN page_id % 4 = 1 THEN '<link rel="canonical" href="' || url || '">' ELSE '' END || '</head>') AS html FROM {pages}
""")
DUCK_VIEWS["meta"] = rf"""
SELECT site, page_id, url, path, nullif(trim({ATTR("regexp_extract(html, '(?is)<html[^>]*>', 0)", 'lang')}), '') AS lang,
 coalesce(nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), ''), nullif(trim({ATTR('ogt', 'content')}), '')) AS title,
 coalesce(nullif(trim({ATTR('de', 'content')}), ''), nullif(trim({ATTR('ogd', 'content')}), '')) AS description,
 nullif(trim({ATTR('ogi', 'content')}), '') AS og_image, nullif(trim({ATTR('ca', 'href')}), '') AS canonical
FROM (SELECT k.*, html, regexp_extract(html, '(?is)<meta\b[^>]*property="og:title"[^>]*>', 0) AS ogt, regexp_extract(html, '(?is)<meta\b[^>]*name="description"[^>]*>', 0) AS de,
  regexp_extract(html, '(?is)<meta\b[^>]*property="og:description"[^>]*>', 0) AS ogd, regexp_extract(html, '(?is)<meta\b[^>]*property="og:image"[^>]*>', 0) AS ogi,
  regexp_extract(html, '(?is)<link\b[^>]*rel="canonical"[^>]*>', 0) AS ca FROM {{meta_pages}} p JOIN {{corpus_keys}} k USING (page_id, url)) t"""


def meta(spark, d):
    return D.page_meta(page_corpus(view(spark, d, "meta_pages")))


@query("page_meta", "SELECT * FROM {meta}")
def _(spark, d):
    return meta(spark, d)


@query("merge_meta", """
SELECT coalesce(l.site, s.site) AS site, coalesce(l.page_id, s.page_id) AS page_id, coalesce(l.lang, s.lang, x.lang) AS lang, coalesce(l.title, s.title) AS title,
  coalesce(l.description, s.description) AS description, coalesce(l.og_image, s.og_image) AS og_image, coalesce(l.canonical, s.canonical, l.url, s.url) AS canonical
FROM (SELECT * REPLACE (NULL AS title, CASE WHEN page_id % 9 = 0 THEN NULL ELSE lang END AS lang) FROM {meta} WHERE page_id % 4 <> 3) l
FULL JOIN (SELECT * REPLACE (CASE WHEN page_id % 9 = 0 THEN NULL ELSE lang END AS lang) FROM {meta} WHERE page_id % 4 <> 2) s ON s.page_id = l.page_id
LEFT JOIN (SELECT site, min(lang) AS lang FROM {meta} GROUP BY site) x ON x.site = coalesce(l.site, s.site)""")
def _(spark, d):
    m = meta(spark, d)
    no_lang = m.withColumn("lang", F.when(F.col("page_id") % 9 != 0, F.col("lang")))
    live = no_lang.withColumn("title", F.lit(None).cast("string")).filter("page_id % 4 <> 3")
    return D.merge_meta(no_lang.filter("page_id % 4 <> 2"), live, m.groupBy("site").agg(F.min("lang").alias("lang")))


@query("meta_gaps", """
WITH g AS (SELECT site, page_id, concat_ws(',', CASE WHEN title IS NULL THEN 'title' END, CASE WHEN description IS NULL THEN 'description' END, CASE WHEN og_image IS NULL THEN 'og_image' END) AS missing FROM {meta})
SELECT * FROM g WHERE missing <> '' UNION ALL SELECT site, NULL, CAST(count(*) FILTER (missing <> '') AS VARCHAR) || '/' || CAST(count(*) AS VARCHAR) FROM g GROUP BY site""")
def _(spark, d):
    return D.meta_gaps(meta(spark, d))
