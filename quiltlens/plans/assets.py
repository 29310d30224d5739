"""Registered asset queries, over the pages with images, fonts and wiring set by page number."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiltlens.operators import assets as E
from quiltlens.plans.registry import DUCK_VIEWS, define_view, query, view
from quiltlens.sources.corpus import page_corpus

define_view("media_pages", r"""
SELECT page_id, url, replace(replace(replace(html, '<article>', '<article><section><img src="https://cdn.example/pic-' || CAST(page_id % 9 AS STRING) || '.png?w=200&v=2" srcset="https://cdn.example/pic-' || CAST(page_id % 9 AS STRING) || '.png?w=320 ' || CAST(page_id % 50 + 300 AS STRING) || 'w, https://cdn.example/x.png 2x"> Near words' ||
  '<img src="https://cdn.example/pic-' || CAST(page_id % 9 AS STRING) || '.png?v=3">' || CASE WHEN page_id % 3 = 0 THEN '<img src="https://www.example/_next/image?url=https%3A%2F%2Fcdn.example%2Fnx.jpg%3Fq%3D5&w=64">' ELSE '' END ||
  CASE WHEN page_id % 4 = 0 THEN '<img src="/images/a' || CAST(page_id % 7 AS STRING) || '.png"><img src="data:image/png;base64,AA"><img src="img/b.jpg?scale-down-to=512">' ELSE '' END || '<svg  viewBox="0 0 9 9"> <path d="' || CAST(page_id % 6 AS STRING) || '"/></svg>Label ' || CAST(page_id % 6 AS STRING) ||
  '<div style="background-image: url(/images/bg' || CAST(page_id % 5 AS STRING) || '.webp)"></div></section>' || CASE WHEN page_id % 5 = 0 THEN '<section><form><input type="date"><textarea></textarea></form><iframe></iframe></section>' ELSE '' END),
  '</head>', '<link rel="stylesheet" href="/css/a.css"><link rel="stylesheet" href="https://cdn.example/z.css"><script type="application/ld+json">1</script><script src="/js/h' || CAST(page_id % 3 AS STRING) || '.js" defer></script></head>'),
  '</body>', '<script type="module" src="https://cdn.example/m.js"></script><script src="/js/h0.js"></script></body>') AS html FROM {pages}
""")
define_view("media_built", r"SELECT page_id, url, replace(replace(html, 'pic-3', 'lost-3'), 'd=""4""', 'd=""9""') AS html FROM {media_pages} WHERE page_id % 2 = 0".replace('""', '"'))
DUCK_VIEWS["mk"] = "SELECT k.site, page_id, html FROM {media_pages} p JOIN {corpus_keys} k USING (page_id)"
media = lambda s, d: page_corpus(view(s, d, "media_pages"))

DUCK_VIEWS["found_images"] = r"""
SELECT site, page_id, pos, name, url FROM (
 SELECT *, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]+)$', 1) AS name FROM (
  SELECT site, page_id, CAST(i AS BIGINT) AS pos, CASE WHEN contains(u, '_next/image') THEN 'https://cdn.example/nx.jpg' WHEN u LIKE '%?w=200&v=2' THEN replace(u, '?w=200&v=2', '?v=2') WHEN u LIKE '%?w=320' THEN replace(u, '?w=320', '') ELSE u END AS url FROM (
   SELECT site, page_id, unnest(us) AS u0, unnest(range(0, len(us))) AS i, regexp_replace(u0, '[.,;)]+$', '') AS u FROM (SELECT site, page_id, regexp_extract_all(html, '(?i)https?://[^"''()\s<>]+') AS us FROM {mk}) a) b) c) e
WHERE regexp_matches(regexp_replace(url, '[?#].*$', ''), '(?i)\.(png|jpe?g|gif|webp|avif|svg)$') QUALIFY row_number() OVER (PARTITION BY site, page_id, name ORDER BY pos) = 1"""


@query("original_images", "SELECT * FROM {found_images}")
def _(spark, d):
    return E.original_images(media(spark, d))


@query("srcset_max_width", "SELECT site, 'pic-' || CAST(page_id % 9 AS VARCHAR) || '.png' AS name, CAST(max(page_id % 50 + 300) AS BIGINT) AS max_width FROM {mk} WHERE contains(html, 'srcset=') GROUP BY 1, 2")
def _(spark, d):
    return E.srcset_max_width(media(spark, d))


define_view("files", "SELECT l_suppkey AS site, CASE l_partkey % 4 WHEN 0 THEN 'f' || CAST(l_partkey % 20 AS STRING) || '.woff2' WHEN 1 THEN 'i' || CAST(l_partkey % 30 AS STRING) || '.svg' ELSE 'p' || CAST(l_partkey % 40 AS STRING) || '.png' END AS name, 'dir/' || CAST(l_orderkey AS STRING) || '/' || CAST(l_partkey AS STRING) || CAST(l_linenumber AS STRING) AS path, CASE WHEN l_partkey % 13 = 0 THEN 0 ELSE l_orderkey END AS bytes, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_partkey % 50 END AS width, l_suppkey % 9 + 1 AS height, 'sha' || CAST(l_orderkey % 500 AS STRING) AS sha256 FROM {lineitem}")
define_view("planned", "SELECT DISTINCT l_suppkey AS site, 'https://c.example/' || CASE l_partkey % 4 WHEN 0 THEN 'f' || CAST(l_partkey % 24 AS STRING) || '.woff2' WHEN 1 THEN 'i' || CAST(l_partkey % 34 AS STRING) || '.svg' ELSE 'p' || CAST(l_partkey % 44 AS STRING) || '.png' END || '?v=1' AS url FROM {lineitem}")
DUCK_VIEWS["largest"] = "SELECT site, name, path, sha256, bytes, width, height FROM {files} QUALIFY row_number() OVER (PARTITION BY site, name ORDER BY coalesce(width * height, 0) DESC, bytes DESC, path DESC) = 1"


@query("largest_original", "SELECT * FROM {largest}")
def _(spark, d):
    return E.largest_original(view(spark, d, "files"))


@query("asset_ledger", r"""
SELECT p.site, p.url, p.name, CASE WHEN p.name LIKE '%woff2' THEN 'font' WHEN p.name LIKE '%svg' THEN 'svg' ELSE 'image' END AS kind, CASE WHEN l.path IS NULL OR bytes = 0 THEN 'missing' ELSE 'exact' END AS status, CASE WHEN l.path IS NULL THEN 'not downloaded' WHEN bytes = 0 THEN 'empty file' ELSE '' END AS reason, sha256, bytes
FROM (SELECT *, regexp_extract(url, '([^/]+)\?v=1$', 1) AS name FROM {planned}) p LEFT JOIN {largest} l ON l.site = p.site AND l.name = p.name""")
def _(spark, d):
    return E.asset_ledger(view(spark, d, "planned"), view(spark, d, "files"))


define_view("shipped", "SELECT DISTINCT site, 'images/a' || CAST(page_id % 7 AS STRING) || '.png' AS path, CASE WHEN page_id % 7 < 3 THEN 'good' ELSE 'other' END AS sha256 FROM {corpus_keys} WHERE page_id % 7 <> 6")


@query("check_asset_refs", r"""
WITH r AS (SELECT site, page_id, CAST(unnest(range(0, len(xs))) AS BIGINT) AS pos, trim(unnest(xs)) AS ref FROM (SELECT site, page_id, regexp_extract_all(html, '(?i)(?:src|href)\s*=\s*["'']([^"'']+)["'']', 1) || regexp_extract_all(html, '(?i)url\(\s*["'']?([^"'')]+)["'']?\s*\)', 1) AS xs FROM {mk}) a),
x AS (SELECT *, regexp_replace(regexp_replace(ref, '[?#].*$', ''), '^(\.{{0,2}}/)+', '') AS path FROM r WHERE regexp_matches(regexp_replace(ref, '[?#].*$', ''), '(?i)\.(png|jpe?g|gif|webp|avif)$') OR ref LIKE 'data:image/%')
SELECT * FROM (SELECT x.site, page_id, pos, ref, CASE WHEN ref LIKE 'data:image/%' THEN 'data uri' WHEN contains(ref, 'scale-down-to=') THEN 'resized' WHEN regexp_matches(ref, '^(https?:|//)') THEN 'remote' WHEN s.sha256 IS NULL THEN 'missing file' WHEN s.sha256 <> 'good' THEN 'not an original' END AS reason
FROM x LEFT JOIN {shipped} s ON s.site = x.site AND s.path = x.path) t WHERE reason IS NOT NULL""".replace("{{0,2}}", "{0,2}"))
def _(spark, d):
    s = view(spark, d, "shipped")
    return E.check_asset_refs(E.asset_refs(media(spark, d)), s, s.filter("sha256 = 'good'"))


def _census(src: str) -> str:
    return rf"""
SELECT site, page_id, kind, key, near FROM (
 SELECT site, page_id, 'svg' AS kind, sha1(regexp_replace(regexp_replace(regexp_extract(s, '(?is)^(.*</svg\s*>)', 1), '\s+', ' ', 'g'), '>\s+<', '><', 'g')) AS key, trim(regexp_replace(regexp_extract(s, '(?is)</svg\s*>([^<]*)$', 1), '\s+', ' ', 'g')) AS near FROM (SELECT k.site, page_id, unnest(regexp_extract_all(html, '(?is)<svg\b[^>]*>.*?</svg\s*>[^<]*')) AS s FROM {src} p JOIN {{corpus_keys}} k USING (page_id)) a
 UNION ALL SELECT site, page_id, 'img', lower(regexp_extract(regexp_replace(regexp_extract(s, '(?is)\ssrc\s*=\s*["'']([^"'']*)["'']', 1), '(?s)[?#].*$', ''), '([^/]+)/*$', 1)), trim(regexp_replace(regexp_replace(s, '(?s)^<[^>]*>', ''), '\s+', ' ', 'g')) FROM (SELECT k.site, page_id, unnest(regexp_extract_all(html, '(?is)<img\b[^>]*>[^<]*')) AS s FROM {src} p JOIN {{corpus_keys}} k USING (page_id)) b
 UNION ALL SELECT k.site, page_id, 'background', 'bg' || CAST(page_id % 5 AS VARCHAR) || '.webp', '' FROM (SELECT page_id, unnest(regexp_extract_all(html, 'background-image: url')) FROM {src}) p JOIN {{corpus_keys}} k USING (page_id)) u WHERE key <> ''"""


DUCK_VIEWS["census_s"], DUCK_VIEWS["census_b"] = _census("{media_pages}"), _census("{media_built}")


@query("asset_census", "SELECT * FROM {census_s}")
def _(spark, d):
    return E.asset_census(media(spark, d))


@query("missing_assets", "SELECT DISTINCT site, kind, key FROM {census_s} s WHERE NOT EXISTS (SELECT 1 FROM {census_b} b WHERE b.site = s.site AND b.kind = s.kind AND b.key = s.key)")
def _(spark, d):
    return E.missing_assets(E.asset_census(media(spark, d)), E.asset_census(page_corpus(view(spark, d, "media_built"))))


define_view("face_css", r"""
SELECT CAST(floor(p_partkey / 32) AS BIGINT) AS site, p_partkey % 4 AS page, p_partkey AS pos, '@font-face ' || chr(123) || ' font-family: "' || CASE WHEN p_size % 6 < 3 THEN 'Fam' ELSE 'FAM' END || CAST(p_size % 3 AS STRING) || '"; ' || CASE WHEN p_size % 2 = 0 THEN 'font-weight: 700; ' ELSE '' END || CASE p_partkey % 11 WHEN 3 THEN '' WHEN 5 THEN 'src: url(/f.woff2.svg); ' WHEN 7 THEN 'src: url("/f.TTF?v=1"); ' ELSE 'src: url(/f' || CAST(p_size % 5 AS STRING) || '.woff2); ' END ||
  CASE p_partkey % 7 WHEN 0 THEN 'unicode-range: U+0000-00FF' WHEN 1 THEN 'unicode-range: U+0400-04FF' WHEN 2 THEN 'unicode-range: U+0000-0030' ELSE '' END || ' ' || chr(125) AS css FROM {part}
""")
DUCK_VIEWS["faces"] = r"""SELECT CAST(floor(p_partkey / 32) AS BIGINT) AS site, p_partkey % 4 AS page, p_partkey AS pos, CASE WHEN p_size % 6 < 3 THEN 'Fam' ELSE 'FAM' END || p_size % 3 AS family, CASE WHEN p_size % 2 = 0 THEN '700' ELSE '400' END AS weight, 'normal' AS style, CASE p_partkey % 7 WHEN 0 THEN 'U+0000-00FF' WHEN 1 THEN 'U+0400-04FF' WHEN 2 THEN 'U+0000-0030' ELSE '' END AS unicode_range, CASE WHEN p_partkey % 11 = 7 THEN '/f.TTF?v=1' ELSE '/f' || p_size % 5 || '.woff2' END AS url FROM part WHERE p_partkey % 11 NOT IN (3, 5)"""
DUCK_VIEWS["latin"] = "SELECT * FROM {faces} WHERE unicode_range IN ('', 'U+0000-00FF') QUALIFY row_number() OVER (PARTITION BY site, page, family, weight, style, unicode_range, url ORDER BY pos) = 1"


@query("font_faces", "SELECT * FROM {faces}")
def _(spark, d):
    return E.font_faces(view(spark, d, "face_css")).drop("i")


@query("latin_faces", "SELECT * FROM {latin}")
def _(spark, d):
    return E.latin_faces(E.font_faces(view(spark, d, "face_css"))).drop("i")


@query("collect_plan_summary", """
WITH f AS (SELECT site, page, count(*) AS n FROM {faces} GROUP BY ALL), l AS (SELECT site, page, count(*) AS n FROM {latin} GROUP BY ALL),
p AS (SELECT CAST(floor(p_partkey / 32) AS BIGINT) AS site, p_partkey % 4 AS page, count(*) AS n FROM part GROUP BY ALL)
SELECT p.site, p.page, 'Page ' || CAST(p.page AS VARCHAR) AS title, coalesce(f.n, 0) AS faces, coalesce(l.n, 0) AS fonts, p.n AS images, greatest(0, coalesce(f.n, 0) - coalesce(l.n, 0)) AS skipped
FROM p LEFT JOIN f ON f.site = p.site AND f.page = p.page LEFT JOIN l ON l.site = p.site AND l.page = p.page""")
def _(spark, d):
    css = view(spark, d, "face_css")
    faces = E.font_faces(css)
    pages = css.select("site", "page", F.concat(F.lit("Page "), F.col("page").cast("string")).alias("title")).distinct()
    return E.collect_plan_summary(pages, faces, E.latin_faces(faces), css.select("site", "page"))


define_view("lib_fonts", "SELECT CAST(floor(p_partkey / 32) AS BIGINT) AS site, CASE p_size % 4 WHEN 0 THEN 'serif' WHEN 1 THEN 'Inter' ELSE 'Lora ' || CAST(p_size % 5 AS STRING) END AS family, p_partkey AS pos FROM {part} WHERE p_partkey % 3 = 0")
define_view("css_fonts", "SELECT CAST(floor(p_partkey / 32) AS BIGINT) AS site, CASE p_size % 4 WHEN 0 THEN CASE WHEN p_size % 8 = 0 THEN 'system-ui' ELSE '-apple-system' END WHEN 1 THEN 'INTER' ELSE 'Mono ' || CAST(p_size % 3 AS STRING) END AS family, p_partkey AS pos FROM {part}")
define_view("font_files", "SELECT CAST(floor(p_partkey / 32) AS BIGINT) AS site, CASE p_size % 3 WHEN 0 THEN 'inter' ELSE 'Mono ' || CAST(p_size % 3 AS STRING) END AS family, CASE p_partkey % 8 WHEN 0 THEN 'x-700.woff2' WHEN 1 THEN 'x-SemiBold.woff2' WHEN 2 THEN 'x-Light.woff' WHEN 3 THEN 'x-Ultralight.woff' WHEN 4 THEN 'x-DemiBold.woff' WHEN 5 THEN 'x-UltraBold.woff' WHEN 6 THEN 'x-Heavy.woff' ELSE 'x.woff' END AS file FROM {part}")


@query("font_roster", """
WITH o AS (SELECT * FROM (SELECT *, 0 AS src FROM {lib_fonts} UNION ALL SELECT *, 1 FROM {css_fonts}) t WHERE family NOT IN ('serif', 'system-ui', '-apple-system') QUALIFY row_number() OVER (PARTITION BY site, lower(family) ORDER BY src, pos) = 1),
w AS (SELECT DISTINCT site, lower(family) AS k, CASE file WHEN 'x-700.woff2' THEN 700 WHEN 'x-SemiBold.woff2' THEN 600 WHEN 'x-Light.woff' THEN 300 WHEN 'x-Ultralight.woff' THEN 200 WHEN 'x-DemiBold.woff' THEN 600 WHEN 'x-UltraBold.woff' THEN 800 WHEN 'x-Heavy.woff' THEN 900 ELSE 400 END AS weight FROM {font_files})
SELECT o.site, o.family, CASE WHEN src = 0 THEN 'library' ELSE 'css' END AS origin, CAST(w.weight AS BIGINT) AS weight FROM o LEFT JOIN w ON w.site = o.site AND w.k = lower(o.family)""")
def _(spark, d):
    return E.font_roster(view(spark, d, "lib_fonts"), view(spark, d, "css_fonts"), view(spark, d, "font_files"))


_FACE = "SELECT {s} AS site, 'Fam' || CAST(p_size % {m} AS STRING) AS family, CASE WHEN p_size % 2 = 0 THEN '700' ELSE '400' END AS weight, 'normal' AS style, CASE p_partkey % 3 WHEN 0 THEN 'U+0000-00FF' WHEN 1 THEN 'U+0400' ELSE '' END AS unicode_range, 'f' || CAST(p_size % 9 AS STRING) AS file, 's' || CAST(p_partkey % {k} AS STRING) AS sha256 FROM {part}"
for _n, _m, _k in (("built_faces", "5", "12"), ("source_faces", "4", "9")):
    define_view(_n, _FACE.replace("{s}", "CAST(floor(p_partkey / 32) AS BIGINT)").replace("{m}", _m).replace("{k}", _k))


@query("font_face_check", """
WITH s AS (SELECT DISTINCT site, family, weight FROM {source_faces}), h AS (SELECT DISTINCT site, sha256 FROM {source_faces})
SELECT b.site, b.family, b.weight, b.style, b.file, unnest(list_filter([CASE WHEN b.file IN ('f7', 'f8') THEN 'missing file' END, CASE WHEN s.site IS NULL THEN 'descriptor mismatch' END, CASE WHEN b.file NOT IN ('f7', 'f8') AND h.site IS NULL THEN 'byte mismatch' END, CASE WHEN unicode_range = 'U+0400' THEN 'non-latin subset' END], lambda k: k IS NOT NULL)) AS kind
FROM {built_faces} b LEFT JOIN s ON s.site = b.site AND s.family = b.family AND s.weight = b.weight LEFT JOIN h ON h.site = b.site AND h.sha256 = b.sha256""")
def _(spark, d):
    b = view(spark, d, "built_faces")
    sites = b.select("site").distinct().select("site", F.explode(F.array(*[F.lit(f"f{i}") for i in range(7)])).alias("file"))
    return E.font_face_check(b, view(spark, d, "source_faces"), sites)


@query("element_inventory", r"""
WITH v AS (SELECT site, page_id, regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<!--.*?-->', ' ', 'g') AS html FROM {mk}),
s AS (SELECT site, page_id AS page, CAST(unnest(range(0, len(ms))) AS BIGINT) AS section, unnest(ms) AS m FROM (SELECT site, page_id, regexp_extract_all(html, '(?is)<(?:header|section|footer)\b[^>]*>.*?</(?:header|section|footer)\s*>') AS ms FROM v) a),
f AS (SELECT site, page, section, len(regexp_extract_all(m, '(?i)<img\b')) + len(regexp_extract_all(m, 'background-image: url')) AS images, len(regexp_extract_all(m, '(?i)<form\b')) AS forms, len(regexp_extract_all(m, '(?i)<(?:input|textarea|select)\b')) AS fields, len(regexp_extract_all(m, '(?i)<(?:header|nav|main|section|article|footer)\b')) AS landmarks FROM s)
SELECT site, page, section, CAST(sum(images) AS BIGINT) AS images, CAST(sum(forms) AS BIGINT) AS forms, CAST(sum(fields) AS BIGINT) AS fields, CAST(sum(landmarks) AS BIGINT) AS landmarks FROM f GROUP BY ROLLUP (site, page, section)""")
def _(spark, d):
    return E.element_inventory(media(spark, d))


@query("html_inventory", r"""
SELECT site, page_id, len(regexp_extract_all(html, '(?i)<img\b')) AS images, len(regexp_extract_all(html, '(?i)<iframe\b')) AS frames, len(regexp_extract_all(html, '(?i)<h[1-6]\b')) AS headings, len(regexp_extract_all(html, '(?i)<a\b')) AS links, len(regexp_extract_all(html, '(?i)<svg\b')) AS drawings, contains(html, '<iframe>') AS frame_without_source, contains(html, 'type="date"') AS date_field FROM {mk}""")
def _(spark, d):
    return E.html_inventory(media(spark, d))


@query("wiring_census", r"""
WITH b AS (SELECT site, page_id, 0 AS b, 'head' AS place, regexp_extract(lower(h) || '', '(?s)^.*?<body', 0) AS part FROM (SELECT site, page_id, regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g') AS h FROM {mk}) z UNION ALL SELECT site, page_id, 1, 'body', substr(h, position('<body' IN lower(h))) FROM (SELECT site, page_id, regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g') AS h FROM {mk}) z),
e AS (SELECT site, page_id, b, place, unnest(els) AS el, unnest(range(0, len(els))) AS i FROM (SELECT *, regexp_extract_all(part, '(?is)<link\b[^>]*\brel\s*=\s*["'']?stylesheet[^>]*>|<script\b[^>]*>') AS els FROM b) x),
r AS (SELECT site, page_id, place, CAST(b AS BIGINT) * 10000000000 + i AS pos, CASE WHEN el LIKE '<script%' THEN 'script' ELSE 'style' END AS kind, regexp_extract(el, '(?:src|href)="([^"]*)"', 1) AS src, contains(el, ' defer') AS deferred, contains(el, 'type="module"') AS module FROM e WHERE NOT contains(el, 'ld+json')),
o AS (SELECT *, regexp_matches(src, '^(https?:)?//') AS external FROM r WHERE src <> '' QUALIFY row_number() OVER (PARTITION BY page_id, kind, src ORDER BY pos) = 1)
SELECT o.*, s.shared FROM o JOIN (SELECT kind, src, count(DISTINCT site) AS shared FROM o GROUP BY ALL) s ON s.kind = o.kind AND s.src = o.src""")
def _(spark, d):
    return E.wiring_census(media(spark, d))
