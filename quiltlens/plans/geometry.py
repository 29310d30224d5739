"""Registered geometry queries over nodes derived from order lines (one board and frame per order)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiltlens.operators import geometry as K
from quiltlens.plans.registry import DUCK_VIEWS, define_view, query, view

define_view("gnodes", r"""
SELECT 'site-' || CAST(CAST(floor(l_orderkey / 64) AS BIGINT) AS STRING) AS site, l_orderkey AS board, ((l_orderkey * 100000 + l_partkey) * 10 + l_linenumber) * 1000 + l_suppkey % 1000 AS node_id, -l_orderkey AS parent_id,
  CAST(l_partkey AS BIGINT) AS ord, CASE l_partkey % 5 WHEN 0 THEN 'Frame' WHEN 1 THEN 'Image' WHEN 2 THEN 'Rectangle' ELSE 'Text' END AS component, CASE WHEN l_suppkey % 4 = 0 THEN 'Photo' WHEN l_suppkey % 23 = 1 THEN 'site-chrome' WHEN l_suppkey % 23 = 2 THEN 'Main menu' WHEN l_suppkey % 23 = 3 THEN '01 · hero' WHEN l_suppkey % 23 = 4 THEN 'Deferred-Image 2' ELSE 'node ' || CAST(l_suppkey % 10 AS STRING) END AS name,
  CAST(l_partkey % 300 AS DOUBLE) AS x, CAST(l_suppkey % 40 * 20 AS DOUBLE) AS y, CASE l_partkey % 17 WHEN 0 THEN CAST(0 AS DOUBLE) WHEN 1 THEN CAST(2 AS DOUBLE) WHEN 2 THEN CAST(1440 AS DOUBLE) ELSE l_quantity * 9 END AS w,
  CASE CASE WHEN l_partkey % 17 = 2 THEN 2 ELSE l_partkey % 19 END WHEN 0 THEN CAST(900 AS DOUBLE) WHEN 1 THEN CAST(1 AS DOUBLE) WHEN 2 THEN CAST(1200 AS DOUBLE) ELSE l_quantity * 3 END AS h, CASE WHEN l_suppkey % 3 = 0 THEN 'absolute' WHEN l_suppkey % 11 = 1 THEN 'fixed' WHEN l_suppkey % 11 <> 2 THEN 'relative' END AS position,
  CASE WHEN l_partkey % 2 = 0 THEN 'heading-' || CAST(l_suppkey % 2 AS STRING) ELSE 'body' END AS style_key, l_partkey % 4 = 0 AS filled, CASE WHEN l_suppkey % 2 = 0 THEN 0 ELSE 3 END AS children, l_orderkey % 4 AS stroke, l_orderkey % 5 AS insets, false AS overflow_visible
FROM {lineitem}
UNION ALL SELECT 'site-' || CAST(CAST(floor(o_orderkey / 64) AS BIGINT) AS STRING), o_orderkey, -o_orderkey, CAST(NULL AS BIGINT), CAST(0 AS BIGINT), 'Frame', 'board', CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(1440 AS DOUBLE), CAST(1200 AS DOUBLE), 'relative', 'none', true, 5, 0, 0, o_orderkey % 7 = 0 FROM {orders}
""")
G = lambda s, d: view(s, d, "gnodes")
KIDS = lambda s, d: G(s, d).filter("parent_id IS NOT NULL")


@query("node_defects", r"""
SELECT site, board, node_id, unnest(CASE WHEN w <= 0 OR h <= 0 THEN ['zero size'] ELSE list_filter([CASE WHEN w <= 2 AND h > 800 THEN 'hidden variant' END, CASE WHEN component = 'Frame' AND children = 0 AND NOT filled AND w > 40 AND h > 40 THEN CASE WHEN name = '01 · hero' THEN 'empty named section' ELSE 'empty frame' END END,
 CASE WHEN component = 'Rectangle' AND children = 0 AND NOT filled AND w >= 80 AND h >= 80 THEN 'empty image slot' WHEN name = 'Deferred-Image 2' AND component <> 'Image' AND children = 0 AND NOT filled AND w >= 8 AND h >= 8 THEN 'deferred image' END,
 CASE WHEN coalesce(position IN ('absolute', 'fixed'), false) AND children = 0 AND component <> 'Text' AND stroke BETWEEN 1 AND 2 AND w > 8 AND h > 8 AND (insets >= 3 OR w BETWEEN 1436 AND 1444 AND h BETWEEN 1196 AND 1204) THEN 'loose decoration' END], lambda k: k IS NOT NULL) END) AS kind FROM {gnodes}""")
def _(spark, d):
    return K.node_defects(G(spark, d))


@query("overflow", """
SELECT n.site, n.board, n.node_id, n.parent_id, greatest(n.x + n.w - 1440, CAST(0 AS DOUBLE)) AS right, greatest(n.y + n.h - 1200, CAST(0 AS DOUBLE)) AS down FROM {gnodes} n JOIN {gnodes} p ON p.node_id = n.parent_id WHERE NOT p.overflow_visible AND (n.x + n.w - 1440 > 2 OR n.y + n.h - 1200 > 2)""")
def _(spark, d):
    return K.overflow(G(spark, d))


@query("sibling_overlap", """
SELECT a.site, a.board, a.node_id AS a, b.node_id AS b, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) AS wide, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) AS tall FROM {gnodes} a JOIN {gnodes} b ON a.parent_id = b.parent_id AND a.node_id < b.node_id
WHERE coalesce(a.position, '') NOT IN ('absolute', 'fixed') AND coalesce(b.position, '') NOT IN ('absolute', 'fixed') AND a.w > 0 AND a.h > 0 AND b.w > 0 AND b.h > 0 AND least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) > 2 AND least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) > 2""")
def _(spark, d):
    return K.sibling_overlap(KIDS(spark, d))


@query("vertical_gaps", """
SELECT site, board, parent_id, prev, node_id, floor(y - before + 0.5::DOUBLE) AS gap FROM (SELECT *, lag(y + h) OVER w AS before, lag(node_id) OVER w AS prev FROM {gnodes} WHERE NOT coalesce(position IN ('absolute', 'fixed'), false) AND parent_id IS NOT NULL WINDOW w AS (PARTITION BY parent_id ORDER BY y, node_id)) t WHERE floor(y - before + 0.5::DOUBLE) > 240""")
def _(spark, d):
    return K.vertical_gaps(KIDS(spark, d))


@query("placement", """
SELECT site, board, node_id, unnest(list_filter([CASE WHEN yr = 1 AND y > 80 THEN 'space above first' END, CASE WHEN yr <> nr THEN 'out of order' END, CASE WHEN y - before > greatest(400, 1.15 * ph) THEN 'gap too large' END], lambda k: k IS NOT NULL)) AS kind FROM (
 SELECT *, row_number() OVER w AS yr, lag(y + h) OVER w AS before, lag(h) OVER w AS ph, row_number() OVER (PARTITION BY board ORDER BY name, node_id) AS nr FROM {gnodes} WHERE component = 'Frame' AND parent_id IS NOT NULL WINDOW w AS (PARTITION BY board ORDER BY y, node_id)) t""")
def _(spark, d):
    return K.placement(KIDS(spark, d).filter("component = 'Frame'"))


@query("overlay_order", """
WITH k AS (SELECT n.*, n.position IN ('absolute', 'fixed') AND n.component NOT IN ('Text', 'Image') AND n.filled AND n.children = 0 AND abs(n.w - 1440) <= 4 AND abs(n.h - 1200) <= 4 IS TRUE AS over FROM {gnodes} n WHERE parent_id IS NOT NULL),
s AS (SELECT *, min(ord) FILTER (component = 'Text') OVER w AS ft, max(ord) FILTER (over) OVER w AS lo, max((ord, node_id)) FILTER (component = 'Image') OVER w AS im FROM k WINDOW w AS (PARTITION BY parent_id)),
t AS (SELECT *, count(*) FILTER (NOT coalesce(over, false) AND (ord, node_id) <= im) OVER (PARTITION BY parent_id) AS target FROM s WHERE lo > ft)
SELECT site, board, node_id, ord, ft AS first_text, target FROM t WHERE over""")
def _(spark, d):
    return K.overlay_order(G(spark, d))


# stacks of lines three levels below a board: texts, rows that hold one, and what stands between them, by line and order number
define_view("hlines", "SELECT l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS n, min(l_partkey) AS p, min(l_suppkey) AS s FROM {lineitem} GROUP BY l_orderkey, l_linenumber")
define_view("hkids", r"""
SELECT o, n, o * 100 + n * 10 AS base, CASE WHEN o % 5 < 2 THEN 'row' WHEN s % 9 = 0 THEN 'image' WHEN s % 9 = 1 THEN 'decor' ELSE 'text' END AS kind, s % 13 = 0 AS extra, CASE WHEN o % 17 = 0 THEN 'Same' WHEN p % 6 = 0 THEN ', then ' || CAST(n AS STRING) ELSE 'Line  ' || CAST(n AS STRING) END AS said,
  CAST(p % 4 * 50 AS DOUBLE) AS x, CAST(CASE WHEN o % 19 = 0 THEN n * 10 WHEN o % 23 = 0 THEN n * 200 ELSE n * 80 END AS DOUBLE) AS y, CASE o % 3 WHEN 0 THEN 72.0 WHEN 1 THEN 20.0 ELSE 70.0 + s % 3 * 2 END AS size, CASE WHEN p % 11 = 0 THEN '400' ELSE '700' END AS weight, CASE WHEN o % 29 = 0 THEN 240.0 END AS mw
FROM {hlines}
""")
define_view("hnodes", r"""
SELECT 's' AS site, o AS board, node_id, parent_id, ord, component, name, text, x, y, w, h, size AS font_size, 'Face, serif' AS font_family, weight AS font_weight, mw AS max_width FROM (
 SELECT o, base + 1 AS node_id, -o * 10 - 3 AS parent_id, n AS ord, CASE kind WHEN 'row' THEN 'Frame' WHEN 'image' THEN 'Image' WHEN 'decor' THEN 'SVG' ELSE 'Text' END AS component, CASE kind WHEN 'decor' THEN 'swirl' ELSE 'copy' END AS name, CASE kind WHEN 'text' THEN said END AS text, x, y, 300.0 AS w, 72.0 AS h, CASE kind WHEN 'text' THEN size END AS size, CASE kind WHEN 'text' THEN weight END AS weight, mw FROM {hkids}
 UNION ALL SELECT o, base + 2, base + 1, CAST(0 AS BIGINT), 'Text', 'inner', said, x, y, 300.0, 72.0, size, weight, NULL FROM {hkids} WHERE kind = 'row'
 UNION ALL SELECT o, base + 3, base + 1, CAST(1 AS BIGINT), 'Image', 'extra', NULL, x, y, 10.0, 10.0, NULL, NULL, NULL FROM {hkids} WHERE kind = 'row' AND extra
 UNION ALL SELECT DISTINCT o, -o * 10 - 3, -o * 10 - 2, CAST(0 AS BIGINT), 'Frame', 'stack', NULL, 0.0, 0.0, 800.0, 900.0, NULL, NULL, NULL FROM {hkids}
 UNION ALL SELECT DISTINCT o, -o * 10 - 2, -o * 10 - 1, CAST(0 AS BIGINT), 'Frame', 'wrap', NULL, 0.0, 0.0, 800.0, 900.0, NULL, NULL, NULL FROM {hkids}
 UNION ALL SELECT DISTINCT o, -o * 10 - 1, CAST(NULL AS BIGINT), CAST(0 AS BIGINT), 'Frame', CASE WHEN o % 4 = 0 THEN 'Hero headline' ELSE 'band' END, NULL, 0.0, 0.0, 1440.0, 900.0, NULL, NULL, NULL FROM {hkids}) t
""")


@query("split_headings", r"""
WITH k AS (SELECT *, kind = 'text' AS t, kind = 'row' AND NOT extra AS r FROM {hkids}),
c AS (SELECT *, sum(CASE WHEN kind IN ('text', 'decor') THEN 0 ELSE 1 END) OVER w AS cut, sum(CASE WHEN r THEN 0 ELSE 1 END) OVER w AS gap, coalesce(lag(CASE WHEN r THEN size END) OVER w BETWEEN size - 4 AND size + 4 AND lag(CASE WHEN r THEN weight END) OVER w = weight, false) AS like_before FROM k WINDOW w AS (PARTITION BY o ORDER BY n)),
d AS (SELECT *, sum(CASE WHEN r AND like_before THEN 0 ELSE 1 END) OVER (PARTITION BY o ORDER BY n) AS st FROM c),
e AS (SELECT o, 'texts' AS kind, cut AS run, base + 1 AS line, n, y, size, weight, said, mw FROM d WHERE t UNION ALL SELECT o, 'rows', gap * 1000 + st, base + 2, n, y, size, weight, said, mw FROM d WHERE r),
f AS (SELECT o, kind, run, count(*) AS parts, list({'size': size, 'weight': weight, 'y': y, 'line': line, 'said': trim(regexp_replace(said, '\s+', ' ', 'g'))} ORDER BY n) AS l, max(size) AS top, max(mw) AS mw FROM e GROUP BY ALL HAVING count(*) >= 2)
SELECT 's' AS site, o AS board, -o * 10 - 3 AS parent_id, kind, parts, l[1].line AS first, l[-1].line AS last, trim(array_to_string(list_transform(l, lambda p: CASE WHEN p.said LIKE ',%' THEN p.said ELSE ' ' || p.said END), '')) AS text FROM f
WHERE len(list_filter(l, lambda p: abs(p.size - l[1].size) > 4 OR p.weight <> l[1].weight)) = 0 AND len(list_distinct(list_transform(l, lambda p: p.said))) > 1 AND mw IS NULL AND (o % 4 = 0 OR top >= 28)
  AND len(list_filter(list_zip(l[:-2], l[2:]), lambda z: z[2].y - z[1].y - 72 > 48 OR z[2].y - z[1].y < 28.8)) = 0""")
def _(spark, d):
    return K.split_headings(view(spark, d, "hnodes"))


DUCK_VIEWS["bars"] = "SELECT site, board, node_id FROM {gnodes} WHERE parent_id IS NOT NULL AND w >= 0.8 * 1440 AND h BETWEEN 32 AND 220 AND y <= 160"
DUCK_VIEWS["with_nav"] = "SELECT board FROM {gnodes} WHERE parent_id IS NOT NULL AND (name = 'site-chrome' OR name = 'Main menu' AND h BETWEEN 1 AND 220)"


@query("chrome_bars", "SELECT site, board, node_id, 'bar' AS kind FROM {bars} UNION ALL SELECT site, board, NULL, 'no navbar' FROM {gnodes} WHERE parent_id IS NULL AND board NOT IN (SELECT board FROM {with_nav})")
def _(spark, d):
    return K.chrome_bars(KIDS(spark, d), G(spark, d).filter("parent_id IS NULL"))


_SLUG = "CASE l_linenumber % 4 WHEN 0 THEN 'header' WHEN 1 THEN 'hero' WHEN 2 THEN 'faq' ELSE 'footer' END"
define_view("cap_sections", f"SELECT l_suppkey AS site, l_orderkey AS page, {_SLUG} AS slug, max(l_quantity) * 10 AS h, CAST(max(l_partkey % 5) AS BIGINT) AS words, max(l_partkey) % 9 = 0 AS blank FROM {{lineitem}} GROUP BY l_suppkey, l_orderkey, {_SLUG}")
define_view("can_sections", f"SELECT l_suppkey AS site, l_orderkey AS page, {_SLUG} AS slug, min(l_quantity) * 4 AS h, CAST(max(l_partkey % 3) AS BIGINT) AS children, max(l_partkey) % 8 = 0 AS hidden, CAST(max(l_partkey % 4) AS BIGINT) AS text_nodes, CAST(max(l_partkey % 2) AS BIGINT) AS words FROM {{lineitem}} WHERE l_partkey % 6 <> 0 GROUP BY l_suppkey, l_orderkey, {_SLUG}")
DUCK_VIEWS["lost"] = """
SELECT c.site, c.page, c.slug, unnest(list_filter([CASE WHEN k.h IS NULL THEN CASE WHEN c.slug IN ('header', 'footer') THEN 'missing chrome' ELSE 'missing section' END END, CASE WHEN k.children = 0 THEN 'empty section' END, CASE WHEN k.hidden THEN 'hidden stack' END,
 CASE WHEN k.text_nodes > 0 AND k.words = 0 AND c.words > 0 THEN 'dead text' END, CASE WHEN k.children = 0 AND k.h < 0.4 * c.h THEN 'hollow section' END, CASE WHEN c.blank THEN 'blank source' END], lambda x: x IS NOT NULL)) AS kind
FROM {cap_sections} c LEFT JOIN {can_sections} k ON k.site = c.site AND k.page = c.page AND k.slug = c.slug"""


def lost(spark, d):
    return K.missing_elements(view(spark, d, "cap_sections"), view(spark, d, "can_sections"))


@query("missing_elements", "SELECT * FROM {lost}")
def _(spark, d):
    return lost(spark, d)


DUCK_VIEWS["ranked"] = """
SELECT site, row_number() OVER (PARTITION BY site ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, pos, kind, section, symptom) AS id, kind, section, symptom, severity, CASE WHEN kind = 'dead text' AND section = 'faq' THEN 'applied' ELSE 'open' END AS status FROM (
 SELECT *, CASE WHEN kind IN ('missing chrome', 'missing section', 'empty section', 'hollow section', 'dead text') THEN 'high' WHEN kind = 'blank source' THEN 'low' ELSE 'medium' END AS severity FROM (
  SELECT site, page AS pos, kind, slug AS section, 'p' || CAST(page % 4 AS VARCHAR) AS symptom FROM {lost} QUALIFY row_number() OVER (PARTITION BY site, kind, slug, page % 4 ORDER BY page) = 1) a) b"""


def ranked(spark, d):
    f = lost(spark, d).select("site", F.col("page").alias("pos"), "kind", F.col("slug").alias("section"), F.concat(F.lit("p"), (F.col("page") % 4).cast("string")).alias("symptom"))
    # order keys must be unique: the section breaks the remaining ties
    return K.rank_findings(f.withColumn("pos", F.col("pos")), f.filter("kind = 'dead text' AND section = 'faq'"))


@query("rank_findings", "SELECT * FROM {ranked}")
def _(spark, d):
    return ranked(spark, d)


@query("severity_counts", "SELECT site, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (status = 'applied') AS applied FROM {ranked} GROUP BY site")
def _(spark, d):
    return K.severity_counts(ranked(spark, d))


define_view("supplier_boards", "SELECT 0 AS site, l_suppkey AS family, CAST(l_linenumber AS BIGINT) * 320 AS width, l_partkey % 5 AS section, max(l_partkey % 60) AS images FROM {lineitem} GROUP BY l_suppkey, l_linenumber, l_partkey % 5")


@query("breakpoint_image_gaps", "SELECT b.site, b.family, b.section, b.width, b.images, t.images AS wanted FROM {supplier_boards} b JOIN {supplier_boards} t ON t.family = b.family AND t.section = b.section AND t.width = (SELECT max(width) FROM {supplier_boards} m WHERE m.family = b.family) WHERE b.width < t.width AND b.images < t.images")
def _(spark, d):
    return K.breakpoint_image_gaps(view(spark, d, "supplier_boards"))
