"""Registered component and interaction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiltlens.operators import components as I
from quiltlens.operators.elements import page_elements
from quiltlens.plans.registry import DUCK_VIEWS, define_view, query, view
from quiltlens.sources.corpus import page_corpus

# a node of ordinal n hangs under the node of ordinal 1 of its own board, or under the board
define_view("cnodes", "SELECT site, l_board AS board, node_id, CASE WHEN par = 0 THEN -l_board ELSE NULL END AS parent_id, ord, component, name, w, h, style_key FROM (SELECT site, board AS l_board, node_id, CASE WHEN parent_id IS NULL THEN 1 ELSE 0 END AS par, ord, component, name, CASE WHEN parent_id IS NULL THEN 1440 + 0 * w ELSE floor(w / 40) * 40 + 20 END AS w, floor(h / 60) * 60 + 8 AS h, style_key FROM {gnodes}) t")
define_view("cboards", "SELECT site, board, node_id, parent_id, ord, component, name, CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h, style_key FROM {cnodes}")
_B = "(CAST(floor({h} / 8 + 0.5) AS BIGINT) * 8)"
DUCK_VIEWS["signed"] = f"""
WITH k AS (SELECT site, parent_id AS node_id, count(*) AS kids, sum(CAST('0x' || substr(md5(CAST(place AS VARCHAR) || '/' || shape), 1, 15) AS BIGINT)) || ':' || sum(CAST('0x' || substr(md5(CAST(place AS VARCHAR) || '/' || shape), 16, 15) AS BIGINT)) AS kp FROM (
  SELECT *, component || ':h' || CAST({_B.replace('{h}', 'h')} AS VARCHAR) AS shape, row_number() OVER (PARTITION BY parent_id ORDER BY ord, node_id) AS place FROM {{cboards}} WHERE parent_id IS NOT NULL) t GROUP BY ALL)
SELECT n.site, n.board, n.node_id, n.name, n.w, n.h, coalesce(kids, 0) AS kids, n.component || '|h' || CAST({_B.replace('{h}', 'n.h')} AS VARCHAR) || '|k' || CAST(coalesce(kids, 0) AS VARCHAR) || '|' || style_key || '|' || coalesce(kp, '') AS signature
FROM {{cboards}} n LEFT JOIN k ON k.node_id = n.node_id WHERE n.w >= 24 AND n.h >= 12"""
DUCK_VIEWS["comps"] = """
SELECT site, signature, CASE WHEN w >= 1400 AND pages >= 2 THEN 'organism' WHEN kids = 0 THEN 'atom' WHEN kids <= 4 AND h < 400 THEN 'molecule' ELSE 'organism' END AS level, instances, pages, width_variants, round(w) AS width, round(h) AS height, node_id AS example FROM (
 SELECT s.*, c.instances, c.pages, c.width_variants, row_number() OVER (PARTITION BY s.site, s.signature ORDER BY w, node_id) AS r FROM {signed} s JOIN (SELECT site, signature, count(*) AS instances, count(DISTINCT board) AS pages, count(DISTINCT round(w)) AS width_variants FROM {signed} GROUP BY ALL HAVING count(*) >= 2) c ON c.site = s.site AND c.signature = s.signature) t WHERE r = instances // 2 + 1"""


DUCK_VIEWS["cov_pages"] = "SELECT k.site, p.html FROM {audit_html} p JOIN {corpus_keys} k USING (page_id)"


def signed(spark, d):
    return I.role_signatures(view(spark, d, "cboards"))


@query("role_signatures", "SELECT * FROM {signed}")
def _(spark, d):
    return signed(spark, d)


@query("components", "SELECT * FROM {comps}")
def _(spark, d):
    return I.components(signed(spark, d))


@query("shared_vs_local", """
SELECT site, signature, level, instances, scope, rank FROM (SELECT *, row_number() OVER (PARTITION BY site, level, scope ORDER BY instances DESC, pages DESC, signature) AS rank FROM (SELECT *, CASE WHEN level = 'organism' AND pages >= 3 THEN 'shared' WHEN pages <= 2 THEN 'local' END AS scope FROM {comps}) a WHERE scope IS NOT NULL) b WHERE rank <= 5""")
def _(spark, d):
    return I.shared_vs_local(I.components(signed(spark, d)), 5).select("site", "signature", "level", "instances", "scope", "rank")


# blocks and controls set by page number: named by a comment, by their markup, by a library token, by a nomination, or not at all
define_view("control_pages", r"""
SELECT page_id, url, replace(html, '<article>', CASE WHEN page_id % 3 = 0 THEN '<header><a class="pill" href="/">In chrome</a><!-- component: lost --><div>x</div></header>' ELSE '' END ||
  CASE page_id % 8 WHEN 0 THEN '<!-- component: promo-box --><div class="a"><a class="btn-primary pill" href="#">Go</a></div>' WHEN 1 THEN '<button class="x" data-component="Play button">Play</button><a class="navbar-link" href="#">n</a>'
    WHEN 2 THEN '<!-- @reusable Hero --> <!-- aside --><img src="/i/x.png">' WHEN 3 THEN '<a class="hero card-link" href="#">Link</a><button id="hero">b</button>' WHEN 4 THEN '<a class="unknown" href="#">none</a><a class="text-link">t</a>'
    WHEN 5 THEN '<!-- extract: Quote --><section><button class="btn-accent">q</button></section><button class="pill text-link btn-accent">w</button>' WHEN 6 THEN '<button data-component="once">open' ELSE '<!-- component lone words here --><p>z</p>' END || '<article>') AS html
FROM {pages}
""")
DUCK_VIEWS["control_hits"] = """
WITH k AS (SELECT k.site, p.page_id, p.page_id % 8 AS m, p.page_id % 3 AS h, length(k.site) % 2 = 0 AS nom, len(regexp_extract_all(p.html, '<article>')) AS n, unnest(range(len(regexp_extract_all(p.html, '<article>')))) AS o FROM {pages} p JOIN {corpus_keys} k USING (page_id)),
f AS (SELECT k.site, p.page_id, unnest(range(len(regexp_extract_all(p.html, '(?i)<footer\\b')))) AS o FROM {pages} p JOIN {corpus_keys} k USING (page_id))
SELECT site, page_id, 'Header' AS name, 'header' AS tag, 'chrome' AS why FROM k WHERE h = 0
UNION ALL SELECT site, page_id, 'Footer', 'footer', 'chrome' FROM f
UNION ALL SELECT site, page_id, 'PromoBox', 'div', 'comment' FROM k WHERE m = 0
UNION ALL SELECT site, page_id, 'BtnPrimary', 'a', 'nominated' FROM k WHERE m = 0
UNION ALL SELECT site, page_id, 'PlayButton', 'button', 'backed' FROM k WHERE m = 1
UNION ALL SELECT site, page_id, 'Hero', 'button', 'nominated' FROM k WHERE m = 3 AND nom
UNION ALL SELECT site, page_id, 'CardLink', 'a', 'nominated' FROM k WHERE m = 3
UNION ALL SELECT site, page_id, 'TextLink', 'a', 'nominated' FROM k WHERE m = 4
UNION ALL SELECT site, page_id, 'Quote', 'section', 'comment' FROM k WHERE m = 5
UNION ALL SELECT site, page_id, 'BtnAccent', 'button', 'nominated' FROM k WHERE m = 5
UNION ALL SELECT site, page_id, 'BtnAccent', 'button', 'nominated' FROM k WHERE m = 5"""


@query("component_census", """
SELECT site, name, min(tag) FILTER (first) AS tag, count(*) AS uses, count(DISTINCT page_id) AS pages, min(why) AS reason, true AS extract
FROM (SELECT *, page_id = min(page_id) OVER (PARTITION BY site, name) AS first FROM {control_hits}) t GROUP BY site, name""")
def _(spark, d):
    p = page_elements(page_corpus(view(spark, d, "control_pages")))
    sites = p.select("site").distinct()
    return I.component_census(p, sites.filter(F.length("site") % 2 == 0).withColumn("name", F.lit("Hero")), sites.withColumn("name", F.lit("Card Link")))


@query("class_coverage", r"""
WITH c AS (SELECT site, unnest(string_split_regex(trim(cl), '\s+')) AS class FROM (SELECT site, unnest(regexp_extract_all(html, '(?is)\sclass\s*=\s*["'']([^"'']*)["'']', 1)) AS cl FROM {cov_pages}) a), h AS (SELECT site, class, count(*) AS hits FROM c GROUP BY ALL)
SELECT s.site, l.class, l.minimum, coalesce(hits, 0) AS hits, coalesce(hits, 0) >= minimum AS ok FROM (SELECT DISTINCT site FROM {cov_pages}) s, (VALUES ('card', CAST(1 AS BIGINT)), ('grid', 2), ('tile', 1)) l(class, minimum) LEFT JOIN h ON h.site = s.site AND h.class = l.class""")
def _(spark, d):
    return I.class_coverage(page_corpus(view(spark, d, "audit_html")), {"card": 1, "grid": 2, "tile": 1})


# rules, controls and buttons of a site, from its suppliers' lines
define_view("hover_rules", "SELECT DISTINCT l_suppkey AS site, l_partkey AS pos, CASE l_partkey % 6 WHEN 0 THEN '.btn:hover' WHEN 1 THEN 'a.btn.big:hover' WHEN 2 THEN '#go:hover' WHEN 3 THEN 'nav .btn:hover' WHEN 4 THEN 'a:hover' ELSE 'button.pill:hover' END AS selector, CASE l_partkey % 4 WHEN 0 THEN 'color' WHEN 1 THEN 'background-color' WHEN 2 THEN 'cursor' ELSE 'opacity' END AS prop, 'v' || CAST(l_partkey AS STRING) AS value FROM {lineitem} WHERE l_quantity < 25")
define_view("hover_controls", "SELECT DISTINCT l_suppkey AS site, l_partkey AS control, CASE WHEN l_partkey % 2 = 0 THEN 'a' ELSE 'button' END AS tag, CASE WHEN l_partkey % 9 = 0 THEN 'go' ELSE '' END AS id, CASE l_partkey % 5 WHEN 0 THEN 'btn' WHEN 1 THEN 'btn big' WHEN 2 THEN 'pill' WHEN 3 THEN 'big btn x' ELSE 'plain' END AS class_text, CASE WHEN l_partkey % 3 = 0 THEN 'Buy ' || CAST(l_partkey % 40 AS STRING) ELSE 'Go to ' || CAST(l_partkey % 90 AS STRING) END AS text FROM {lineitem}")
define_view("hover_buttons", "SELECT DISTINCT l_suppkey AS site, l_orderkey AS button, CASE l_orderkey % 3 WHEN 0 THEN 'Button - buy  ' || CAST(l_orderkey % 50 AS STRING) WHEN 1 THEN 'to ' || CAST(l_orderkey % 30 AS STRING) ELSE 'please Buy ' || CAST(l_orderkey % 60 AS STRING) || ' now' END AS label FROM {lineitem}")


@query("hover_recipes", r"""
WITH c AS (SELECT *, string_split(class_text, ' ') AS cl, lower(text) AS k FROM {hover_controls}),
m AS (SELECT c.site, c.control, r.prop, arg_max(r.value, r.pos) AS value FROM c JOIN {hover_rules} r ON r.site = c.site WHERE CASE r.selector WHEN '.btn:hover' THEN list_contains(cl, 'btn') WHEN 'a.btn.big:hover' THEN tag = 'a' AND list_contains(cl, 'btn') AND list_contains(cl, 'big') WHEN '#go:hover' THEN id = 'go' WHEN 'button.pill:hover' THEN tag = 'button' AND list_contains(cl, 'pill') ELSE false END GROUP BY ALL),
p AS (SELECT site, control, bool_or(prop <> 'cursor') AS paint, string_agg(prop || ':' || value, ';' ORDER BY prop || ':' || value) AS recipe FROM m GROUP BY ALL),
b AS (SELECT *, lower(trim(regexp_replace(regexp_replace(label, '(?i)^(primary|secondary|ghost|outline|button|cta|pill|nav|link)\s*[-–—:]\s*', ''), '\s+', ' ', 'g'))) AS k FROM {hover_buttons}),
ex AS (SELECT b.site, b.button, min(c.control) AS control FROM b JOIN c ON c.site = b.site AND c.k = b.k GROUP BY ALL),
lo AS (SELECT b.site, b.button, min(c.control) AS control FROM b JOIN c ON c.site = b.site AND (contains(c.k, b.k) OR contains(b.k, c.k)) GROUP BY ALL),
j AS (SELECT b.site, b.button, coalesce(ex.control, lo.control) AS control FROM b LEFT JOIN ex ON ex.site = b.site AND ex.button = b.button LEFT JOIN lo ON lo.site = b.site AND lo.button = b.button)
SELECT j.site, j.button, j.control, CASE WHEN j.control IS NULL THEN 'no control' WHEN coalesce(paint, false) THEN 'applied' ELSE 'no hover paint' END AS status, CASE WHEN paint THEN recipe END AS recipe FROM j LEFT JOIN p ON p.site = j.site AND p.control = j.control""")
def _(spark, d):
    c = view(spark, d, "hover_controls").withColumn("classes", F.split("class_text", " ")).drop("class_text")
    return I.hover_recipes(view(spark, d, "hover_rules"), c, view(spark, d, "hover_buttons"))


@query("style_delta", """
SELECT *, row_number() OVER (PARTITION BY site, state ORDER BY node, prop) AS rank FROM (SELECT coalesce(b.site, a.site) AS site, coalesce(b.board, a.board) AS state, coalesce(b.node_id, a.node_id) AS node, coalesce(b.prop, a.prop) AS prop, b.value AS "from", a.value AS "to"
 FROM {geo_before} b FULL JOIN {geo_after} a ON a.site = b.site AND a.board = b.board AND a.node_id = b.node_id AND a.prop = b.prop WHERE b.value IS DISTINCT FROM a.value) t QUALIFY row_number() OVER (PARTITION BY site, state ORDER BY node, prop) <= 24""")
def _(spark, d):
    f = lambda v: view(spark, d, v).select("site", F.col("board").alias("state"), F.col("node_id").alias("node"), "prop", "value")
    return I.style_delta(f("geo_before"), f("geo_after"))


define_view("ix_states", r"""
SELECT l_suppkey AS site, (l_orderkey * 100000 + l_partkey) * 10 + l_linenumber AS pos, CASE l_linenumber % 5 WHEN 0 THEN 'nav' WHEN 1 THEN 'Buttons' WHEN 2 THEN 'footer' WHEN 3 THEN 'forms' ELSE 'misc' END AS kind, CASE WHEN l_partkey % 2 = 0 THEN 'Submit ' ELSE 'Card Box' END AS component,
  l_quantity * 2 AS height, CASE l_partkey % 5 WHEN 0 THEN '#FFD34D' WHEN 1 THEN '#6A3DE8' WHEN 2 THEN '#FFFFFF' WHEN 3 THEN '#101010' ELSE 'none' END AS background, CASE l_suppkey % 4 WHEN 0 THEN 'color,transform' WHEN 1 THEN 'background-color' WHEN 2 THEN 'color' ELSE 'cursor' END AS prop_text, l_partkey % 3 = 0 AS changed FROM {lineitem}
""")


@query("state_patterns", r"""
WITH a AS (SELECT site, pos, lower(kind) AS kind, component, CASE WHEN height <= 24 THEN 'text' WHEN height <= 42 THEN 'chip' WHEN height <= 72 THEN 'cta' ELSE 'block' END AS band, CASE background WHEN '#FFD34D' THEN 'accent' WHEN '#6A3DE8' THEN 'brand' WHEN '#FFFFFF' THEN 'light' WHEN '#101010' THEN 'dark' ELSE 'transparent' END AS paint,
 CASE WHEN prop_text LIKE '%transform%' THEN 'rotate' WHEN prop_text = 'background-color' THEN 'fill' WHEN prop_text = 'color' THEN 'color' WHEN NOT changed THEN 'none' ELSE 'other' END AS hover FROM {ix_states}),
b AS (SELECT *, kind || '|' || band || '|' || paint || '|' || hover AS pattern, CASE kind WHEN 'nav' THEN CASE WHEN hover = 'rotate' THEN 'navbar-dropdown' ELSE 'navbar-link' END WHEN 'footer' THEN 'footer-link' WHEN 'forms' THEN CASE WHEN component LIKE 'Submit%' THEN 'btn-primary' ELSE 'form-control' END
 WHEN 'buttons' THEN CASE WHEN band = 'text' AND paint = 'transparent' THEN 'text-link' WHEN band = 'chip' THEN 'pill' WHEN paint = 'accent' THEN 'btn-accent' WHEN paint = 'brand' THEN 'btn-brand' WHEN paint = 'light' THEN 'btn-secondary' WHEN paint = 'dark' THEN 'btn-primary' ELSE 'btn-ghost' END ELSE CASE WHEN component LIKE 'Submit%' THEN 'submit' ELSE 'card-box' END END AS base FROM a),
g AS (SELECT site, pattern, arg_min(base, pos) AS base, min(pos) AS first, count(*) AS states FROM b GROUP BY site, pattern)
SELECT site, pattern, base || CASE WHEN row_number() OVER (PARTITION BY site, base ORDER BY first) > 1 THEN '-' || row_number() OVER (PARTITION BY site, base ORDER BY first) ELSE '' END AS token, first, states FROM g""")
def _(spark, d):
    return I.state_patterns(view(spark, d, "ix_states").withColumn("props", F.split("prop_text", ",")).drop("prop_text"))


define_view("rep_states", r"SELECT l_suppkey AS site, CAST(l_linenumber AS BIGINT) AS section, (l_orderkey * 100000 + l_partkey) * 10 + l_linenumber AS pos, 'tok' || CAST(l_partkey % 6 AS STRING) AS token, CASE WHEN l_partkey % 4 = 0 THEN '' ELSE '0' || CAST(l_partkey % 3 AS STRING) || ' · Label  ' || CAST(l_partkey % 4 AS STRING) END AS label, l_quantity > 25 AS visible, l_quantity AS x FROM {lineitem}")


@query("representative_states", r"""
WITH a AS (SELECT *, trim(regexp_replace(regexp_replace(lower(label), '^[0-9][0-9]\s*·\s*', ''), '\s+', ' ', 'g')) AS k FROM {rep_states}), o AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY site, section, token ORDER BY NOT visible, x, pos) = 1)
SELECT site, section, pos, token, label, visible, x FROM o QUALIFY k = '' OR row_number() OVER (PARTITION BY site, section, k ORDER BY NOT visible, x, pos) = 1""")
def _(spark, d):
    return I.representative_states(view(spark, d, "rep_states"))


define_view("rects", "SELECT DISTINCT l_suppkey AS site, l_partkey AS page, l_orderkey AS rect, l_quantity * 30 AS y, l_quantity * 4 AS h FROM {lineitem}")
define_view("rect_sections", "SELECT l_suppkey AS site, l_partkey AS page, l_orderkey AS pos, 's' || CAST(l_orderkey AS STRING) AS section, min(l_quantity) * 25 AS y, CAST(300 AS DOUBLE) AS h FROM {lineitem} WHERE l_partkey % 3 <> 0 GROUP BY l_suppkey, l_partkey, l_orderkey")


@query("section_of_rect", """
SELECT r.site, r.page, r.rect, b.section, b.overlap FROM {rects} r LEFT JOIN (SELECT r.site, r.page, r.rect, s.section, least(r.y + r.h, s.y + s.h) - greatest(r.y, s.y) AS overlap FROM {rects} r JOIN {rect_sections} s ON s.site = r.site AND s.page = r.page AND least(r.y + r.h, s.y + s.h) > greatest(r.y, s.y)
 QUALIFY row_number() OVER (PARTITION BY r.site, r.page, r.rect ORDER BY least(r.y + r.h, s.y + s.h) - greatest(r.y, s.y) DESC, s.pos) = 1) b ON b.site = r.site AND b.page = r.page AND b.rect = r.rect""")
def _(spark, d):
    r = view(spark, d, "rects").groupBy("site", "page", "rect").agg(F.min("y").alias("y"), F.min("h").alias("h"))
    return I.section_of_rect(r, view(spark, d, "rect_sections"))


@query("missing_hover_states", "SELECT site, section, count(*) AS expected FROM {rep_states} e WHERE NOT EXISTS (SELECT 1 FROM {rep_states} t WHERE t.site = e.site AND t.section = e.section AND t.visible AND t.x > 49) GROUP BY ALL")
def _(spark, d):
    s = view(spark, d, "rep_states")
    return I.missing_hover_states(s, s.filter("visible AND x > 49"))
