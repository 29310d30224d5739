"""Registered design-token queries over styled nodes derived from order lines and stylesheets derived from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiltlens.operators import tokens as H
from quiltlens.plans.registry import DUCK_VIEWS, define_view, query, view
from quiltlens.session import materialize

define_view("snodes", r"""
SELECT 'site-' || CAST(CAST(floor(l_orderkey / 64) AS BIGINT) AS STRING) AS site, l_orderkey AS board,
  ((l_orderkey * 100000 + l_partkey) * 10 + l_linenumber) * 1000 + l_suppkey % 1000 AS node_id, 'layer ' || CAST(l_linenumber AS STRING) AS name,
  printf('#%02X%02X%02X', l_partkey % 5 * 60 + l_suppkey % 3 * 3, l_partkey % 3 * 100, l_suppkey % 2 * 200 + l_linenumber % 2 * 2) || CASE WHEN l_partkey % 11 = 0 THEN '1A' ELSE '' END AS fill,
  CASE l_suppkey % 6 WHEN 0 THEN '#333333' WHEN 1 THEN '#E11D2E' WHEN 2 THEN 'rgb(102, 102, 102)' WHEN 3 THEN '#111' WHEN 4 THEN '#6B7281' ELSE '#FFFFFF' END AS ink,
  CASE l_partkey % 6 WHEN 0 THEN 'Inter, sans-serif' WHEN 1 THEN 'Inter-Bold' WHEN 2 THEN 'Georgia, serif' WHEN 3 THEN 'sans-serif' WHEN 4 THEN '"Fira Code", monospace' ELSE 'var(--font-sans)' END AS family,
  CAST(l_linenumber % 7 * 100 + 100 AS STRING) AS weight, CASE l_partkey % 4 WHEN 0 THEN 'italic' WHEN 1 THEN 'Normal' ELSE 'normal' END AS style,
  CAST(CAST(l_quantity AS BIGINT) + 6 AS STRING) || 'px' AS size, CAST(l_linenumber % 4 * 4 + 16 AS STRING) || 'px' AS lead, CASE l_partkey % 3 WHEN 0 THEN '-0.8px' WHEN 1 THEN '0.02em' ELSE 'normal' END AS track
FROM {lineitem}
""")
PROPS = [("backgroundColor", "color", "fill", "fill"), ("color", "color", "text", "ink"), ("fontFamily", "fontFamily", "family", "family"),
         ("fontWeight", "fontWeight", "weight", "weight"), ("fontStyle", "fontStyle", "style", "style"), ("fontSize", "fontSize", "size", "size")]
define_view("styles", "\nUNION ALL ".join(f"SELECT site, board, node_id, name, '{p}' AS prop, '{t}' AS type, '{k}' AS kind, {c} AS value FROM {{snodes}}" for p, t, k, c in PROPS))
DUCK_VIEWS["counts"] = "SELECT site, kind, value, count(*) AS uses FROM {styles} GROUP BY ALL"
_CH = lambda v, i: f"CAST(concat('0x', substr({v}, {i}, 2)) AS INTEGER)"
DUCK_VIEWS["fill_c"] = f"SELECT *, {_CH('value', 2)} AS r, {_CH('value', 4)} AS g, {_CH('value', 6)} AS b, CASE WHEN length(value) = 9 THEN {_CH('value', 8)} ELSE 255 END AS al, row_number() OVER (PARTITION BY site ORDER BY uses DESC, value) AS rk FROM {{counts}} WHERE kind = 'fill'"
# the greedy merge, one rank at a time, kept colours carried as a list
DUCK_VIEWS["greedy"] = r"""
SELECT site, into_v AS value, uses, CASE WHEN into_v <> value THEN 1 ELSE 0 END AS absorbed FROM (
  WITH RECURSIVE g AS (
    SELECT site, rk, value, uses, value AS into_v, [{'v': value, 'r': r, 'g': g, 'b': b, 'al': al}] AS kept FROM {fill_c} WHERE rk = 1
    UNION ALL
    SELECT c.site, c.rk, c.value, c.uses, coalesce(h.hit, c.value), CASE WHEN h.hit IS NULL THEN list_append(g.kept, {'v': c.value, 'r': c.r, 'g': c.g, 'b': c.b, 'al': c.al}) ELSE g.kept END
    FROM g JOIN {fill_c} c ON c.site = g.site AND c.rk = g.rk + 1, LATERAL (SELECT list_filter(g.kept, lambda k: abs(k.r - c.r) + abs(k.g - c.g) + abs(k.b - c.b) + abs(k.al - c.al) <= 12)[1].v AS hit) h)
  SELECT * FROM g) t"""
DUCK_VIEWS["merged"] = "SELECT site, value, CAST(sum(uses) AS BIGINT) AS uses, CAST(sum(absorbed) AS BIGINT) AS merged FROM {greedy} GROUP BY ALL"


def styles(spark, d):
    return view(spark, d, "styles")


def counts(spark, d):
    """Uses of each value per site, from one pass over the nodes."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for _, _, k, c in PROPS])
    return view(spark, d, "snodes").select("site", F.inline(each)).groupBy("site", "kind", "value").agg(F.count("*").alias("uses"))


def mined(spark, d):
    """``counts`` written once, for queries that read them several times."""
    return materialize(counts(spark, d), "style-counts")


def merged(uses):
    return H.merge_near_colors(uses.filter("kind = 'fill'"))


@query("tally", """
SELECT c.site, c.kind, c.value, c.uses, e.examples FROM {counts} c JOIN (
  SELECT site, kind, value, string_agg(name, '|' ORDER BY node_id) AS examples FROM (SELECT * FROM {styles} QUALIFY row_number() OVER (PARTITION BY site, kind, value ORDER BY node_id) <= 4) t GROUP BY ALL) e
ON e.site = c.site AND e.kind = c.kind AND e.value = c.value WHERE uses >= 3""")
def _(spark, d):
    return H.tally(styles(spark, d))


@query("merge_near_colors", "SELECT * FROM {merged}")
def _(spark, d):
    return merged(counts(spark, d))


DUCK_VIEWS["brand"] = rf"""
SELECT site, 'color' AS type, '--color-' || role || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS name, value, uses, 'mined' AS source FROM (
  SELECT *, row_number() OVER (PARTITION BY site, role ORDER BY alpha, rank) AS n FROM (
    SELECT *, CASE WHEN alpha = 1 THEN CASE WHEN s >= 0.35 THEN 'accent-soft' WHEN l >= 0.75 THEN 'subtle' ELSE 'wash' END WHEN l >= 0.93 THEN 'surface' WHEN l <= 0.18 THEN 'ink' WHEN s >= 0.35 THEN 'accent' WHEN l >= 0.75 THEN 'subtle' ELSE 'neutral' END AS role FROM (
      SELECT *, (CAST(0.2126 AS DOUBLE) * r + CAST(0.7152 AS DOUBLE) * g + CAST(0.0722 AS DOUBLE) * b) / 255 AS l, CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) END AS s, CASE WHEN al < 255 THEN 1 ELSE 0 END AS alpha FROM (
        SELECT m.site, m.value, m.uses, f.r, f.g, f.b, f.al, row_number() OVER (PARTITION BY m.site ORDER BY m.uses DESC, m.value) AS rank FROM {{merged}} m JOIN {{fill_c}} f ON f.site = m.site AND f.value = m.value) a WHERE rank <= 8) b) c) d"""


def brand(uses):
    return H.color_roles(merged(uses), 8)


@query("color_roles", "SELECT * FROM {brand}")
def _(spark, d):
    return brand(counts(spark, d))


# the same pool with its colours written out, as text inks repeat six values only
DUCK_VIEWS["semantic"] = r"""
WITH pool AS (SELECT c.site, c.kind, c.value, c.uses, f.r, f.g, f.b, f.al FROM {counts} c JOIN {fill_c} f ON f.site = c.site AND f.value = c.value WHERE c.kind = 'fill'
  UNION ALL SELECT c.site, c.kind, c.value, c.uses, x.r, x.g, x.b, 255 FROM {counts} c JOIN (VALUES ('#333333', 51, 51, 51), ('#E11D2E', 225, 29, 46), ('rgb(102, 102, 102)', 102, 102, 102), ('#111', 17, 17, 17), ('#6B7281', 107, 114, 129), ('#FFFFFF', 255, 255, 255)) x(v, r, g, b) ON x.v = c.value WHERE c.kind = 'text'),
br AS (SELECT b.site, b.name, f.r, f.g, f.b, f.al FROM {brand} b JOIN {fill_c} f ON f.site = b.site AND f.value = b.value),
fr AS (SELECT * FROM pool p WHERE NOT EXISTS (SELECT 1 FROM br WHERE br.site = p.site AND CASE WHEN p.al = 255 THEN br.al = 255 AND abs(br.r - p.r) + abs(br.g - p.g) + abs(br.b - p.b) <= 4 ELSE abs(br.r - p.r) + abs(br.g - p.g) + abs(br.b - p.b) + abs(br.al - p.al) <= 4 END)),
tg AS (SELECT * FROM (VALUES ('--color-surface-alt','fill','FBFBFB'),('--color-surface-muted','fill','F2F2F2'),('--color-danger','any','E11D2E'),('--color-danger','any','EF4444'),('--color-danger','any','DC2626'),('--color-warning','any','F59E0B'),('--color-warning','any','FBBF24'),('--color-warning','any','D97706'),
 ('--color-success','any','22C55E'),('--color-success','any','16A34A'),('--color-success','any','10B981'),('--color-info','any','3B82F6'),('--color-info','any','2563EB'),('--color-info','any','0EA5E9'),('--color-muted','any','6B7280'),('--color-muted','any','737373'),('--color-muted','any','9CA3AF'),('--color-text-subtle','text','999999'),('--color-text-secondary','text','666666'),('--color-overlay','fill','1D2B19'),('ink-a','any','333333'),('ink-b','any','111111')) t(role, pool, hex)),
tc AS (SELECT *, CAST('0x' || substr(hex, 1, 2) AS INTEGER) AS tr, CAST('0x' || substr(hex, 3, 2) AS INTEGER) AS tgr, CAST('0x' || substr(hex, 5, 2) AS INTEGER) AS tb FROM tg),
h AS (SELECT fr.*, role, abs(r - tr) + abs(g - tgr) + abs(b - tb) AS dd FROM fr JOIN tc ON tc.pool = 'any' OR tc.pool = fr.kind WHERE abs(r - tr) + abs(g - tgr) + abs(b - tb) <= 12),
bs AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY site, role ORDER BY dd - CASE WHEN role = '--color-overlay' AND al < 255 THEN 0.5 ELSE 0 END, uses DESC, value) = 1),
ik AS (SELECT * FROM bs WHERE role LIKE 'ink-%' QUALIFY row_number() OVER (PARTITION BY site, value ORDER BY role) = 1)
SELECT site, 'color' AS type, role AS name, value, uses, 'semantic' AS source FROM bs WHERE role NOT LIKE 'ink-%'
UNION ALL SELECT site, 'color', CASE WHEN row_number() OVER (PARTITION BY site ORDER BY r DESC) = 1 THEN '--color-ink-soft' ELSE '--color-ink-strong' END, value, uses, 'semantic' FROM ik"""


def semantic(uses, named):
    return H.semantic_roles(uses.filter("kind IN ('fill', 'text')"), named)


@query("semantic_roles", "SELECT * FROM {semantic}")
def _(spark, d):
    uses = mined(spark, d)
    return semantic(uses, brand(uses))


DUCK_VIEWS["families"] = r"""
WITH f AS (SELECT *, CASE value WHEN 'Inter, sans-serif' THEN 'Inter' WHEN 'Inter-Bold' THEN 'Inter' WHEN 'Georgia, serif' THEN 'Georgia' WHEN 'sans-serif' THEN 'sans-serif' ELSE 'Fira Code' END AS base FROM {counts} WHERE kind = 'family' AND value NOT LIKE 'var(%'),
r AS (SELECT *, CASE WHEN base = 'Fira Code' THEN 'mono' WHEN base IN ('Georgia', 'sans-serif') THEN 'serif' ELSE 'sans' END AS role FROM f),
a AS (SELECT site, role, lower(base) AS k, CAST(sum(uses) AS BIGINT) AS uses, arg_max(value, (uses, value)) AS value FROM r GROUP BY site, role, lower(base)),
c AS (SELECT *, bool_or(k <> 'sans-serif') OVER (PARTITION BY site, role) AS con FROM a),
t AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY uses DESC, role, k) AS rk FROM c WHERE k <> 'sans-serif' OR NOT con),
m AS (SELECT *, count(*) OVER (PARTITION BY site, role) > 1 AS many FROM t WHERE rk <= 4)
SELECT site, 'fontFamily' AS type, '--font-' || role || CASE WHEN many THEN '-' || regexp_replace(k, '\s+', '-', 'g') ELSE '' END AS name, value, uses, 'mined' AS source FROM m"""


def families(uses):
    return H.family_tokens(uses.filter("kind = 'family'"))


@query("family_tokens", "SELECT * FROM {families}")
def _(spark, d):
    return families(counts(spark, d))


DUCK_VIEWS["weights"] = """
SELECT site, 'fontWeight' AS type, '--font-weight-' || CASE value WHEN '100' THEN 'thin' WHEN '200' THEN 'extralight' WHEN '300' THEN 'light' WHEN '400' THEN 'regular' WHEN '500' THEN 'medium' WHEN '600' THEN 'semibold' ELSE 'bold' END AS name, value, uses, 'mined' AS source
FROM (SELECT * FROM {counts} WHERE kind = 'weight' QUALIFY row_number() OVER (PARTITION BY site ORDER BY uses DESC, value) <= 5) w
UNION ALL SELECT site, 'fontStyle', '--font-style-' || lower(value), lower(value), CAST(sum(uses) AS BIGINT), 'mined' FROM {counts} WHERE kind = 'style' GROUP BY site, lower(value)"""


@query("weight_style_tokens", "SELECT * FROM {weights}")
def _(spark, d):
    return H.weight_style_tokens(counts(spark, d))


def leading(spark, d):
    return H.leading_tracking_tokens(H.leading_tracking_counts(view(spark, d, "snodes")))


DUCK_VIEWS["lead_counts"] = r"""
SELECT site, kind, value, count(*) AS uses FROM (
  SELECT site, 'leading' AS kind, CAST(CAST(round(CAST(rtrim(lead, 'px') AS DOUBLE) / CAST(rtrim(size, 'px') AS DOUBLE) * 100) AS BIGINT) AS VARCHAR) || '%' AS value FROM {snodes}
  UNION ALL SELECT site, 'tracking', CASE WHEN t IN ('0.000', '-0.000') THEN '0' ELSE regexp_replace(t, '\.?0+$', '') END || 'rem' FROM (SELECT site, printf('%.3f', round(CASE WHEN track = 'normal' THEN 0 WHEN track = '-0.8px' THEN -0.05 ELSE CAST(0.02 AS DOUBLE) * CAST(rtrim(size, 'px') AS DOUBLE) / 16 END, 3)) AS t FROM {snodes}) x) y GROUP BY ALL"""


@query("leading_tracking_tokens", r"""
SELECT site, CASE WHEN kind = 'leading' THEN 'lineHeight' ELSE 'letterSpacing' END AS type, CASE WHEN kind = 'leading' THEN '--line-height-' || rtrim(value, '%') ELSE '--letter-spacing-' || replace(replace(rtrim(value, 'rem'), '-', 'neg-'), '.', '_') END AS name, value, uses, 'mined' AS source
FROM (SELECT * FROM {lead_counts} QUALIFY row_number() OVER (PARTITION BY site, kind ORDER BY uses DESC, value) <= 16) t""")
def _(spark, d):
    return leading(spark, d)


DUCK_VIEWS["sizes"] = """
WITH sc AS (SELECT * FROM (VALUES ('xs',12),('sm',14),('base',16),('lg',18),('xl',20),('2xl',24),('3xl',30),('4xl',36),('5xl',48),('6xl',60),('7xl',72),('8xl',96),('9xl',128),('10xl',160),('11xl',192),('12xl',224)) t(step, px)),
c AS (SELECT site, TRY_CAST(rtrim(value, 'px') AS BIGINT) AS px, uses FROM {counts} WHERE kind = 'size')
SELECT site, 'fontSize' AS type, '--text-' || step AS name, CAST(px AS VARCHAR) || 'px' AS value, CAST(0 AS BIGINT) AS uses, 'default' AS source FROM (SELECT DISTINCT site FROM c) s, sc
UNION ALL SELECT site, 'fontSize', '--text-' || px, px || 'px', uses, 'mined' FROM c WHERE px BETWEEN 10 AND 240 AND px NOT IN (SELECT px FROM sc)"""


def sizes(uses):
    return H.font_size_tokens(uses.filter("kind = 'size'"))


@query("font_size_tokens", "SELECT * FROM {sizes}")
def _(spark, d):
    return sizes(counts(spark, d))


@query("snap_to_scale", """
WITH sc AS (SELECT * FROM (VALUES ('px',1),('0.5',2),('1',4),('1.5',6),('2',8),('2.5',10),('3',12),('3.5',14),('4',16),('5',20),('6',24),('7',28),('8',32),('9',36),('10',40),('11',44),('12',48),('14',56),('16',64),('20',80),('24',96),('28',112),('32',128)) t(step, px)),
v AS (SELECT DISTINCT l_quantity AS px FROM lineitem)
SELECT v.px, step, CAST(abs(sc.px - v.px) AS DOUBLE) AS distance FROM v, sc QUALIFY row_number() OVER (PARTITION BY v.px ORDER BY abs(sc.px - v.px), sc.px DESC) = 1""")
def _(spark, d):
    from quiltlens.plans.registry import table

    return H.snap_to_scale(table(spark, d, "lineitem").select(F.col("l_quantity").alias("px")).distinct(), H.SPACING_SCALE)


_REQ = ["--color-accent", "--color-danger", "--font-serif", "--text-base", "--spacing-4", "--color-surface"]


def tokens_of(uses):
    """Colours, families and sizes; the few named colours of a site are written, as both roles read them."""
    named = materialize(brand(uses), "brand-tokens")
    return named, semantic(uses, named), families(uses), sizes(uses)


def proposed(spark, d):
    uses = mined(spark, d)
    colours, roles, fonts, scale = tokens_of(uses)
    return H.proposed_rows([colours, roles, fonts, H.weight_style_tokens(uses), leading(spark, d), scale], uses.select("site").distinct())


@query("propose_tokens", """
SELECT site, type, count(*) AS tokens, CAST(sum(uses) AS BIGINT) AS uses FROM (
 SELECT site, type, uses FROM {brand} UNION ALL SELECT site, type, uses FROM {semantic} UNION ALL SELECT site, type, uses FROM {families} UNION ALL SELECT site, type, uses FROM {weights} UNION ALL SELECT site, type, uses FROM {sizes}
 UNION ALL (SELECT site, CASE WHEN kind = 'leading' THEN 'lineHeight' ELSE 'letterSpacing' END, uses FROM {lead_counts} QUALIFY row_number() OVER (PARTITION BY site, kind ORDER BY uses DESC, value) <= 16)
 UNION ALL SELECT site, 'spacing', 0 FROM (SELECT DISTINCT site FROM {snodes}) s, range(23)) t GROUP BY site, type""")
def _(spark, d):
    return proposed(spark, d).groupBy("site", "type").agg(F.count("*").alias("tokens"), F.sum("uses").alias("uses"))


@query("token_contract", """
SELECT s.site, r.name FROM (SELECT DISTINCT site FROM {snodes}) s, (SELECT unnest(['--color-accent', '--color-danger', '--font-serif', '--color-surface']) AS name) r
WHERE NOT EXISTS (SELECT 1 FROM (SELECT site, name FROM {brand} UNION ALL SELECT site, name FROM {semantic} UNION ALL SELECT site, name FROM {families}) t WHERE t.site = s.site AND t.name = r.name)""")
def _(spark, d):
    uses = mined(spark, d)
    sites = uses.select("site").distinct()
    # weights, styles, line heights and letter spacings have names of their own starts, none of them is required
    return H.token_contract(H.proposed_rows(list(tokens_of(uses)), sites), sites, _REQ)


define_view("var_tokens", r"""
SELECT 'site-' || CAST(CAST(floor(p_partkey / 32) AS BIGINT) AS STRING) AS site, '--v' || CAST(p_partkey % 32 AS STRING) AS name,
  CASE WHEN p_partkey % 32 = 7 THEN 'var(--v7)' WHEN p_partkey % 32 = 9 THEN 'var(--v10)' WHEN p_partkey % 32 = 10 THEN 'var(--v9)' WHEN p_partkey % 32 = 11 THEN 'var(--none)' WHEN p_partkey % 4 = 0 THEN CAST(p_size AS STRING) || 'px' ELSE 'var(--v' || CAST(p_partkey % 32 - 1 AS STRING) || ')' END AS value FROM {part}
""")


@query("resolve_vars", r"""
SELECT site, name, value, hops FROM (
  WITH RECURSIVE r AS (SELECT site, name, value, CAST([] AS VARCHAR[]) AS seen, CAST(0 AS BIGINT) AS hops FROM {var_tokens}
    UNION ALL SELECT r.site, r.name, t.value, list_append(r.seen, t.name), r.hops + 1 FROM r JOIN {var_tokens} t ON t.site = r.site AND r.value = 'var(' || t.name || ')' WHERE NOT list_contains(r.seen, t.name))
  SELECT *, row_number() OVER (PARTITION BY site, name ORDER BY hops DESC) AS n FROM r) x WHERE n = 1""")
def _(spark, d):
    return H.resolve_vars(view(spark, d, "var_tokens"))


DUCK_VIEWS["bind"] = r"""
WITH tk AS (SELECT * FROM {brand} UNION ALL SELECT * FROM {semantic} UNION ALL SELECT * FROM {families} UNION ALL SELECT * FROM {sizes}),
nk AS (SELECT *, CASE WHEN type = 'color' THEN CASE WHEN value = 'rgb(102, 102, 102)' THEN '#666666FF' WHEN value = '#111' THEN '#111111FF' WHEN length(value) = 7 THEN value || 'FF' ELSE value END WHEN type = 'fontFamily' THEN lower(CASE value WHEN 'Inter, sans-serif' THEN 'Inter' WHEN 'Inter-Bold' THEN 'Inter' WHEN 'Georgia, serif' THEN 'Georgia' WHEN 'sans-serif' THEN 'sans-serif' WHEN 'var(--font-sans)' THEN '' ELSE 'Fira Code' END) ELSE value END AS k FROM tk),
bt AS (SELECT site, type, k, arg_min(name, (-uses, name)) AS token FROM nk GROUP BY ALL),
sk AS (SELECT *, CASE WHEN type = 'color' THEN CASE WHEN value = 'rgb(102, 102, 102)' THEN '#666666FF' WHEN value = '#111' THEN '#111111FF' WHEN length(value) = 7 THEN value || 'FF' ELSE value END WHEN type = 'fontFamily' THEN lower(CASE value WHEN 'Inter, sans-serif' THEN 'Inter' WHEN 'Inter-Bold' THEN 'Inter' WHEN 'Georgia, serif' THEN 'Georgia' WHEN 'sans-serif' THEN 'sans-serif' WHEN 'var(--font-sans)' THEN '' ELSE 'Fira Code' END) ELSE value END AS k FROM {styles})
SELECT s.site, node_id, prop, s.type, value, CASE WHEN value NOT LIKE 'var(%' THEN token END AS token, CASE WHEN value LIKE 'var(%' THEN 'skip' WHEN token IS NOT NULL THEN 'change' ELSE 'leftover' END AS status,
  CASE WHEN value LIKE 'var(%' THEN 'already bound' WHEN token IS NOT NULL THEN '' WHEN s.type IN ('fontWeight', 'fontStyle') THEN 'no token of this type' ELSE 'no token with this value' END AS reason
FROM sk s LEFT JOIN bt ON bt.site = s.site AND bt.type = s.type AND bt.k = s.k"""


def bound(spark, d):
    uses = mined(spark, d)
    colours, roles, fonts, scale = tokens_of(uses)
    tokens = colours.unionByName(roles).unionByName(fonts).unionByName(scale)
    types = F.create_map(*[F.lit(x) for _, t, k, _ in PROPS for x in (k, t)])
    return H.bind_nodes(view(spark, d, "snodes"), tokens, [(p, t, c) for p, t, _, c in PROPS], uses.select(types[F.col("kind")].alias("type"), "value"))


@query("bind_tokens", "SELECT * FROM {bind}")
def _(spark, d):
    return bound(spark, d)


@query("bind_qa", """
SELECT site, node_id, '' AS prop, 'unaccounted' AS defect FROM {snodes} WHERE node_id % 5 = 0
UNION ALL SELECT site, node_id, prop, 'raw value has a token' FROM {bind} WHERE token IS NOT NULL AND node_id % 5 <> 0 AND NOT (node_id % 3 = 0 AND prop = 'color')""")
def _(spark, d):
    nodes = view(spark, d, "snodes")
    acc = bound(spark, d).filter("node_id % 5 <> 0")
    # all nodes have a colour, so what is allowed is known without the accounts
    return H.bind_qa(nodes, acc, nodes.filter("node_id % 3 = 0").select("site", "node_id", F.lit("color").alias("prop")))


define_view("fills", r"""
SELECT site, node_id, board AS parent_key, CASE WHEN node_id % 7 = 0 THEN NULL ELSE fill END AS fill, first_value(node_id) OVER (PARTITION BY board ORDER BY node_id) AS parent_id FROM {snodes}
""")


@query("inherited_fills", """
SELECT c.site, c.node_id, '--color-x' AS token FROM {fills} c LEFT JOIN {fills} p ON p.node_id = c.parent_id WHERE c.fill IS NOT NULL AND NOT coalesce(c.fill = p.fill, false)""")
def _(spark, d):
    f = view(spark, d, "fills")
    return H.inherited_fills(f, f.select("site", "node_id", F.lit("--color-x").alias("token")))


@query("token_upsert_plan", """
WITH w AS (SELECT site, name, min(value) AS value FROM {var_tokens} GROUP BY ALL), e AS (SELECT site, name, value FROM {var_tokens} WHERE name LIKE '%1%' UNION ALL SELECT site, name, 'old' FROM {var_tokens} WHERE name LIKE '%1%')
SELECT site, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.site = w.site AND e.name = w.name) THEN 'update' ELSE 'create' END AS action, name, value FROM w""")
def _(spark, d):
    t = view(spark, d, "var_tokens")
    e = t.filter("name LIKE '%1%'").select("site", "name", "value")
    return H.token_upsert_plan(t, e.unionByName(e.withColumn("value", F.lit("old"))))


@query("paint_witness", """
WITH cap AS (SELECT site, CAST(floor(node_id / 1000000) AS BIGINT) AS node, fill FROM {snodes}), st AS (SELECT * FROM (SELECT cap.*, f.r, f.g, f.b FROM cap JOIN {fill_c} f ON f.site = cap.site AND f.value = cap.fill) x WHERE greatest(r, g, b) > 0 AND (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) >= 0.35),
s AS (SELECT site, node, min(fill) AS lo, max(fill) AS hi FROM st GROUP BY ALL), n AS (SELECT site, node, min(fill) AS fill FROM cap GROUP BY ALL)
SELECT n.site, n.node AS node_id, n.fill, CASE WHEN lo = hi THEN lo END AS witness, CASE WHEN lo <> hi THEN 'conflict' WHEN lo = n.fill THEN 'same' ELSE 'overlay' END AS status FROM n JOIN s ON s.site = n.site AND s.node = n.node""")
def _(spark, d):
    cap = view(spark, d, "snodes").select("site", F.floor(F.col("node_id") / 1000000).cast("bigint").alias("node_id"), F.col("fill").alias("value"))
    return H.paint_witness(cap, cap.groupBy("site", "node_id").agg(F.min("value").alias("fill")))


@query("unbound_fonts", r"""
WITH fr AS (SELECT site, name, uses, CASE WHEN value LIKE '%Code%' THEN 'mono' WHEN value LIKE 'Georgia%' OR value = 'sans-serif' THEN 'serif' ELSE 'sans' END AS role FROM {families}),
pr AS (SELECT site, role, arg_min(name, (-uses, name)) AS token FROM fr GROUP BY ALL), an AS (SELECT site, arg_min(name, (-uses, name)) AS token FROM fr GROUP BY ALL),
l AS (SELECT site, node_id, family AS value, CASE WHEN family LIKE '%Code%' THEN 'mono' WHEN family LIKE 'Georgia%' OR family = 'sans-serif' THEN 'serif' ELSE 'sans' END AS role FROM {snodes} WHERE family NOT LIKE 'var(%' AND (contains(family, ',') OR family = 'sans-serif'))
SELECT l.site, node_id, value, l.role, coalesce(pr.token, an.token) AS token FROM l JOIN an ON an.site = l.site LEFT JOIN pr ON pr.site = l.site AND pr.role = l.role""")
def _(spark, d):
    return H.unbound_fonts(styles(spark, d), families(counts(spark, d)))


define_view("css_files", r"""
SELECT 'site-' || CAST(CAST(floor(p_partkey / 32) AS BIGINT) AS STRING) AS site, p_partkey AS pos, replace(replace(
  '/* c: #000; */ :root« --token-a' || CAST(p_size % 5 AS STRING) || ': ' || printf('#%02x%02x%02x', p_partkey % 6 * 40, p_partkey % 4 * 60, p_partkey % 2 * 200) || '; --gap-x: ' || CAST(p_size AS STRING) || 'px; --font-a: Inter; --n: 2; --token-b2: rgb(1, 2, ' || CAST(p_size % 3 AS STRING) || '); --spacing-1: 4px; --color-x: #fff; --font-weight-b: 700 » .a« color: #ABC; font-family: ' ||
  CASE p_partkey % 3 WHEN 0 THEN 'Inter, sans-serif' WHEN 1 THEN 'Georgia' ELSE 'Lora' END || '; padding: ' || CAST(p_size % 4 AS STRING) || 'px; border-radius: ' || CAST(p_size % 3 AS STRING) || 'px; box-shadow: none »', '«', chr(123)), '»', chr(125)) AS css FROM {part}
""")


@query("css_custom_props", r"""
SELECT site, pos, CAST(i AS BIGINT) AS i, regexp_extract(x, '^(--[A-Za-z0-9_-]+)', 1) AS name, trim(regexp_replace(x, '^--[A-Za-z0-9_-]+\s*:', '')) AS value,
  CASE regexp_extract(x, '^(--[A-Za-z0-9_-]+)', 1) WHEN '--font-a' THEN 'fontFamily' WHEN '--spacing-1' THEN 'spacing' WHEN '--color-x' THEN 'color' WHEN '--font-weight-b' THEN 'fontWeight' END AS type FROM (
  SELECT site, pos, unnest(xs) AS x, unnest(range(0, len(xs))) AS i FROM (SELECT site, pos, regexp_extract_all(css, '--[A-Za-z0-9_-]+\s*:\s*[^;{}]+') AS xs FROM {css_files}) a) b""")
def _(spark, d):
    return H.css_custom_props(view(spark, d, "css_files"))


DUCK_VIEWS["css_mined"] = r"""
SELECT site, kind, value, count(*) AS uses FROM (
  SELECT site, 'radius' AS kind, regexp_extract(css, 'border-radius: ([^;]+);', 1) AS value FROM {css_files} UNION ALL SELECT site, 'spacing', regexp_extract(css, 'padding: ([^;]+);', 1) FROM {css_files} UNION ALL SELECT site, 'shadow', 'none' FROM {css_files}
  UNION ALL SELECT site, 'family', regexp_extract(css, 'font-family: ([A-Za-z]+)', 1) FROM {css_files}
  UNION ALL SELECT site, 'color', regexp_extract(css, '--token-a[0-9]: (#[0-9a-f]+);', 1) FROM {css_files} UNION ALL SELECT site, 'color', '#01020' || regexp_extract(css, 'rgb\(1, 2, ([0-9])\)', 1) FROM {css_files}) t GROUP BY ALL"""


@query("mine_css_tokens", "SELECT * FROM {css_mined}")
def _(spark, d):
    return H.mine_css_tokens(view(spark, d, "css_files"))


@query("folder_tokens", r"""
WITH r AS (SELECT site, 'color' AS kind, lower(v) AS value, pos, i FROM (SELECT site, pos, unnest(xs) AS v, unnest(range(0, len(xs))) AS i FROM (SELECT site, pos, regexp_extract_all(css, '#[0-9a-fA-F]{3,8}\b') AS xs FROM {css_files}) a) b
  UNION ALL SELECT site, 'family', lower(trim(regexp_extract(css, 'font-family\s*:\s*([^;}{]+)', 1))), pos, 0 FROM {css_files}),
f AS (SELECT site, kind, value, min((pos, i)) AS at_ FROM r GROUP BY ALL)
SELECT site, kind, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY site, kind ORDER BY at_) AS rank FROM f) t WHERE rank <= CASE WHEN kind = 'color' THEN 6 ELSE 2 END""")
def _(spark, d):
    return H.folder_tokens(view(spark, d, "css_files"), 6, 2)


define_view("tok_source", r"SELECT 'site-' || CAST(p_partkey AS STRING) AS site, CASE n WHEN 0 THEN 'primary' WHEN 1 THEN 'accent' ELSE 'ink' END AS name, CASE WHEN p_size % 5 = 0 THEN 'transparent' ELSE printf('#%02X0000', p_size) END AS value FROM {part} CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2) t WHERE (p_partkey + n) % 3 <> 0")
define_view("tok_computed", r"SELECT 'site-' || CAST(p_partkey AS STRING) AS site, CASE n WHEN 0 THEN 'primary' WHEN 1 THEN 'accent' ELSE 'muted' END AS name, printf('#%02x0000', p_size + p_partkey % 2) AS value FROM {part} CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2) t WHERE (p_partkey + n) % 4 <> 0")
DUCK_VIEWS["tok_merged"] = """
WITH b AS (SELECT coalesce(s.site, c.site) AS site, coalesce(s.name, c.name) AS name, coalesce(s.value, c.value) AS value, CASE WHEN s.value IS NOT NULL THEN 'source' ELSE 'computed' END AS winner
  FROM (SELECT * FROM {tok_source} WHERE value <> 'transparent') s FULL JOIN {tok_computed} c ON c.site = s.site AND c.name = s.name)
SELECT * FROM b UNION ALL SELECT site, 'accent', value, 'computed' FROM b x WHERE name = 'primary' AND winner = 'computed' AND NOT EXISTS (SELECT 1 FROM b WHERE b.site = x.site AND b.name = 'accent')"""


@query("merge_tokens", "SELECT * FROM {tok_merged}")
def _(spark, d):
    return H.merge_tokens(view(spark, d, "tok_source"), view(spark, d, "tok_computed"))


@query("token_comparison", """
SELECT coalesce(x.site, m.site) AS site, coalesce(x.name, m.name) AS name, x.source, x.computed, m.value AS winner,
 CASE WHEN source IS NULL THEN 'computed only' WHEN computed IS NULL THEN 'source only' WHEN lower(source) = lower(computed) THEN 'agree' ELSE 'differ' END AS state
FROM (SELECT coalesce(s.site, c.site) AS site, coalesce(s.name, c.name) AS name, s.value AS source, c.value AS computed FROM {tok_source} s FULL JOIN {tok_computed} c ON c.site = s.site AND c.name = s.name) x
FULL JOIN {tok_merged} m ON m.site = x.site AND m.name = x.name""")
def _(spark, d):
    s, c = view(spark, d, "tok_source"), view(spark, d, "tok_computed")
    return H.token_comparison(s, c, H.merge_tokens(s, c))


@query("export_tokens", """
SELECT site, 1 AS part, name, '  ' || name || ': ' || value || ';' AS line FROM {brand} UNION ALL SELECT DISTINCT site, 0, '', ':root {' FROM {brand} UNION ALL SELECT DISTINCT site, 2, '', '}' FROM {brand}""")
def _(spark, d):
    return H.export_tokens(brand(counts(spark, d)))
