"""Registered snapshot and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiltlens.operators import similarity as S, snapshots as J, validation as L
from quiltlens.plans.inventory import corpus
from quiltlens.plans.registry import DUCK_VIEWS, define_view, query, view
from quiltlens.session import materialize
from quiltlens.sources.corpus import page_corpus

define_view("edited_pages", r"""
SELECT page_id, url, CASE WHEN page_id % 5 = 0 THEN replace(html, '<html lang="en"', '<html data-q="1" lang="xx"') WHEN page_id % 5 = 1 THEN replace(html, '<nav>', '<nav aria-label="Main" title="t">') WHEN page_id % 5 = 2 THEN replace(html, '</ul>', '</ul >') ELSE html END AS html FROM {pages} WHERE page_id % 9 <> 0
""")


def _sig(src: str) -> str:
    tag = "regexp_extract(x, '(?s)^<[^>]*>', 0)"
    attrs = rf"""list_sort(list_filter(list_transform(regexp_extract_all({tag}, '(?s)\s[a-zA-Z_:][a-zA-Z0-9_.:-]*\s*=\s*(?:"[^"]*"|''[^'']*'')'), lambda a: lower(trim(regexp_extract(a, '(?s)^\s*([^=\s]+)', 1))) || '=' || regexp_extract(a, '(?s)=\s*["''](.*)["'']$', 1)), lambda p: split_part(p, '=', 1) NOT IN ('alt','role','lang','title','tabindex','for') AND p NOT LIKE 'aria-%'))"""
    text = r"trim(regexp_replace(regexp_replace(x, '(?s)^<[^>]*>', ''), '\s+', ' ', 'g'))"
    return rf"""SELECT site, page_id, path, sha256(array_to_string(list_transform(t, lambda x: '<' || lower(regexp_extract(x, '^<(/?[a-zA-Z][a-zA-Z0-9-]*)', 1)) || CASE WHEN len({attrs}) > 0 THEN ' ' || array_to_string({attrs}, ' ') ELSE '' END || '>' || CASE WHEN {text} <> '' THEN chr(10) || {text} ELSE '' END), chr(10))) AS signature
FROM (SELECT k.site, k.page_id, k.path, regexp_extract_all(regexp_replace(html, '(?s)<!.*?>', '', 'g'), '(?s)<[/a-zA-Z][^>]*>[^<]*') AS t FROM {src} p JOIN {{corpus_keys}} k USING (page_id)) a"""


DUCK_VIEWS["sig_then"], DUCK_VIEWS["sig_now"] = _sig("pages"), _sig("{edited_pages}")


def now(spark, d):
    return J.content_signature(page_corpus(view(spark, d, "edited_pages")))


@query("content_signature", "SELECT * FROM {sig_now}")
def _(spark, d):
    return now(spark, d)


def _by_url(df):
    return df.select("site", F.concat_ws("#", "path", F.col("page_id").cast("string")).alias("path"), "signature")


@query("verify_snapshot", """
SELECT coalesce(a.site, b.site) AS site, coalesce(a.path, b.path) || '#' || coalesce(a.page_id, b.page_id) AS path, CASE WHEN b.signature IS NULL THEN 'deleted' WHEN a.signature IS NULL THEN 'added' ELSE 'changed' END AS state
FROM (SELECT * FROM {sig_then} WHERE page_id % 10 <> 1) a FULL JOIN {sig_now} b ON b.page_id = a.page_id WHERE a.signature IS DISTINCT FROM b.signature AND coalesce(a.page_id, b.page_id) % 4 <> 0""")
def _(spark, d):
    then = J.content_signature(corpus(spark, d))
    allowed = _by_url(then.filter("page_id % 4 = 0"))
    return J.verify_snapshot(_by_url(then.filter("page_id % 10 <> 1")), _by_url(now(spark, d)), allowed)


define_view("facts_before", "SELECT l_suppkey AS site, l_orderkey AS page, CASE l_partkey % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'font-size' WHEN 2 THEN 'token' ELSE 'section' END AS kind, 'v' || CAST(l_partkey % 3 AS STRING) AS value, CAST(l_linenumber AS BIGINT) AS ord FROM {lineitem}")
define_view("facts_after", "SELECT l_suppkey AS site, l_orderkey AS page, CASE l_partkey % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'font-size' WHEN 2 THEN 'token' ELSE 'section' END AS kind, 'v' || CAST((l_partkey + CASE WHEN l_quantity < 10 THEN 1 ELSE 0 END) % 3 AS STRING) AS value, CAST(l_linenumber AS BIGINT) AS ord FROM {lineitem} WHERE l_quantity < 45")


@query("freeze_compare", """
WITH b AS (SELECT site, page, kind, CASE WHEN kind = 'section' THEN value || '@' || ord ELSE value END AS value, count(*) AS n FROM {facts_before} GROUP BY ALL), a AS (SELECT site, page, kind, CASE WHEN kind = 'section' THEN value || '@' || ord ELSE value END AS value, count(*) AS n FROM {facts_after} GROUP BY ALL),
j AS (SELECT coalesce(a.site, b.site) AS site, coalesce(a.page, b.page) AS page, coalesce(a.kind, b.kind) AS kind, coalesce(a.value, b.value) AS value, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after FROM b FULL JOIN a ON a.site = b.site AND a.page = b.page AND a.kind = b.kind AND a.value = b.value)
SELECT * FROM j WHERE CASE kind WHEN 'class' THEN after < before WHEN 'font-size' THEN after <> before ELSE (after > 0) <> (before > 0) END""")
def _(spark, d):
    return J.freeze_compare(view(spark, d, "facts_before"), view(spark, d, "facts_after"))


@query("multiset_missing", """
SELECT a.kind, a.value, a.ord, a.n AS live, coalesce(b.n, 0) AS recorded FROM (SELECT kind, value, ord, count(*) AS n FROM {facts_before} GROUP BY ALL) a LEFT JOIN (SELECT kind, value, ord, count(*) AS n FROM {facts_after} GROUP BY ALL) b ON b.kind = a.kind AND b.value = a.value AND b.ord = a.ord WHERE coalesce(b.n, 0) < a.n""")
def _(spark, d):
    return J.multiset_missing(view(spark, d, "facts_before"), view(spark, d, "facts_after"), ["kind", "value", "ord"])


_PROP = "CASE l_linenumber % 4 WHEN 0 THEN 'x' WHEN 1 THEN 'lineHeight' WHEN 2 THEN 'fontSize' ELSE 'color' END"
_GVAL = "CASE l_linenumber % 4 WHEN 1 THEN CAST(CAST({q} AS BIGINT) AS STRING) || 'px' WHEN 3 THEN 'c' || CAST(CAST({q} AS BIGINT) % 4 AS STRING) ELSE CAST(CAST({q} AS BIGINT) AS STRING) || 'px' END"
define_view("geo_before", f"SELECT l_suppkey AS site, l_orderkey AS board, l_orderkey * 100000 + l_partkey AS node_id, {_PROP} AS prop, min({_GVAL.replace('{q}', 'l_quantity')}) AS value, CAST(20 AS DOUBLE) AS font_size FROM {{lineitem}} GROUP BY l_suppkey, l_orderkey, l_partkey, {_PROP}")
define_view("geo_after", f"SELECT l_suppkey AS site, l_orderkey AS board, l_orderkey * 100000 + l_partkey AS node_id, {_PROP} AS prop, min({_GVAL.replace('{q}', '(l_quantity + l_partkey % 3)')}) AS value, CAST(20 AS DOUBLE) AS font_size FROM {{lineitem}} WHERE l_partkey % 7 <> 0 GROUP BY l_suppkey, l_orderkey, l_partkey, {_PROP}")


@query("geometry_diff", """
SELECT site, board, node_id, prop, before, after, kind FROM (
 SELECT b.site, b.board, b.node_id, b.prop, b.value AS before, a.value AS after, CASE WHEN a.value IS NULL THEN 'removed' WHEN b.prop = 'color' THEN CASE WHEN a.value <> b.value THEN 'changed' END
  WHEN abs(CAST(rtrim(a.value, 'px') AS DOUBLE) - CAST(rtrim(b.value, 'px') AS DOUBLE)) * CASE WHEN b.prop = 'lineHeight' THEN 5 ELSE 1 END > 0.5 THEN 'moved' END AS kind
 FROM {geo_before} b LEFT JOIN {geo_after} a ON a.site = b.site AND a.board = b.board AND a.node_id = b.node_id AND a.prop = b.prop WHERE b.board % 6 <> 0) t WHERE kind IS NOT NULL""")
def _(spark, d):
    b = view(spark, d, "geo_before")
    return J.geometry_diff(b, view(spark, d, "geo_after"), b.filter("board % 6 = 0").select("site", "board").distinct())


define_view("manifests", "SELECT user_id AS run_id, CASE event_id % 3 WHEN 0 THEN 'build' WHEN 1 THEN 'review' ELSE 'polish' END AS phase, 'f/' || CAST(event_id AS STRING) || '.html' AS path, 'h' || CAST(event_id % 97 AS STRING) AS sha256, event_id * 3 AS bytes FROM {events}")
DUCK_VIEWS["digests"] = """
SELECT run_id, phase, sha256(string_agg(line || ' ' || n, chr(10) ORDER BY line || ' ' || n)) AS digest, CAST(sum(n) AS BIGINT) AS files, CAST(sum(bytes) AS BIGINT) AS bytes
FROM (SELECT run_id, phase, path || ' ' || sha256 AS line, count(*) AS n, sum(bytes) AS bytes FROM {manifests} GROUP BY ALL) t GROUP BY run_id, phase"""


def digests(spark, d):
    return J.manifest_digest(view(spark, d, "manifests"))


@query("manifest_digest", "SELECT * FROM {digests}")
def _(spark, d):
    return digests(spark, d)


define_view("agent_findings", "SELECT user_id AS run_id, CASE event_id % 3 WHEN 0 THEN 'build' WHEN 1 THEN 'review' ELSE 'polish' END AS phase, 'k' || CAST(event_id AS STRING) AS key, CASE WHEN event_id % 17 = 0 THEN 'build' ELSE CASE event_id % 3 WHEN 0 THEN 'build' WHEN 1 THEN 'review' ELSE 'polish' END END AS finding_phase, CASE WHEN event_id % 5 = 0 THEN ' ' ELSE 'high' END AS severity, CASE WHEN event_id % 13 = 0 THEN '' ELSE 'page' END AS source, CASE WHEN event_id % 19 = 0 THEN NULL ELSE 'do' END AS suggestion, CASE WHEN event_id % 23 = 0 THEN 'a/b' ELSE 'critic' END AS agent, CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'seen' END AS evidence, CAST(floor(value) AS BIGINT) % 20 AS words_seen, event_id % 2 = 0 AS patch_scoped, event_id % 4 AS pick FROM {events}")


@query("finding_validity", """
WITH e AS (SELECT *, list_filter([CASE WHEN trim(severity) = '' OR source = '' OR evidence IS NULL OR suggestion IS NULL THEN 'missing field' END, CASE WHEN finding_phase <> phase THEN 'wrong phase' END, CASE WHEN agent = 'a/b' THEN 'bad agent' END, CASE WHEN pick = 0 THEN 'not from this snapshot' END], lambda r: r IS NOT NULL) AS errors FROM {agent_findings})
SELECT run_id, phase, key, unnest(list_concat(errors, list_filter([CASE WHEN len(errors) = 0 AND run_id % 2 = 0 THEN 'stale' END,
 CASE WHEN phase = 'review' AND words_seen < 12 THEN 'thin evidence' END, CASE WHEN phase = 'polish' AND NOT patch_scoped THEN 'patch not scoped' END], lambda r: r IS NOT NULL))) AS reason FROM e""")
def _(spark, d):
    snap = digests(spark, d)
    f = view(spark, d, "agent_findings").join(snap.select("run_id", "phase", "digest"), ["run_id", "phase"], "left")
    f = f.withColumn("digest", F.when(F.col("pick") == 0, "other").otherwise(F.col("digest")))
    return J.finding_validity(f, snap, snap.withColumn("digest", F.when(F.col("run_id") % 2 == 0, F.concat("digest", F.lit("x"))).otherwise(F.col("digest"))))


define_view("review_bands", "SELECT l_suppkey AS site, l_partkey AS page, CAST(l_linenumber AS BIGINT) AS band, 'd' || CAST(max(l_orderkey) % 3 AS STRING) AS digest, 'p' || CAST(max(l_orderkey) % 2 AS STRING) AS picture FROM {lineitem} GROUP BY l_suppkey, l_partkey, l_linenumber")
define_view("reviews", "SELECT l_suppkey AS site, l_partkey AS page, CAST(l_linenumber AS BIGINT) AS band, l_orderkey AS round, CASE WHEN l_quantity < 20 THEN 'miss' ELSE 'ok' END AS verdict, 'd' || CAST(l_orderkey % 4 AS STRING) AS digest, 'p' || CAST(l_orderkey % 5 AS STRING) AS picture, CAST(l_orderkey % 3 AS BIGINT) AS reopened FROM {lineitem} WHERE l_partkey % 6 <> 0")


@query("band_review_state", """
SELECT b.site, b.page, b.band, CASE WHEN r.round IS NULL THEN 'never looked' WHEN r.digest <> b.digest THEN 'stale' WHEN verdict <> 'ok' THEN 'miss' ELSE 'ok' END AS state,
 CASE WHEN r.round IS NULL THEN 'look' WHEN r.digest <> b.digest THEN CASE WHEN r.picture = b.picture THEN 'restamp' WHEN reopened < 1 THEN 'reopen' ELSE 'residual' END WHEN verdict <> 'ok' THEN 'fix' ELSE 'none' END AS action, r.round
FROM {review_bands} b LEFT JOIN (SELECT * FROM {reviews} QUALIFY row_number() OVER (PARTITION BY site, page, band ORDER BY round DESC) = 1) r ON r.site = b.site AND r.page = b.page AND r.band = b.band""")
def _(spark, d):
    return J.band_review_state(view(spark, d, "review_bands"), view(spark, d, "reviews"))


@query("band_coverage", """
SELECT DISTINCT site, page, 'clip without band' AS kind, clip AS subject FROM {source_clips} c WHERE NOT EXISTS (SELECT 1 FROM {clips_named} n WHERE n.page = c.page AND n.clip = c.clip)
UNION ALL SELECT site, page, 'band without clip', pos FROM {ship_sections} s WHERE home AND NOT EXISTS (SELECT 1 FROM {clips_named} n WHERE n.page = s.page AND n.pos = s.pos)""")
def _(spark, d):
    # strict names only; bands of other pages are left to the ordinal rule
    clips = materialize(view(spark, d, "source_clips"), "source-clips")
    named = S.named_clips(view(spark, d, "ship_sections"), clips)
    return J.band_coverage(named.filter("clip IS NOT NULL OR home"), clips)


# ---- validation ------------------------------------------------------------------------------

define_view("shots", "SELECT l_suppkey AS site, l_orderkey AS shot, CASE l_partkey % 3 WHEN 0 THEN '0' || CAST(l_linenumber AS STRING) || ' · Hero' WHEN 1 THEN 'section-' || CAST(l_linenumber AS STRING) ELSE 'Section ' || CAST(l_linenumber AS STRING) END AS label FROM {lineitem}")
define_view("shot_sections", "SELECT DISTINCT l_suppkey AS site, CAST(l_linenumber AS BIGINT) AS section, CASE WHEN l_suppkey % 3 = 0 THEN '0' || CAST(l_linenumber AS STRING) ELSE '' END AS nn, 'section-' || CAST(l_linenumber AS STRING) AS slug FROM {lineitem}")


@query("match_shots", """
SELECT x.site, x.section, x.shot, x.rule FROM (
 SELECT s.site, s.section, h.shot, CASE WHEN s.nn <> '' AND h.label LIKE s.nn || ' ·%' THEN 0 WHEN lower(h.label) = s.slug THEN 1 WHEN replace(lower(h.label), '-', ' ') = replace(s.slug, '-', ' ') THEN 2 END AS rule FROM {shot_sections} s JOIN {shots} h ON h.site = s.site) x WHERE rule IS NOT NULL QUALIFY row_number() OVER (PARTITION BY site, section ORDER BY rule, shot) = 1""")
def _(spark, d):
    return L.match_shots(view(spark, d, "shots"), view(spark, d, "shot_sections")).withColumn("rule", F.col("rule").cast("int"))


define_view("measured", r"""
SELECT l_suppkey AS site, l_orderkey AS band, l_discount * 10 AS source_white, CASE WHEN l_partkey % 9 = 0 THEN CAST(0.99 AS DOUBLE) ELSE l_tax * 10 END AS built_white, CASE WHEN l_linenumber = 1 THEN 'board' ELSE 'section' END AS scope, l_partkey % 3 AS children, CAST(1600 AS DOUBLE) AS source_w, CAST(900 + l_suppkey % 40 * 20 AS DOUBLE) AS built_w,
  CASE WHEN l_partkey % 37 <> 0 THEN l_discount * 8 END AS source_sat, l_tax * 8 AS built_sat, l_quantity / 50 AS coverage, l_discount * 5 AS source_coverage, CAST(l_partkey % 256 AS DOUBLE) AS source_r, CAST((l_partkey + l_linenumber * 10) % 256 AS DOUBLE) AS built_r,
  CAST(100 AS DOUBLE) AS source_g, CAST(100 + l_linenumber AS DOUBLE) AS built_g, CAST(0 AS DOUBLE) AS source_b, CAST(l_suppkey % 60 AS DOUBLE) AS built_b, l_suppkey % 10 = 0 AS system_font, l_quantity * 50 AS source_h, CASE WHEN l_partkey % 4 = 0 THEN CAST(2000 AS DOUBLE) ELSE l_quantity * 20 + CAST(l_partkey % 900 AS DOUBLE) END AS built_h FROM {lineitem}
""")


@query("shot_verdicts", "SELECT site, band, verdict FROM (SELECT *, CASE WHEN scope = 'board' THEN CASE WHEN built_white > 0.72 AND source_white < 0.5 THEN 'board displaced' END WHEN children = 0 AND source_white < 0.75 THEN 'empty frame' WHEN built_white > 0.82 AND source_white < 0.55 THEN 'white ratio differs' END AS verdict FROM {measured}) t WHERE verdict IS NOT NULL")
def _(spark, d):
    return L.shot_verdicts(view(spark, d, "measured")).select("site", "band", "verdict")


@query("seed_verdicts", """
SELECT site, band, verdict FROM (SELECT *, CASE WHEN source_sat IS NULL THEN 'colour shift' WHEN source_sat >= 0.28 AND (built_sat < 0.12 OR built_sat < 0.45::DOUBLE * source_sat) THEN 'colour wash' WHEN source_sat < 0.16 AND built_sat >= 0.28 AND coverage >= 0.18 AND coverage >= source_coverage + 0.12::DOUBLE THEN 'colour spill'
 WHEN source_sat >= 0.28 AND abs(built_r - source_r) + abs(built_g - source_g) + abs(built_b - source_b) > 90 THEN 'colour shift' WHEN system_font THEN 'system font' WHEN children = 0 AND source_white < 0.75 OR built_white > 0.82 AND source_white < 0.55 THEN 'layout shift'
 WHEN built_h / source_h NOT BETWEEN 0.5 AND 2.5 AND NOT (built_h = 2000 AND built_w < 1360 AND abs(built_w / 2000 - 1600 / source_h) / (1600 / source_h) < 0.03) THEN 'layout shift' END AS verdict FROM {measured}) t WHERE verdict IS NOT NULL""")
def _(spark, d):
    return L.seed_verdicts(view(spark, d, "measured"))


define_view("measures", r"""
SELECT l_suppkey AS run_id, 'site-' || CAST(l_suppkey % 7 AS STRING) AS site, (l_orderkey * 100000 + l_partkey) * 10 + l_linenumber AS id, CASE l_linenumber % 3 WHEN 0 THEN 'mobile' ELSE 'desktop' END AS viewport, CASE l_orderkey % 4 WHEN 0 THEN 'lenient' WHEN 1 THEN 'portable' WHEN 2 THEN 'strict' ELSE 'ultra' END AS profile,
  CASE l_partkey % 4 WHEN 0 THEN 'section' WHEN 1 THEN 'text' WHEN 2 THEN 'spacing' ELSE 'color' END AS check_type, l_quantity AS expected, l_quantity + l_tax * 50 AS actual, l_quantity AS l1, l_quantity + l_tax * 20 AS l2, l_discount AS a1, l_tax AS a2 FROM {lineitem}
""")
DUCK_VIEWS["checked"] = """
SELECT run_id, site, id, viewport, profile, check_type, value, threshold, value <= threshold AS pass FROM (SELECT *, CASE check_type WHEN 'color' THEN sqrt(pow(a1 - a2, 2) + pow(l1 - l2, 2)) WHEN 'section' THEN 100 * abs(actual - expected) / expected ELSE abs(actual - expected) END AS value,
 CASE check_type WHEN 'section' THEN CASE profile WHEN 'lenient' THEN 2.5 WHEN 'portable' THEN 1 WHEN 'strict' THEN 0.5 ELSE 0.25 END WHEN 'text' THEN CASE profile WHEN 'lenient' THEN 3 WHEN 'portable' THEN 2 WHEN 'strict' THEN 1 ELSE 0.5 END
  WHEN 'spacing' THEN CASE profile WHEN 'lenient' THEN 2 WHEN 'ultra' THEN 0.5 ELSE 1 END ELSE CASE profile WHEN 'lenient' THEN 4 WHEN 'portable' THEN 2.5 WHEN 'strict' THEN 1.5 ELSE 1 END END::DOUBLE AS threshold FROM {measures}) t"""


def checks(spark, d):
    lab = lambda i: F.struct(F.col(f"l{i}").alias("l"), F.col(f"a{i}").alias("a"), F.lit(0.0).alias("b"))
    return L.threshold_checks(view(spark, d, "measures").withColumn("lab1", lab(1)).withColumn("lab2", lab(2))).drop("l1", "l2", "a1", "a2")


@query("threshold_checks", "SELECT * REPLACE (round(value, 6) AS value) FROM {checked}")
def _(spark, d):
    return checks(spark, d).withColumn("value", F.round("value", 6))


@query("failed_checks", "SELECT run_id, id, check_type, round(value / threshold, 6) AS severity, row_number() OVER (PARTITION BY run_id ORDER BY value / threshold DESC, id) AS rank FROM {checked} WHERE NOT pass QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY value / threshold DESC, id) <= 10")
def _(spark, d):
    return L.failed_checks(checks(spark, d)).select("run_id", "id", "check_type", F.round("severity", 6).alias("severity"), "rank")


DUCK_VIEWS["fdelta"] = """
WITH p AS (SELECT DISTINCT run_id, check_type || '-' || CAST(id % 50 AS VARCHAR) AS id FROM {checked} WHERE NOT pass AND viewport = 'desktop'), c AS (SELECT DISTINCT run_id, check_type || '-' || CAST(id % 50 AS VARCHAR) AS id FROM {checked} WHERE NOT pass AND viewport = 'mobile')
SELECT *, 'new' AS delta FROM (FROM c EXCEPT FROM p) UNION ALL SELECT *, 'resolved' FROM (FROM p EXCEPT FROM c)"""
DUCK_VIEWS["idelta"] = """
WITH i AS (SELECT run_id, id % 40 AS issue, viewport, min(CASE id % 5 WHEN 0 THEN 'fixed' WHEN 1 THEN 'accepted_by_user' WHEN 2 THEN 'open' WHEN 3 THEN 'renderer_only_drift' ELSE 'pending' END) AS status FROM {checked} GROUP BY run_id, id % 40, viewport),
j AS (SELECT coalesce(p.run_id, c.run_id) AS run_id, coalesce(p.issue, c.issue) AS issue, p.status AS before, c.status AS after FROM (SELECT * FROM i WHERE viewport = 'desktop') p FULL JOIN (SELECT * FROM i WHERE viewport = 'mobile') c ON c.run_id = p.run_id AND c.issue = p.issue)
SELECT *, CASE WHEN before IS NULL THEN 'new' WHEN after IS NULL THEN 'other' WHEN before IN ('open', 'pending') AND after NOT IN ('open', 'pending') THEN 'resolved' WHEN before NOT IN ('open', 'pending') AND after IN ('open', 'pending') THEN 'regressed' WHEN before = after THEN 'unchanged' ELSE 'other' END AS delta FROM j"""


def fdelta(spark, d):
    bad = checks(spark, d).filter("NOT pass").withColumn("id", F.concat_ws("-", "check_type", (F.col("id") % 50).cast("string")))
    return L.failure_delta(bad.filter("viewport = 'desktop'"), bad.filter("viewport = 'mobile'"))


def idelta(spark, d):
    status = F.when(F.col("id") % 5 == 0, "fixed").when(F.col("id") % 5 == 1, "accepted_by_user").when(F.col("id") % 5 == 2, "open").when(F.col("id") % 5 == 3, "renderer_only_drift").otherwise("pending")
    i = checks(spark, d).groupBy("run_id", (F.col("id") % 40).alias("issue"), "viewport").agg(F.min(status).alias("status"))
    return L.issue_delta(i.filter("viewport = 'desktop'"), i.filter("viewport = 'mobile'"))


@query("failure_delta", "SELECT * FROM {fdelta}")
def _(spark, d):
    return fdelta(spark, d)


@query("issue_delta", "SELECT * FROM {idelta}")
def _(spark, d):
    return idelta(spark, d)


@query("run_summary", """
SELECT c.*, coalesce(nf, 0) AS new_failures, coalesce(rf, 0) AS resolved_failures, coalesce(rg, 0) AS regressed, CASE WHEN failed = 0 THEN 'pass' ELSE 'fail' END AS status FROM (SELECT run_id, viewport, count(*) AS checks, count(*) FILTER (NOT pass) AS failed FROM {checked} GROUP BY ALL) c
LEFT JOIN (SELECT run_id, count(*) FILTER (delta = 'new') AS nf, count(*) FILTER (delta = 'resolved') AS rf FROM {fdelta} GROUP BY run_id) f ON f.run_id = c.run_id LEFT JOIN (SELECT run_id, count(*) FILTER (delta = 'regressed') AS rg FROM {idelta} GROUP BY run_id) i ON i.run_id = c.run_id""")
def _(spark, d):
    return L.run_summary(checks(spark, d), fdelta(spark, d), idelta(spark, d))


define_view("desired", "SELECT l_suppkey AS site, l_partkey AS page, l_orderkey * 10 + l_linenumber AS id, min(l_quantity) AS value, CAST(2 AS DOUBLE) AS tolerance, CASE WHEN l_partkey % 5 = 0 THEN '' ELSE 'sheet' END AS source, l_orderkey % 3 = 0 AS critical FROM {lineitem} GROUP BY l_suppkey, l_partkey, l_orderkey, l_linenumber")
define_view("actuals", "SELECT l_suppkey AS site, l_partkey AS page, l_orderkey * 10 + l_linenumber AS id, min(l_quantity) + l_orderkey % 4 AS value FROM {lineitem} WHERE l_orderkey % 11 <> 0 GROUP BY l_suppkey, l_partkey, l_orderkey, l_linenumber")


@query("geometry_audit", """
SELECT *, critical_failures = 0 AND unsourced = 0 AS ok FROM (SELECT d.site, d.page, count(*) FILTER (source <> '' AND abs(a.value - d.value) <= 2) AS matched, count(*) FILTER (source <> '' AND abs(a.value - d.value) > 2) AS drifted, count(*) FILTER (source <> '' AND a.value IS NULL) AS missing, count(*) FILTER (source = '') AS unsourced,
 count(*) FILTER (source <> '' AND critical AND (a.value IS NULL OR abs(a.value - d.value) > 2)) AS critical_failures FROM {desired} d LEFT JOIN {actuals} a ON a.site = d.site AND a.page = d.page AND a.id = d.id GROUP BY d.site, d.page) t""")
def _(spark, d):
    return L.geometry_audit(view(spark, d, "desired"), view(spark, d, "actuals"))


define_view("width_shots", "SELECT l_suppkey AS site, l_orderkey AS page, CASE l_linenumber % 4 WHEN 0 THEN 1440 WHEN 1 THEN 768 WHEN 2 THEN 390 ELSE 320 END AS width, l_quantity > 5 AS ok FROM {lineitem}")


@query("breakpoint_summary", """
SELECT site, page, all_ok, m AS missing, all_ok AND m = '' AS ok FROM (SELECT site, page, bool_and(ok) AS all_ok, concat_ws(',', CASE WHEN NOT bool_or(width = 1440) THEN '1440' END, CASE WHEN NOT bool_or(width = 768) THEN '768' END, CASE WHEN NOT bool_or(width = 390) THEN '390' END) AS m FROM {width_shots} GROUP BY ALL) t""")
def _(spark, d):
    return L.breakpoint_summary(view(spark, d, "width_shots").withColumn("width", F.col("width").cast("bigint")), [1440, 768, 390])


define_view("score_rows", "SELECT l_suppkey AS site, l_orderkey AS page, max(l_partkey) % 4 <> 0 AS built, max(l_partkey) % 3 = 0 AS fidelity, max(l_quantity) AS compare, CAST(count(*) AS BIGINT) AS nav_broken, CAST(min(l_linenumber) AS BIGINT) AS dead_links, CAST(max(l_linenumber) AS BIGINT) AS components FROM {lineitem} GROUP BY l_suppkey, l_orderkey")


@query("scorecard", """
WITH r AS (SELECT site, page, built, coalesce(fidelity AND page % 2 = 0, false) AS fidelity, CASE WHEN page % 3 = 0 THEN compare END AS compare, CASE WHEN page % 5 = 0 THEN nav_broken ELSE 0 END AS nav_broken, CASE WHEN page % 7 = 0 THEN dead_links ELSE 0 END AS dead_links, components FROM {score_rows})
SELECT site, page, CASE WHEN built THEN 100.0 ELSE 0 END::DOUBLE AS built, CASE WHEN fidelity THEN 100.0 ELSE 0 END::DOUBLE AS fidelity, compare, nav_broken, dead_links, components FROM r
UNION ALL SELECT site, NULL, round(100.0 * avg(built::INT::DOUBLE), 0), round(100.0 * avg(fidelity::INT::DOUBLE), 0), round(avg(compare), 1), CAST(sum(nav_broken) AS BIGINT), CAST(sum(dead_links) AS BIGINT), CAST(sum(components) AS BIGINT) FROM r GROUP BY site""")
def _(spark, d):
    r = view(spark, d, "score_rows")
    k = ["site", "page"]
    return L.scorecard(r.select(*k, "built"), r.filter("page % 2 = 0").select(*k, "fidelity"), r.filter("page % 3 = 0").select(*k, "compare"), r.filter("page % 5 = 0").select(*k, "nav_broken"), r.filter("page % 7 = 0").select(*k, "dead_links"), r.select(*k, "components"))
