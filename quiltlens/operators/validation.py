"""Validation over measured metrics: verdicts, thresholds, deltas, scorecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


# Allowed difference per profile and check type (sections in percent, text and spacing in px, colours in CIE76).
PROFILES = {
    "lenient": {"section": 2.5, "text": 3.0, "spacing": 2.0, "color": 4.0}, "portable": {"section": 1.0, "text": 2.0, "spacing": 1.0, "color": 2.5},
    "strict": {"section": 0.5, "text": 1.0, "spacing": 1.0, "color": 1.5}, "ultra": {"section": 0.25, "text": 0.5, "spacing": 0.5, "color": 1.0},
}
# Statuses that close an issue.
CLOSED = ["fixed", "accepted_by_user", "renderer_only_drift"]


def match_shots(shots: DataFrame, sections: DataFrame) -> DataFrame:
    """Shot per section: by ``NN ·`` number, then slug, then slug with spaces; first shot wins.

    All three rules are equality joins on one key column; the best rule per section is kept.
    """
    keys = shots.select("site", "shot", F.posexplode(F.array(F.regexp_extract("label", r"^\s*(\d+)\s*·", 1), F.lower("label"), F.lower(F.regexp_replace("label", "[-_]", " ")))).alias("rule", "key"))
    want = sections.select("site", "section", F.posexplode(F.array(F.col("nn"), F.lower("slug"), F.lower(F.regexp_replace("slug", "[-_]", " ")))).alias("rule", "key"))
    hits = want.filter("key <> ''").join(keys, ["site", "rule", "key"])
    return hits.groupBy("site", "section").agg(F.min(F.struct("rule", "shot")).alias("b")).select("site", "section", F.col("b.shot").alias("shot"), F.col("b.rule").cast("bigint").alias("rule"))


def _hole() -> Column:
    """A section without children against a source with content, or a white shot against a filled source."""
    return (
        F.when((F.coalesce("children", F.lit(1)) == 0) & (F.col("source_white") < 0.75), "empty frame")
        .when((F.col("built_white") > 0.82) & (F.col("source_white") < 0.55), "white ratio differs")
    )


def shot_verdicts(shots: DataFrame) -> DataFrame:
    """``shots(scope, source_white, built_white, children, ...)``; whole boards have looser limits than sections."""
    board = F.when((F.col("built_white") > 0.72) & (F.col("source_white") < 0.50), "board displaced")
    return shots.withColumn("verdict", F.when(F.col("scope") == "board", board).otherwise(_hole())).filter("verdict IS NOT NULL")


def seed_verdicts(shots: DataFrame, cap: float = 2000) -> DataFrame:
    """First rule that hits: colour wash, spill, shift, system font, layout shift.

    An unreadable palette (null saturation) counts as a shift. A built shot exactly ``cap`` px high, narrowed, and of the
    source's aspect within 3 percent was scaled down as a whole, so its height ratio says nothing.
    """
    gap = sum((F.abs(F.col(f"built_{c}") - F.col(f"source_{c}")) for c in "gb"), F.abs(F.col("built_r") - F.col("source_r")))
    aspect = F.col("source_w") / F.col("source_h")
    capped = F.coalesce(
        (F.col("built_h") == cap) & (F.col("source_h") > 0) & (F.col("built_w") > 0) & (F.col("built_w") < 0.85 * F.col("source_w"))
        & (F.abs(F.col("built_w") / F.col("built_h") - aspect) / aspect < 0.03), F.lit(False))
    ratio = F.when((F.col("source_h") > 0) & (F.col("built_h") > 0), F.col("built_h") / F.col("source_h"))
    verdict = F.coalesce(
        F.when(F.col("source_sat").isNull() | F.col("built_sat").isNull(), "colour shift"),
        F.when((F.col("source_sat") >= 0.28) & (F.col("built_sat") < F.greatest(F.lit(0.12), 0.45 * F.col("source_sat"))), "colour wash"),
        F.when((F.col("source_sat") < 0.16) & (F.col("built_sat") >= 0.28) & (F.coalesce("coverage", F.lit(0.0)) >= 0.18)
               & (F.coalesce("coverage", F.lit(0.0)) >= F.coalesce("source_coverage", F.lit(0.0)) + 0.12), "colour spill"),
        F.when((F.col("source_sat") >= 0.28) & (gap > 90), "colour shift"), F.when(F.col("system_font"), "system font"),
        F.when(_hole().isNotNull() | (~capped & ((ratio < 0.5) | (ratio > 2.5))), "layout shift"),
    )
    return shots.select("site", "band", verdict.alias("verdict")).filter("verdict IS NOT NULL")


def threshold_checks(measures: DataFrame) -> DataFrame:
    """``measures(run_id, site, id, profile, check_type, expected, actual, lab1, lab2)`` → value, threshold, pass.

    Colours use the CIE76 distance of measured Lab triples, sections the difference in percent, text and spacing the difference.
    """
    limits = F.create_map(*[x for p, t in PROFILES.items() for k, v in t.items() for x in (F.lit(f"{p}/{k}"), F.lit(v))])
    delta = F.sqrt(sum((F.pow(F.col(f"lab1.{c}") - F.col(f"lab2.{c}"), 2) for c in ("a", "b")), F.pow(F.col("lab1.l") - F.col("lab2.l"), 2)))
    diff = F.abs(F.col("actual") - F.col("expected"))
    value = F.when(F.col("check_type") == "color", delta).when(F.col("check_type") == "section", F.coalesce(100 * diff / F.nullif(F.abs("expected"), F.lit(0.0)), diff)).otherwise(diff)
    return measures.withColumn("value", value).withColumn("threshold", limits[F.concat_ws("/", "profile", "check_type")]).withColumn("pass", F.col("value") <= F.col("threshold")).drop("lab1", "lab2", "expected", "actual")


def failed_checks(checks: DataFrame, n: int = 10) -> DataFrame:
    """The worst ``n`` failing checks per run by how far they pass the threshold."""
    bad = checks.filter("NOT pass").withColumn("severity", F.col("value") / F.col("threshold"))
    w = W.partitionBy("run_id").orderBy(F.desc("severity"), "id")
    return bad.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= n)


def failure_delta(previous: DataFrame, current: DataFrame) -> DataFrame:
    """New and resolved failing ids between two runs of ``(run_id, id)``."""
    p, c = previous.select("run_id", "id").distinct(), current.select("run_id", "id").distinct()
    on = ["run_id", "id"]
    return c.join(p, on, "left_anti").withColumn("delta", F.lit("new")).unionByName(p.join(c, on, "left_anti").withColumn("delta", F.lit("resolved")))


def issue_delta(previous: DataFrame, current: DataFrame) -> DataFrame:
    """``(run_id, issue, status)`` twice → new / resolved / regressed / unchanged / other.

    New is every issue that was not there before, whatever its status; other are those that are gone, or moved between
    two open or two closed statuses.
    """
    j = previous.select("run_id", "issue", F.col("status").alias("_p")).join(current.select("run_id", "issue", F.col("status").alias("_c")), ["run_id", "issue"], "full_outer")
    was, now = F.col("_p").isin(*CLOSED), F.col("_c").isin(*CLOSED)
    delta = F.when(F.col("_p").isNull(), "new").when(F.col("_c").isNull(), "other").when(~was & now, "resolved").when(was & ~now, "regressed").when(F.col("_p") == F.col("_c"), "unchanged").otherwise("other")
    return j.select("run_id", "issue", F.col("_p").alias("before"), F.col("_c").alias("after"), delta.alias("delta"))


def run_summary(checks: DataFrame, failures: DataFrame, issues: DataFrame) -> DataFrame:
    """Status, failed count and deltas per run and viewport."""
    base = checks.groupBy("run_id", "viewport").agg(F.count("*").alias("checks"), F.count_if(~F.col("pass")).alias("failed"))
    f = failures.groupBy("run_id").agg(F.count_if(F.col("delta") == "new").alias("new_failures"), F.count_if(F.col("delta") == "resolved").alias("resolved_failures"))
    i = issues.groupBy("run_id").agg(F.count_if(F.col("delta") == "regressed").alias("regressed"))
    out = base.join(f, "run_id", "left").join(i, "run_id", "left").na.fill(0, ["new_failures", "resolved_failures", "regressed"])
    return out.withColumn("status", F.when(F.col("failed") == 0, "pass").otherwise("fail"))


def geometry_audit(desired: DataFrame, actual: DataFrame) -> DataFrame:
    """Per page: matched, drifted and missing measures; a missing one is not a drift; unsourced wishes do not count."""
    j = desired.join(actual.select("site", "page", "id", F.col("value").alias("_v")), ["site", "page", "id"], "left")
    told = F.coalesce(F.trim("source") != "", F.lit(False))
    off = F.abs(F.col("_v") - F.col("value")) > F.col("tolerance")
    return j.groupBy("site", "page").agg(
        F.count_if(told & F.col("_v").isNotNull() & ~off).alias("matched"), F.count_if(told & F.coalesce(off, F.lit(False))).alias("drifted"),
        F.count_if(told & F.col("_v").isNull()).alias("missing"), F.count_if(~told).alias("unsourced"),
        F.count_if(told & F.col("critical") & (F.col("_v").isNull() | off)).alias("critical_failures"),
    ).withColumn("ok", (F.col("critical_failures") == 0) & (F.col("unsourced") == 0))


def breakpoint_summary(shots: DataFrame, required: list[int]) -> DataFrame:
    """``shots(site, page, width, ok)``: missing required widths and whether all present ones pass."""
    have = shots.groupBy("site", "page").agg(F.collect_set(F.when(F.col("width").isin(*required), F.col("width"))).alias("_w"), F.bool_and("ok").alias("all_ok"))
    lost = F.array_except(F.array(*[F.lit(w).cast("bigint") for w in required]), F.col("_w"))
    return have.select("site", "page", "all_ok", F.array_join(lost, ",").alias("missing"), (F.col("all_ok") & (F.size(lost) == 0)).alias("ok"))


def scorecard(pages: DataFrame, fidelity: DataFrame, compare: DataFrame, nav: DataFrame, links: DataFrame, components: DataFrame) -> DataFrame:
    """Per page flags and counts, and a total row per site with rounded percentages."""
    on = ["site", "page"]
    rows = pages
    for df in (fidelity, compare, nav, links, components):
        rows = rows.join(df, on, "left")
    rows = rows.select(
        *on, "built", F.coalesce("fidelity", F.lit(False)).alias("fidelity"), F.col("compare"), F.coalesce("nav_broken", F.lit(0).cast("bigint")).alias("nav_broken"),
        F.coalesce("dead_links", F.lit(0).cast("bigint")).alias("dead_links"), F.coalesce("components", F.lit(0).cast("bigint")).alias("components"),
    )
    pct = lambda c: F.round(100.0 * F.avg(c.cast("double")), 0)
    per_page = rows.select("site", "page", *[F.when(F.col(c), 100.0).otherwise(0.0).alias(c) for c in ("built", "fidelity")], F.col("compare"), "nav_broken", "dead_links", "components")
    totals = rows.groupBy("site").agg(
        F.lit(None).cast("bigint").alias("page"), pct(F.col("built")).alias("built"), pct(F.col("fidelity")).alias("fidelity"), F.round(F.avg("compare"), 1).alias("compare"),
        F.sum("nav_broken").alias("nav_broken"), F.sum("dead_links").alias("dead_links"), F.sum("components").alias("components"),
    )
    return per_page.unionByName(totals)
