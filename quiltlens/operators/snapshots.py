"""Snapshots and diffs: content signatures, set and multiset comparison, review state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quiltlens.functions import markup as M
from quiltlens.session import materialize

# Attributes a rewrite may change without changing the content.
FREE_ATTRS = ["alt", "role", "lang", "title", "tabindex", "for"]


def _locked_tag(token: Column) -> Column:
    """Tag with its attributes sorted and accessibility attributes dropped."""
    name = F.lower(F.regexp_extract(token, "^<(/?[a-zA-Z][a-zA-Z0-9-]*)", 1))
    attrs = M.all_matches(M.open_tag(token), r"""(?s)\s[a-zA-Z_:][a-zA-Z0-9_.:-]*\s*=\s*(?:"[^"]*"|'[^']*')""")
    pair = lambda a: F.concat_ws("=", F.lower(F.trim(F.regexp_extract(a, r"(?s)^\s*([^=\s]+)", 1))), F.regexp_extract(a, r"""(?s)=\s*["'](.*)["']$""", 1))
    free = lambda p: F.split(p, "=")[0].isin(*FREE_ATTRS) | p.startswith("aria-")
    kept = F.array_sort(F.filter(F.transform(attrs, pair), lambda p: ~free(p)))
    return F.concat(F.lit("<"), name, F.when(F.size(kept) > 0, F.concat(F.lit(" "), F.array_join(kept, " "))).otherwise(""), F.lit(">"))


def content_signature(corpus: DataFrame) -> DataFrame:
    """Hash of tags, locked attributes and text. Narrow: one row in, one row out."""
    tokens = corpus.select("site", "page_id", "path", M.all_matches(F.regexp_replace("html", "(?s)<!.*?>", ""), M.TOKEN).alias("t"))
    text = lambda x: M.squeeze(F.regexp_replace(x, r"(?s)^<[^>]*>", ""))
    parts = F.transform("t", lambda x: F.concat_ws("\n", _locked_tag(x), F.when(text(x) != "", text(x))))
    return tokens.select("site", "page_id", "path", F.sha2(F.array_join(parts, "\n"), 256).alias("signature"))


def verify_snapshot(then: DataFrame, now: DataFrame, allowed: DataFrame) -> DataFrame:
    """``(site, path, signature)`` twice → deleted / changed / added, without the allowed paths."""
    a, b = then.select("site", "path", F.col("signature").alias("_a")), now.select("site", "path", F.col("signature").alias("_b"))
    state = F.when(F.col("_b").isNull(), "deleted").when(F.col("_a").isNull(), "added").when(F.col("_a") != F.col("_b"), "changed")
    diff = a.join(b, ["site", "path"], "full_outer").withColumn("state", state).filter("state IS NOT NULL")
    return diff.join(allowed.select("site", "path"), ["site", "path"], "left_anti").select("site", "path", "state")


def freeze_compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(site, page, kind class|font-size|token|section, value, ord)`` twice.

    A class count that dropped, a font-size multiset that changed either way, a token set
    that changed, and section ids whose order or presence changed. Counts stand for the
    multisets, so nothing is paired item by item.
    """
    def counts(df: DataFrame, n: str) -> DataFrame:
        # for ordered ids the position is part of the value
        value = F.when(F.col("kind") == "section", F.concat_ws("@", "value", F.col("ord").cast("string"))).otherwise(F.col("value"))
        return df.groupBy("site", "page", "kind", value.alias("value")).agg(F.count("*").alias(n))

    j = counts(before, "b").join(counts(after, "a"), ["site", "page", "kind", "value"], "full_outer").na.fill(0, ["a", "b"])
    bad = (
        F.when(F.col("kind") == "class", F.col("a") < F.col("b")).when(F.col("kind") == "font-size", F.col("a") != F.col("b"))
        .otherwise((F.col("a") > 0) != (F.col("b") > 0))
    )
    return j.filter(bad).select("site", "page", "kind", "value", F.col("b").alias("before"), F.col("a").alias("after"))


def multiset_missing(live: DataFrame, recorded: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose count on the recorded side is lower."""
    a, b = live.groupBy(*keys).agg(F.count("*").alias("live")), recorded.groupBy(*keys).agg(F.count("*").alias("recorded"))
    return a.join(b, keys, "left").na.fill(0, ["recorded"]).filter("recorded < live")


NUMERIC = ["x", "y", "width", "height", "fontSize"]


def geometry_diff(before: DataFrame, after: DataFrame, ignored: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """``(site, board, node_id, prop, value)`` twice: missing sides, numeric change over 0.5, text change.

    Line heights in px are compared as percents of the node's own font size, given as ``font_size``.
    """
    def prepared(df: DataFrame, side: str) -> DataFrame:
        number = F.regexp_extract("value", r"^(-?[0-9.]+)", 1).try_cast("double")
        percent = F.when(F.col("value").endswith("px"), number / F.col("font_size") * 100).when(F.col("value").endswith("%"), number).otherwise(number * 100)
        n = F.when(F.col("prop") == "lineHeight", percent).when(F.col("prop").isin(*NUMERIC), number)
        return df.join(ignored, ["site", "board"], "left_anti").select("site", "board", "node_id", "prop", F.col("value").alias(side), n.alias(f"{side}_n"))

    j = prepared(before, "before").join(prepared(after, "after"), ["site", "board", "node_id", "prop"], "full_outer")
    kind = (
        F.when(F.col("after").isNull(), "removed").when(F.col("before").isNull(), "added")
        .when(F.col("before_n").isNotNull() & F.col("after_n").isNotNull(), F.when(F.abs(F.col("before_n") - F.col("after_n")) > tolerance, "moved"))
        .when(F.col("before") != F.col("after"), "changed")
    )
    return j.withColumn("kind", kind).filter("kind IS NOT NULL").select("site", "board", "node_id", "prop", "before", "after", "kind")


MANIFEST_LEAF = 256  # lines hashed together, on average; then 16 digests at a time


def manifest_digest(files: DataFrame, leaf: int = MANIFEST_LEAF) -> DataFrame:
    """One digest per (run, phase) of ``files(run_id, phase, path, sha256, bytes)``, whatever the order of the rows.

    A tree of hashes: lines are dealt by the first hex digits of their own hash, as many digits as the phase's number of
    different lines asks for so that about ``leaf`` lines meet; sixteen digests at a time are hashed until one is left.
    A line that repeats is one line with its count. So the tree's depth grows with the logarithm of the largest phase,
    and no task holds more than a bounded number of lines of it.
    """
    counted = files.groupBy("run_id", "phase", F.concat_ws(" ", "path", "sha256").alias("line")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    totals = counted.groupBy("run_id", "phase").agg(F.count("*").alias("lines"), F.sum("n").alias("files"), F.sum("bytes").alias("bytes"))
    digits = F.greatest(F.lit(0), F.ceil(F.log(F.col("lines") / leaf) / F.log(F.lit(16.0)))).cast("int")
    totals = materialize(totals.withColumn("digits", digits), "manifest-totals")
    rows = counted.join(totals.select(F.col("run_id").alias("_r"), F.col("phase").alias("_p"), "digits"), F.col("run_id").eqNullSafe(F.col("_r")) & F.col("phase").eqNullSafe(F.col("_p")))
    told = F.concat_ws(" ", "line", F.col("n").cast("string"))
    level = rows.select("run_id", "phase", F.expr("substring(sha2(line, 256), 1, digits)").alias("key"), told.alias("told"))
    for depth in range(totals.agg(F.max("digits")).first()[0] or 0, -1, -1):
        # groups of the deepest level left become one digest each; shallower phases wait
        here = level.filter(F.length("key") == depth).groupBy("run_id", "phase", "key").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("told")), "\n"), 256).alias("digest"))
        up = here.select("run_id", "phase", F.expr(f"substring(key, 1, {max(0, depth - 1)})").alias("key"), F.concat_ws(" ", "key", "digest").alias("told"))
        if not depth:
            done = here.select(F.col("run_id").alias("_r"), F.col("phase").alias("_p"), "digest")
            return totals.join(done, F.col("run_id").eqNullSafe(F.col("_r")) & F.col("phase").eqNullSafe(F.col("_p"))).select("run_id", "phase", "digest", "files", "bytes")
        level = level.filter(F.length("key") < depth).unionByName(up)


def finding_validity(findings: DataFrame, snapshot: DataFrame, current: DataFrame) -> DataFrame:
    """Why a finding does not count: missing fields, wrong phase, unknown or stale input digest, thin evidence.

    ``findings(run_id, phase, key, agent, finding_phase, severity, source, evidence, suggestion, digest, words_seen, patch_scoped)``;
    a finding is called stale only if nothing is wrong with its own fields; digests come from ``manifest_digest`` at planning time and now.
    """
    s, c = snapshot.select("run_id", "phase", F.col("digest").alias("_s")), current.select("run_id", "phase", F.col("digest").alias("_c"))
    j = findings.join(s, ["run_id", "phase"], "left").join(c, ["run_id", "phase"], "left")
    blank = lambda x: F.coalesce(F.trim(x) == "", F.lit(True))
    any_blank = blank("key") | blank("severity") | blank("source") | blank("evidence") | blank("suggestion")
    errors = F.array_compact(F.array(
        F.when(any_blank, "missing field"),
        F.when(~F.col("finding_phase").eqNullSafe(F.col("phase")), "wrong phase"), F.when(blank("agent") | F.col("agent").rlike(r"[/\\]"), "bad agent"),
        F.when(F.col("_s").isNull() | ~F.col("digest").eqNullSafe(F.col("_s")), "not from this snapshot"),
    ))
    more = F.array_compact(F.array(
        F.when((F.size(errors) == 0) & ~F.col("_s").eqNullSafe(F.col("_c")), "stale"),
        F.when((F.col("phase") == "review") & (F.col("words_seen") < 12), "thin evidence"),
        F.when((F.col("phase") == "polish") & ~F.col("patch_scoped"), "patch not scoped"),
    ))
    return j.select("run_id", "phase", "key", F.explode(F.concat(errors, more)).alias("reason"))


def band_review_state(bands: DataFrame, reviews: DataFrame, max_reopen: int = 1) -> DataFrame:
    """Latest review per band: never looked, ok, miss, or stale after an edit; stale bands are restamped
    when the picture is unchanged, reopened a bounded number of times, then left as residual.

    ``bands(site, page, band, digest, picture)``, ``reviews(site, page, band, round, verdict, digest, picture, reopened)``.
    """
    last = reviews.groupBy("site", "page", "band").agg(F.max_by(F.struct("round", "verdict", "digest", "picture", "reopened"), "round").alias("r"))
    j = bands.join(last, ["site", "page", "band"], "left")
    stale = F.col("r.digest") != F.col("digest")
    state = F.when(F.col("r").isNull(), "never looked").when(stale, "stale").when(F.col("r.verdict") != "ok", "miss").otherwise("ok")
    action = (
        F.when(F.col("r").isNull(), "look").when(stale & (F.col("r.picture") == F.col("picture")), "restamp")
        .when(stale & (F.col("r.reopened") < max_reopen), "reopen").when(stale, "residual").when(F.col("r.verdict") != "ok", "fix").otherwise("none")
    )
    return j.select("site", "page", "band", state.alias("state"), action.alias("action"), F.col("r.round").alias("round"))


def band_coverage(assigned: DataFrame, clips: DataFrame) -> DataFrame:
    """Clips no band uses and bands without a clip, from ``assign_clips`` output.

    Bands and clips meet in one grouping by page and subject, so that ``assigned`` is worked out and shuffled once.
    """
    bare = F.col("clip").isNull()
    bands = assigned.select("site", "page", bare.alias("bare"), F.coalesce("clip", "pos").alias("subject"), F.lit(True).alias("band"))
    known = clips.select("site", "page", F.lit(False).alias("bare"), F.col("clip").alias("subject"), F.lit(False).alias("band"))
    met = bands.unionByName(known).groupBy("site", "page", "bare", "subject").agg(F.max("band").alias("band"), F.count("*").alias("_n"))
    once = F.when(F.col("bare"), F.col("_n")).otherwise(1).cast("int")  # bands that share a position are told one by one
    return met.filter("bare OR NOT band").select(
        "site", "page", F.when(F.col("bare"), "band without clip").otherwise("clip without band").alias("kind"), "subject", F.explode(F.array_repeat(F.lit(0), once))
    ).drop("col")
