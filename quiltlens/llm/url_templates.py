"""URL filter: rules first, then a path-template tree with smoothed labelled purity (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quiltlens.session import materialize

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
VARIABLE = r"^([0-9]+|[0-9a-f]{8,}|[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}|[0-9]{4}-[0-9]{2}-[0-9]{2})(\.[A-Za-z0-9]{1,5})?$"
MIN_CHILDREN, SPREAD, Z2 = 16, 0.3, 2.7
SMOOTHING, REJECT_AT = 8.0, 0.5


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, ADDRESS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest matching rule and its verdict (null where none matches); of equally long rules the first."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        hit = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(hit, F.lit(h + p)).otherwise(name), F.when(hit, F.lit(v)).otherwise(verdict)
    return name, verdict


def path_templates(urls: DataFrame) -> DataFrame:
    """``urls(host, path, n, labelled, bad)`` → ``(host, path, template)``, one row per distinct host and typed path.

    The tree of a host has one level per path segment. Segments that look like numbers, hashes or dates are wildcards
    at once. A node with at least 16 children, and more than 0.3 children per visit, has a variable segment, too.
    Of the other children of a node, a branch joins its siblings of the same structure (same smallest and largest
    rest of the path) if its labelled share of bad pages lies within the sampling error of theirs pooled
    (squared distance at most 2.7 times the variance, i.e. 90 percent); branches without labels join nobody.
    Every comparison is with a pooled sum, never between pairs, so a host with any number of branches is partial sums.
    """
    steps = urls.select("host", "path", "n", "labelled", "bad", F.split("path", "/").alias("segs")).select(
        "host", "path", "n", "labelled", "bad", "segs", F.posexplode("segs").alias("depth", "seg"))
    node = ["host", "parent", "seg"]
    steps = steps.select(
        "host", "path", "n", "labelled", "bad", "depth", "seg",
        F.array_join(F.expr("slice(segs, 1, depth)"), "/").alias("parent"), F.array_join(F.expr("slice(segs, depth + 2, size(segs))"), "/").alias("rest"))
    branches = steps.groupBy(*node).agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.min("rest").alias("lo"), F.max("rest").alias("hi"))
    fan = branches.groupBy("host", "parent").agg(F.count("*").alias("children"), F.sum("n").alias("visits"))
    pool = branches.filter("labelled > 0 AND seg <> '*'").groupBy("host", "parent", "lo", "hi").agg(
        F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"), F.count("*").alias("alike"))
    b = branches.join(fan, ["host", "parent"]).join(pool, ["host", "parent", "lo", "hi"], "left")
    share, pooled = F.col("bad") / F.col("labelled"), F.col("all_bad") / F.col("all_labelled")
    near = (share - pooled) * (share - pooled) * F.col("labelled") <= Z2 * (pooled * (1 - pooled) + 0.25 / F.col("labelled"))
    named = b.select(*node, F.when((F.col("children") >= MIN_CHILDREN) & (F.col("children") > SPREAD * F.col("visits")), "*")
                     .when((F.col("labelled") > 0) & (F.col("seg") != "*") & (F.col("alike") > 1) & near, "~").otherwise(F.col("seg")).alias("name"))
    s = steps.select("host", "path", "depth", "parent", "seg").join(named, node)
    parts = s.groupBy("host", "path").agg(F.array_sort(F.collect_list(F.struct("depth", "name"))).alias("parts"))  # one entry per segment of one path
    return parts.select("host", "path", F.array_join(F.col("parts.name"), "/").alias("template"))


def url_filter(pages: DataFrame, labels: DataFrame | None = None, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url",
               smoothing: float = SMOOTHING, reject_at: float = REJECT_AT) -> DataFrame:
    """One row per page: ``id_col, host, path, rule, verdict, template, labelled, purity``.

    ``labels(id, bad)`` has 1 for a bad and 0 for a good page. A page that no rule fits is blocked if its template has
    labels and its smoothed purity ``(bad + smoothing * base rate) / (labelled + smoothing)`` reaches ``reject_at``.
    A null url, or one without ``://``, has empty host and path and the template of the empty path. Repeated labels of
    an id count once, as bad if any is; null ids or verdicts in labels are ignored. Every input row gives one row.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    base = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url")).select("id", host.alias("host"), path.alias("path"))
    typed = F.array_join(F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), lambda s: F.when(s.rlike(VARIABLE), F.lit("*")).otherwise(s)), "/")
    base = base.withColumn("typed", typed)
    if labels is not None:
        known = labels.select(labels["id"].alias("lid"), labels["bad"].cast("int").alias("bad")).dropna().groupBy("lid").agg(F.max("bad").alias("bad"))
        base = base.join(known, base["id"] == known["lid"], "left").drop("lid")
    else:
        base = base.withColumn("bad", F.lit(None).cast("int"))
    base = materialize(base, "urls")
    urls = base.groupBy("host", F.col("typed").alias("path")).agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    urls = materialize(urls, "typed-urls")
    tree = urls.join(path_templates(urls), ["host", "path"])
    total = urls.agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled")).first()
    rate = total["bad"] / total["labelled"] if total["labelled"] else 0.0
    whole = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    whole = whole.select("host", "template", "labelled", ((F.col("bad") + smoothing * rate) / (F.col("labelled") + smoothing)).alias("purity"))
    judged = materialize(tree.select("host", "path", "template").join(whole, ["host", "template"]).select("host", F.col("path").alias("typed"), "template", "labelled", "purity"), "templates")
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("labelled") > 0) & (F.col("purity") >= reject_at), "block").otherwise("allow")
    return base.join(judged, ["host", "typed"]).select(
        F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(said, own).alias("verdict"), "template", "labelled", "purity")
