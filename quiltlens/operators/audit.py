"""Page structure audit.

Every check is a filter over the element table of a page (``operators/elements``), inside the page's row, so the whole
audit is one narrow scan: nothing is shuffled before the roll-up. Only the heading titles (F3, F4), which are ranked per
section, are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quiltlens.functions import markup as M
from quiltlens.operators import elements as E
from quiltlens.operators.inventory import dedupe_first

# Word lists of the audit rules.
CARD_HINT = r"(?i)\b(card|tile|post|entry|member|quote|testimonial|service|feature)s?\b"
CLUSTER_WORDS = r"(?i)\b(services?|testimonials?|blog|posts?|team|features?|articles?|gallery|work|projects?|cases?)\b"
MOBILE_NAV = "(?i)mobile|drawer|hamburger|offcanvas|off-canvas"
DECOR_HINT = r"(?i)check(?:mark)?|tick|✓|✔|scribble|swirl|blob|decor|divider|ornament|bg[-_]?graphic|paint|confetti"
TEXT_KINDS = ["email", "text", "search", "tel", "url"]
SOCIAL = "(?i)twitter|linkedin|facebook|instagram|github"
SUBMIT_LABELS = ["join", "subscribe", "sign up", "sign-up"]
CHROME_SLUG = r"(?i)^(header|nav|navbar|navigation|footer|main)(--|-2|-\d+)?$"
SKIP_LINK = r"(?i)skip(?:\s+|-)?(?:to(?:\s+|-)?(?:content|main)|link)|\bskip(?:-?to)?(?:-?content|-?main|-?link)?\b"
SAID = ["class", "style", "id", "data-name", "layer-name", "data-paper-name", "data-paper-section", "alt", "src"]  # what an element is called
CLUSTER_NAMES = ["id", "data-paper-section", "data-name", "layer-name", "data-paper-name", "class"]
SIZE_PX = {
    "xs": 12, "sm": 14, "base": 16, "lg": 18, "xl": 20, "2xl": 24, "3xl": 30, "4xl": 36,
    "5xl": 48, "6xl": 60, "7xl": 72, "8xl": 96, "9xl": 128, "10xl": 160, "11xl": 192, "12xl": 224,
}
SIZE_TOLERANCE_PX = 1.05
HEADING_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6"]


def finding(check: str, kind: Column | str, detail: Column | str = "") -> Column:
    to = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(F.lit(check).alias("check"), to(kind).alias("kind"), to(detail).alias("detail"))


def _stack(*cases: Column) -> Column:
    return F.array_compact(F.array(*cases))


def heading_findings() -> Column:
    """No h1, more than one, or a level that is skipped; headings without words don't count."""
    levels = F.col("_levels")
    ones = F.size(F.filter(levels, lambda v: v == 1))
    pairs = F.arrays_zip(levels.alias("a"), F.slice(levels, F.lit(2), F.greatest(F.size(levels) - 1, F.lit(0))).alias("b"))
    skipped = F.exists(pairs, lambda p: F.coalesce(p["b"] > p["a"] + 1, F.lit(False)))
    return _stack(
        F.when(ones == 0, finding("heading", "0 h1")),
        F.when(ones > 1, finding("heading", ">1 h1")),
        F.when(skipped, finding("heading", "skipped levels")),
    )


def landmark_findings() -> Column:
    navs = F.col("_navs")
    stray = F.exists(navs, lambda n: ~E.under(n, "header", "main") & ~E.blob(n, *SAID).rlike(MOBILE_NAV))
    has = lambda tag: F.exists("els", lambda e: e["tag"] == tag)
    main_id = E.attr(F.get(E.of_tag("main"), F.lit(0)), "id")
    return _stack(
        F.when((F.size(navs) > 0) & ~has("header"), finding("landmark", "nav without header")),
        F.when(stray & has("header"), finding("landmark", "nav outside header")),
        F.when(has("section") & ~has("main"), finding("landmark", "main missing")),
        F.when(has("main") & (main_id != "main-content"), finding("landmark", "main has wrong id", main_id)),
        F.when(~has("footer") & F.lower("said").rlike("all rights reserved|copyright|©"), finding("landmark", "footer missing")),
        F.when(F.exists(navs, lambda n: (E.attr(n, "aria-label") == "") & (E.attr(n, "aria-labelledby") == "")), finding("landmark", "unlabeled nav")),
    )


def input_findings() -> Column:
    """Text-like inputs with no label element around or for them, no aria label and no title."""
    fors = F.transform(E.of_tag("label"), lambda e: E.attr(e, "for"))
    kind = lambda e: F.when((e["tag"] == "textarea") | (E.attr(e, "type") == ""), "text").otherwise(F.lower(E.attr(e, "type")))
    named = lambda e: (
        (E.attr(e, "aria-label") != "") | (E.attr(e, "aria-labelledby") != "") | (F.trim(E.attr(e, "title")) != "")
        | E.under(e, "label") | ((E.attr(e, "id") != "") & F.array_contains(fors, E.attr(e, "id")))
    )
    lost = F.filter(E.of_tag("input", "textarea"), lambda e: kind(e).isin(*TEXT_KINDS) & ~named(e))
    return F.transform(lost, lambda e: finding("input", "unlabeled input", kind(e)))


def alt_findings() -> Column:
    """Images without alt that are not decorative: marked so, inside something marked so, or called so."""
    decor = lambda e: E.attr(e, "data-decorative").isin("true", "1") | E.under(e, "decorative") | E.blob(e, *SAID).rlike(DECOR_HINT)
    lost = F.filter(E.of_tag("img"), lambda e: ~E.has_attr(e, "alt") & ~decor(e))
    return F.transform(lost, lambda e: finding("image", "missing alt", E.attr(e, "src")))


def section_tag_findings(section_attr: str = "data-section") -> Column:
    """Named content bands that are still plain ``div`` elements."""
    bands = F.filter(F.transform(E.of_tag("div"), lambda e: F.trim(E.attr(e, section_attr))), lambda s: (s != "") & ~s.rlike(CHROME_SLUG))
    return F.transform(bands, lambda s: finding("section", "band is a div", s))


def footer_findings() -> Column:
    foot, parts = F.col("_foot"), F.col("_parts")
    icons = F.filter(parts, lambda e: e["tag"].isin("img", "svg") & ~F.coalesce(e["near"]["a"] > foot["i"], F.lit(False)) & F.concat_ws(" ", F.map_values(e["attrs"])).rlike(SOCIAL))
    email = F.exists(parts, lambda e: (e["tag"] == "input") & ((F.lower(E.attr(e, "type")) == "email") | F.lower(E.attr(e, "placeholder")).contains("email")))
    submit = F.exists(parts, lambda e: (e["tag"].isin("input", "button") & ((F.lower(E.attr(e, "type")) == "submit") | F.lower(F.trim(E.attr(e, "value"))).isin(*SUBMIT_LABELS)))
                      | ((e["tag"] == "button") & F.lower(E.words(e)).isin(*SUBMIT_LABELS)))
    has = foot.isNotNull()
    return _stack(
        F.when(~has, finding("footer", "no footer")),
        F.when(has & ~F.exists(parts, lambda e: (e["tag"] == "a") & E.has_attr(e, "href")), finding("footer", "no links")),
        F.when(has & (F.size(icons) > 0), finding("footer", "social icon not linked", F.size(icons).cast("string"))),
        F.when(has & email & ~submit, finding("footer", "email without submit")),
    )


def card_findings() -> Column:
    """Containers in sections whose two or more cards are not articles.

    Children count as cards when all carry the same card word, or when the nearest section is named like a card cluster
    and every child looks like a card: an article, one called so, or one with a heading and words or a picture. A list
    item that holds nothing but an article is one.
    """
    hint = lambda e: F.lower(F.regexp_extract(E.blob(e, "class", "id"), CARD_HINT, 0))
    holds = lambda e, *tags: F.exists(E.inside(e), lambda d: d["tag"].isin(*tags))
    looks = lambda e: (e["tag"] == "article") | (hint(e) != "") | (holds(e, "h2", "h3", "h4") & holds(e, "p", "img"))
    only = lambda e: F.transform(E.children(e), lambda d: d["tag"])
    article = lambda e: (e["tag"] == "article") | E.under(e, "article") | ((e["tag"] == "li") & (only(e) == F.array(F.lit("article"))))
    held = F.filter("els", lambda e: (e["tag"] == "section") | (e["tag"].isin("div", "ul", "ol") & E.under(e, "section")))
    groups = F.transform(held, lambda e: F.struct(
        E.at(F.when(e["tag"] == "section", e["i"]).otherwise(e["near"]["section"])).alias("section"),
        F.filter(E.children(e), lambda d: d["tag"].isin("div", "article", "li", "a")).alias("kids")))
    groups = F.transform(F.filter(groups, lambda g: F.size(g["kids"]) >= 2), lambda g: F.struct(
        F.array_distinct(F.transform(g["kids"], hint)).alias("hints"), F.size(F.filter(g["kids"], lambda k: ~article(k))).alias("bare"),
        (E.blob(g["section"], *CLUSTER_NAMES).rlike(CLUSTER_WORDS) & F.forall(g["kids"], looks)).alias("structured"),
        F.coalesce(F.nullif(E.attr(g["section"], "id"), F.lit("")), F.nullif(E.attr(g["section"], "data-paper-section"), F.lit("")), F.lit("cluster")).alias("label")))
    same = lambda g: (F.size(g["hints"]) == 1) & (F.get(g["hints"], F.lit(0)) != "")
    lost = F.filter(groups, lambda g: (same(g) | g["structured"]) & (g["bare"] > 0))
    return F.transform(lost, lambda g: finding("card", "cards not articles", F.concat(F.lit("#"), g["label"], F.lit(" "), g["bare"].cast("string"))))


PAGE_CHECKS = {
    "heading": heading_findings, "landmark": landmark_findings, "input": input_findings,
    "image": alt_findings, "section": section_tag_findings, "footer": footer_findings, "card": card_findings,
}


AUDIT_CHECKS = [*PAGE_CHECKS, "title"]


def page_findings(pages: DataFrame, checks: list[str] | None = None) -> DataFrame:
    """Findings of the chosen page-local checks over ``page_elements``: ``(site, page_id, check, kind, detail)``."""
    # staged so that the shared parts of the checks are computed once per row
    heads = F.filter(E.of_tag(*HEADING_TAGS), lambda e: E.words(e) != "")
    staged = pages.select(
        "site", "page_id", "said", "els", F.transform(heads, lambda e: F.substring(e["tag"], 2, 1).cast("int")).alias("_levels"),
        F.filter(E.of_tag("nav"), lambda e: ~E.under(e, "footer")).alias("_navs"), F.get(E.of_tag("footer"), F.lit(0)).alias("_foot"),
    ).withColumn("_parts", F.coalesce(E.inside(F.col("_foot")), F.slice("els", 1, 0)))
    picked = [PAGE_CHECKS[c]() for c in (checks or PAGE_CHECKS)]
    return staged.select("site", "page_id", F.explode(F.concat(*picked)).alias("f")).select("site", "page_id", "f.check", "f.kind", "f.detail")


def card_cluster_defects(pages: DataFrame) -> DataFrame:
    return page_findings(pages, ["card"])


def title_findings(pages: DataFrame) -> DataFrame:
    """Sections of the pages whose top visual title is no heading (F4), as findings."""
    found = section_title_defects(title_nodes(pages))
    return found.select("site", F.col("page").alias("page_id"), F.lit("title").alias("check"), F.lit("section title is not a heading").alias("kind"), F.concat_ws(" ", "tag", "text").alias("detail"))


def audit_findings(pages: DataFrame) -> DataFrame:
    """All checks of all pages of ``page_elements``, as they are found; write them once before rolling them up."""
    return page_findings(pages).unionByName(title_findings(pages))


def audit_rollup(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """Per site and check, per site, and overall: pages, failing pages, findings, pass rate.

    Counts per page come first, as partial sums, and with them a row for every page without findings. Then one pass over
    grouping sets gives all levels; sums per site are partial, too, so a large site meets in no task.
    """
    page = page_counts(pages, findings)
    per_check = F.transform("checks", lambda c: F.struct(c["check"].alias("check"), c["n"].alias("n")))
    rows = page.select("site", F.explode(F.concat(F.array(F.struct(F.lit("all").alias("check"), F.col("findings").alias("n"))), per_check)).alias("c")).select("site", "c.check", "c.n")
    sums = rows.groupingSets([["site", "check"], ["check"]], "site", "check").agg(
        F.grouping("site").alias("_all"), F.count("*").alias("pages"), F.count_if(F.col("n") > 0).alias("failing_pages"), F.sum("n").alias("findings"))
    wanted = F.when(F.col("check") == "all", True).otherwise((F.col("_all") == 0) & (F.col("findings") > 0))
    return sums.filter(wanted).select(F.when(F.col("_all") == 1, "all").otherwise(F.col("site")).alias("site"), "check", "pages", "failing_pages", "findings",
                                      F.round((F.col("pages") - F.col("failing_pages")) / F.col("pages"), 4).alias("pass_rate"))


def page_counts(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """``site, page_id, findings, checks``: how many findings each page has, in all and for each check."""
    every = findings.select("site", "page_id", "check").unionByName(pages.select("site", "page_id", F.lit(None).cast("string").alias("check")))
    counts = [F.struct(F.lit(c).alias("check"), F.col(f"_{c}").alias("n")) for c in AUDIT_CHECKS]
    return every.groupBy("site", "page_id").agg(F.count("check").alias("findings"), *[F.count_if(F.col("check") == c).alias(f"_{c}") for c in AUDIT_CHECKS]).select(
        "site", "page_id", "findings", F.array(*counts).alias("checks"))


def landmark_counts(pages: DataFrame) -> DataFrame:
    """Landmarks, articles and first headings of each page, the id of its first main, and whether it has a skip link."""
    count = lambda tag: F.size(E.of_tag(tag)).cast("bigint")
    skips = F.exists(E.of_tag("a"), lambda e: E.has_attr(e, "href") & F.concat_ws(" ", E.attr(e, "class"), E.attr(e, "id"), E.words(e)).rlike(SKIP_LINK))
    return pages.select("site", "page_id", *[count(t).alias(t) for t in ("header", "nav", "main", "footer", "article", "h1")],
                        E.attr(F.get(E.of_tag("main"), F.lit(0)), "id").alias("main_id"), skips.alias("skip_link"))


def page_reports(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per page: whether it passes, its findings in all and per check (``check:n``), and its landmarks."""
    failed = F.transform(F.filter("checks", lambda c: c["n"] > 0), lambda c: F.concat_ws(":", c["check"], c["n"].cast("string")))
    counts = page_counts(pages, findings).select("site", "page_id", (F.col("findings") == 0).alias("ok"), "findings", F.array_join(failed, ";").alias("failed"))
    return counts.join(landmark_counts(pages), ["site", "page_id"])


# ---- visual headings -------------------------------------------------------------------------

# Size names in rising order, and the patterns of visual titles.
TITLE_SIZES = ["xl", "2xl", "3xl", "4xl", "5xl", "6xl", "7xl", "8xl", "9xl", "10xl", "11xl", "12xl"]
TITLE_TAGS = ["div", "p", "span", *HEADING_TAGS]
BOLD_CLASS, BOLD_STYLE = r"\bfont-(bold|extrabold)\b", r"(?i)font-weight:\s*(bold|700|800|900|var\(--font-weight-bold\))"
PRETTY_STYLE = r"(?i)text-wrap:\s*pretty"
STAT_TEXT = r"(?i)^(?:0?\d{1,2}|\d+x|[\d,]{1,3}(?:\.\d+)?%)$"
HEADING_NAME = r"(?i)(?:^|[\s_-])heading(?:$|[\s_-])|heading$"
TITLE_MAX, LABEL_MAX = 80, 40


def title_nodes(pages: DataFrame) -> DataFrame:
    """Visual title candidates of ``page_elements``: ``site, page, section, pos, size, pretty, named, tag, text, first_section``.

    A candidate is a text leaf of at most 80 characters that is set large, pretty, named as a heading or, in a section,
    bold; not in chrome, controls or decoration, no figure and no bold label. ``section`` is the place of the nearest
    section, else of the first one; ``first_section`` the first top one of main, or of the page without main (null: none).
    """
    first_main = F.get(E.of_tag("main"), F.lit(0))["i"]
    tops = F.filter(E.of_tag("section"), lambda e: ~E.under(e, "section") & (F.col("_main").isNull() | ((e["i"] > F.col("_main")) & (e["i"] <= E.at(F.col("_main"))["last"]))))
    leaf = lambda e: (E.words(e) != "") & (F.char_length(E.words(e)) <= TITLE_MAX) & ~F.exists(E.inside(e), lambda d: d["own"])
    plain = lambda e: ~E.under(e, "a", "button", "input", "textarea", "select", "nav", "header", "footer", "decorative") & ~E.attr(e, "data-decorative").isin("true", "1")
    able = pages.withColumn("_main", first_main).withColumn("_first", F.get(tops, F.lit(0))["i"]).select(
        "site", F.col("page_id").alias("page"), "_first", F.explode(F.transform(F.filter(E.of_tag(*TITLE_TAGS), lambda e: plain(e) & leaf(e)), lambda e: F.struct(e.alias("e"), E.words(e).alias("text")))).alias("c"))
    e, style, classes = F.col("c.e"), E.attr(F.col("c.e"), "style"), E.attr(F.col("c.e"), "class")
    name = F.coalesce(*[F.nullif(E.attr(e, n), F.lit("")) for n in ("data-name", "layer-name", "data-paper-name")], F.lit(""))
    scale = F.array(*[F.lit(n) for n in TITLE_SIZES])
    told = F.concat(M.all_matches(classes, r"\btext-([0-9]*xl)\b", 1), M.all_matches(F.concat_ws(" ", classes, style), r"--text-([0-9]*xl)\b", 1))
    rows = able.select("site", "page", F.coalesce(e["near"]["section"], "_first", F.lit(-1)).alias("section"), e["i"].alias("pos"),
                       F.coalesce(F.array_max(F.transform(told, lambda n: F.array_position(scale, n))), F.lit(0)).cast("bigint").alias("size"),
                       style.rlike(PRETTY_STYLE).alias("pretty"), name.rlike(HEADING_NAME).alias("named"), e["tag"].alias("tag"), F.col("c.text").alias("text"),
                       F.col("_first").alias("first_section"), (classes.rlike(BOLD_CLASS) | style.rlike(BOLD_STYLE)).alias("_bold"), E.under(e, "section").alias("_held"))
    large = F.col("pretty") | (F.col("size") >= 1)
    label = ~large & F.col("_bold") & (F.char_length("text") <= LABEL_MAX)
    shown = F.col("named") | ((large | (F.col("_bold") & F.col("_held"))) & ~F.col("text").rlike(STAT_TEXT) & ~label)
    return rows.filter(shown).drop("_bold", "_held")


def accepted_titles(nodes: DataFrame) -> DataFrame:
    """Title candidates after leads and wordmarks are dropped.

    ``nodes(site, page, section, pos, size, pretty, named, tag, text)``, perhaps with ``first_section``; without it the
    first section is the one with the smallest number. Facts per section come from partial aggregates, so one huge page
    or section never lands in one task's sort.
    """
    tops = nodes.groupBy("site", "page", "section").agg(F.max("size").alias("_max"))
    rows = nodes.join(tops, ["site", "page", "section"])
    if "first_section" in nodes.columns:
        rows = rows.withColumnRenamed("first_section", "_first")
    else:
        rows = rows.join(nodes.groupBy("site", "page").agg(F.min("section").alias("_first")), ["site", "page"])
    plain = ~F.col("pretty") & ~F.col("named")
    lead = plain & ~((F.col("size") >= F.col("_max")) & (F.col("size") >= 5))
    wordmark = (
        plain & (F.col("size") < 5) & ~F.trim("text").rlike(r"\s") & ~F.col("text").rlike("[.!?:]")
        & (F.col("_max") >= 5) & (F.col("size") < F.col("_max")) & (F.col("size") <= 3)
    )
    in_first = F.coalesce(F.col("section") == F.col("_first"), F.lit(False))
    return rows.filter(~F.when(in_first, lead).otherwise(wordmark)).withColumn("in_first", in_first).drop("_max", "_first")


def _order() -> Column:
    return F.struct((-F.col("size")).alias("a"), F.when(F.col("pretty"), 0).otherwise(1).alias("b"), F.col("pos").alias("c"))


def heading_ranks(nodes: DataFrame) -> DataFrame:
    """First section: largest title is h1, the rest h2. Other sections: one h2, the rest h3."""
    rows = accepted_titles(nodes)
    strong = F.col("pretty") | (F.col("size") >= 5) | F.col("named")
    lead = rows.groupBy("site", "page", "section").agg(
        F.min_by("pos", _order()).alias("_top"), F.min_by("pos", F.when(strong, _order())).alias("_strong")
    )
    best = F.when(F.col("in_first"), F.col("_top")).otherwise(F.coalesce("_strong", "_top"))
    is_best = F.col("pos") == best
    rank = F.when(F.col("in_first"), F.when(is_best, "h1").otherwise("h2")).otherwise(F.when(is_best, "h2").otherwise("h3"))
    return rows.join(lead, ["site", "page", "section"]).select("site", "page", "section", "pos", "tag", "text", rank.alias("rank"))


def section_title_defects(nodes: DataFrame) -> DataFrame:
    """Sections whose top visual title is not a heading element."""
    top = accepted_titles(nodes).groupBy("site", "page", "section").agg(F.min_by(F.struct("tag", "text"), _order()).alias("t"))
    return top.filter(~F.col("t.tag").isin(*HEADING_TAGS)).select("site", "page", "section", F.col("t.tag").alias("tag"), F.col("t.text").alias("text"))


def heading_coverage(nodes: DataFrame) -> DataFrame:
    missing = F.count_if(~F.col("tag").isin(*HEADING_TAGS))
    return accepted_titles(nodes).groupBy("site", "page").agg(
        F.count("*").alias("candidates"), (F.count("*") - missing).alias("accounted"), missing.alias("missing"), (missing == 0).alias("ok")
    )


# ---- type census -----------------------------------------------------------------------------

def _own_align(e: Column) -> Column:
    """Alignment that an element's style or else its classes name: start, end, center, justify, or null."""
    told = F.coalesce(
        F.nullif(F.regexp_extract(E.attr(e, "style"), r"(?i)text-align\s*:\s*(center|left|right|start|end|justify)", 1), F.lit("")),
        F.nullif(F.regexp_extract(E.attr(e, "class"), r"(?i)\btext-(center|left|right|start|end)\b", 1), F.lit("")),
    )
    told = F.lower(told)
    return F.when(told == "left", "start").when(told == "right", "end").otherwise(told)


def _own_size(e: Column) -> Column:
    """The largest size token that an element's classes or style name, or null."""
    said = E.blob(e, "class", "style")
    found = F.concat(M.all_matches(said, r"\btext-(xs|sm|base|lg|[0-9]*xl)\b", 1), M.all_matches(said, r"--text-(xs|sm|base|lg|[0-9]*xl)\b", 1))
    scale = F.array(*[F.lit(n) for n in SIZE_PX])
    biggest = F.array_max(F.transform(found, lambda n: F.array_position(scale, n)))
    return F.when(biggest > 0, F.concat(F.lit("text-"), F.element_at(scale, biggest.cast("int"))))


ROOTS = ["body", "html"]
WRAPPERS = 4  # ancestors that may set the alignment; two may set the size


def type_census(pages: DataFrame) -> DataFrame:
    """Headings and paragraphs of at most 200 characters with their alignment and size token.

    What the element itself doesn't say is read from its wrappers: the alignment from up to four below body, where
    centred flex content counts as centred text, the size from its parent or the one above.
    """
    rows = pages.select("site", "page_id", "els", F.posexplode(F.transform(E.of_tag(*HEADING_TAGS, "p"), lambda e: F.struct(e.alias("e"), E.words(e).alias("text")))).alias("pos", "c"))
    rows = rows.select("site", "page_id", "els", "pos", F.col("c.e").alias("e0"), F.col("c.text").alias("text")).filter((F.col("text") != "") & (F.char_length("text") <= 200))
    # the element and what it lies in, innermost first, up to the body
    rows = rows.withColumn("chain", F.array(F.col("e0")))
    for _ in range(WRAPPERS):
        top = F.element_at("chain", -1)
        rows = rows.withColumn("chain", F.concat("chain", F.filter(F.slice("els", F.greatest(top["parent"], F.lit(0)) + 1, F.when(top["parent"] < 0, 0).otherwise(1)), lambda e: ~e["tag"].isin(*ROOTS))))
    told = F.transform("chain", lambda e, k: F.coalesce(_own_align(e), F.when((k > 0) & E.blob(e, "class", "style").rlike(r"(?i)\bjustify-center\b"), "center")))
    align = F.get(F.array_compact(told), F.lit(0))
    size = F.get(F.array_compact(F.transform(F.slice("chain", 1, 3), _own_size)), F.lit(0))
    own = F.col("e0")
    return rows.select("site", "page_id", F.col("pos").cast("bigint").alias("pos"), own["tag"].alias("tag"), E.attr(own, "id").alias("element_id"),
                       align.alias("align"), size.alias("size"), "text")


def type_compare(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``expected(site, page_id, text, align, size)`` against ``actual(site, page_id, text, align, px)``."""
    px = F.create_map(*[x for n, v in SIZE_PX.items() for x in (F.lit(f"text-{n}"), F.lit(float(v)))])
    family = lambda c: F.when(c.isin("left", "start"), "start").when(c.isin("right", "end"), "end").otherwise(c)
    joined = expected.alias("e").join(actual.alias("a"), ["site", "page_id", "text"])
    want, have = family(F.col("e.align")), family(F.col("a.align"))
    want_px = F.when(F.col("e.size").endswith("px"), F.regexp_extract("e.size", "^([0-9.]+)px$", 1).cast("double")).otherwise(px[F.col("e.size")])
    align_off = want.isNotNull() & ~F.coalesce(want == have, F.lit(False))
    size_off = F.col("e.size").isNotNull() & ~F.coalesce(F.abs(want_px - F.col("a.px")) <= SIZE_TOLERANCE_PX, F.lit(False))
    return joined.select(
        "site", "page_id", "text",
        F.explode(_stack(
            F.when(align_off, F.struct(F.lit("align").alias("kind"), want.alias("expected"), have.alias("actual"))),
            F.when(size_off, F.struct(F.lit("size").alias("kind"), F.col("e.size").alias("expected"), F.col("a.px").cast("string").alias("actual"))),
        )).alias("f"),
    ).select("site", "page_id", "text", "f.*")


# ---- layer names -----------------------------------------------------------------------------

SOURCE_TAG = r"(?i)^(h[1-6]|p|img|ul|ol|li|a|button|form|label)\s*·\s*(.+)$"
# Name patterns and the element each stands for, first match wins.
LAYER_CLASSES = [(r"(?i)\bpill\b", "pill"), (r"(?i)\btext-link\b", "text-link"), (r"(?i)\bmedia\b", "media"),
                 ("(?i)navbar-dropdown", "navbar-dropdown"), (r"(?i)\b(cta|btn-primary|button)\b", "btn-primary")]
LANDMARK_NAMES = {"header": "header", "nav": "nav", "navbar": "nav", "navigation": "nav", "footer": "footer", "main": "main"}


def _first_of(rules: list[tuple[str, str]], text: Column) -> Column:
    out = None
    for pattern, value in rules:
        out = F.when(text.rlike(pattern), value) if out is None else out.when(text.rlike(pattern), value)
    return out


def layer_roles(layers: DataFrame) -> DataFrame:
    """``layers(site, board, pos, name)`` → tag, class and kind per layer.

    Heading levels follow the order of plain heading layers on the board and stop at h6, so
    only the first five per board have to be ranked.
    """
    name = F.trim("name")
    prefixed = name.rlike(SOURCE_TAG)
    told_tag = F.lower(F.regexp_extract(name, SOURCE_TAG, 1))
    numbered = name.rlike(r"^\d+\s*·\s*.+$")
    rest = F.when(prefixed, F.trim(F.regexp_extract(name, SOURCE_TAG, 2))).when(numbered, F.trim(F.regexp_extract(name, r"^\d+\s*·\s*(.+)$", 1))).otherwise(name)
    slug = F.regexp_replace(F.regexp_replace(F.lower(rest), "[^a-z0-9_]+", "-"), "^-+|-+$", "")
    told_kind = (
        F.when(told_tag.rlike("^h[1-6]$"), "heading").when(told_tag == "img", "image").when(told_tag.isin("a", "button"), "control")
        .when(told_tag.isin("ul", "ol", "li"), "list").when(told_tag == "form", "form").otherwise("text")
    )
    cls = _first_of(LAYER_CLASSES, name)
    landmark = None
    for key, tag in LANDMARK_NAMES.items():
        landmark = F.when(slug == key, tag) if landmark is None else landmark.when(slug == key, tag)
    kind = (
        F.when(prefixed, told_kind).when(rest.rlike(r"(?i)\binteractive\b"), "interactive").when(rest.rlike("(?i)scribble|decorative"), "decorative")
        .when(rest.rlike(r"(?i)\bfaq\b"), "faq").when(cls.isin("pill", "btn-primary") | rest.rlike(LAYER_CLASSES[-1][0]), "control")
        .when(rest.rlike(r"(?i)(?:^|[\s_-])heading(?:$|[\s_-])|heading$"), "heading").when(landmark.isNotNull(), "landmark")
        .when(numbered | F.lower(rest).rlike("[- ]section$"), "section").otherwise("frame")
    )
    staged = layers.filter(name != "").select(
        "site", "board", "pos", "name", slug.alias("slug"), kind.alias("kind"), F.when(prefixed, told_tag).alias("_told"),
        F.coalesce(cls, F.when(~prefixed & (kind == "control"), "btn-primary")).alias("class"), landmark.alias("_landmark"),
    )
    w = W.partitionBy("site", "board").orderBy("pos")
    ranked = staged.filter("kind = 'heading'").select("site", "board", "pos").withColumn("_h", F.row_number().over(w)).filter("_h <= 5")
    tag = (
        F.when(F.col("_told").isNotNull(), F.col("_told"))
        .when(F.col("kind") == "heading", F.concat(F.lit("h"), F.coalesce("_h", F.lit(6)).cast("string")))
        .when(F.col("kind") == "decorative", "svg").when(F.col("kind") == "faq", "details").when(F.col("kind") == "control", "a")
        .when(F.col("kind") == "landmark", F.col("_landmark")).when(F.col("kind") == "section", "section").when(F.col("kind") == "frame", "div")
    )
    return staged.join(ranked, ["site", "board", "pos"], "left").select("site", "board", "pos", "name", "slug", "kind", "class", tag.alias("tag"))


def layer_texts(layers: DataFrame) -> DataFrame:
    """Distinct h1/h2/h3 and link texts of a site, and the first layer name per class; first by position wins."""
    name = F.trim("name")
    tag = F.lower(F.regexp_extract(name, SOURCE_TAG, 1))
    group = F.when(tag.isin("h1", "h2", "h3"), tag).when(tag.isin("a", "button"), "link")
    texts = layers.select("site", "board", "pos", group.alias("role"), F.trim(F.regexp_extract(name, SOURCE_TAG, 2)).alias("value"), F.col("name"))
    texts = texts.filter("role IS NOT NULL AND value <> ''")
    classes = layers.select("site", "board", "pos", F.lit("class").alias("role"), _first_of(LAYER_CLASSES, name).alias("value"), "name").filter("value IS NOT NULL")
    return dedupe_first(texts.unionByName(classes), ["site", "role", "value"], ["board", "pos"])
