"""Geometry checks over node tables.

``nodes(site, board, node_id, parent_id, ord, component, name, x, y, w, h, position, style_key, text, filled, children,
stroke, insets)``: stroke is the widest border in px, insets how many of top, right, bottom and left are zero.
A parent may hold very many children, so sibling order goes through chunked running values
and sibling overlap through a grid join, never through all pairs of a parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quiltlens.operators.intervals import overlapping_boxes
from quiltlens.operators.inventory import dedupe_first
from quiltlens.operators.ordered import running
from quiltlens.session import materialize

SLACK = 2.0
CELL = 256
COVER = 4  # px by which a full-bleed node may miss its parent
# Names and heights that mark a navigation bar.
NAVBAR_NAME = r"(?i)^(header|nav|navbar|site-chrome|chrome)\b|^(00|0a)[- ·]|pc-0[0a]([-.]|$)"
NAVBAR_PART, NOT_NAVBAR = r"(?i)\b(logo|menu|burger|hamburger)\b", r"(?i)\b(hero|section)\b"
BAR_HEIGHT, BAR_TOP, VIEWPORT_HEIGHT = 220, 160, 900


def _loose() -> Column:
    """Placed outside the flow; a node without a stated position is in it."""
    return F.coalesce(F.col("position").isin("absolute", "fixed"), F.lit(False))


def _covers() -> Column:
    return (F.abs(F.col("w") - F.col("pw")) <= COVER) & (F.abs(F.col("h") - F.col("ph")) <= COVER)


# Sizes in px and names of image slots that can stand empty.
SLOT_LEAST, HOLE_LEAST, CIRCLE_LEAST, CIRCLE_MOST, CIRCLE_SLACK = 80, 8, 40, 120, 16
DEFERRED_NAME, FILE_NAME = "(?i)deferred-image", "(?i)^file$"


def _small_circle(w: str, h: str) -> Column:
    return F.coalesce(F.col(w).between(CIRCLE_LEAST, CIRCLE_MOST) & F.col(h).between(CIRCLE_LEAST, CIRCLE_MOST) & (F.abs(F.col(w) - F.col(h)) <= CIRCLE_SLACK), F.lit(False))


def _empty_image(nodes: DataFrame) -> Column:
    """Which kind of empty image slot a node is, the first that fits; nothing painted, and no text but in drawings.

    A picture without its image or a childless rectangle of 80 px or more; a deferred image without content; a drawing or
    file layer over a small circle, which is its parent's if that is one, else its own. ``image_fill`` says whether a
    node has an image; without that column no picture lacks one.
    """
    fill = F.col("image_fill") if "image_fill" in nodes.columns else F.lit(None).cast("boolean")
    text = (F.coalesce(F.col("text"), F.lit("")) != "") if "text" in nodes.columns else F.lit(False)
    lacks, bare, childless = F.coalesce(~fill, F.lit(False)), ~F.col("filled"), F.col("children") == 0
    slot = (F.col("w") >= SLOT_LEAST) & (F.col("h") >= SLOT_LEAST) & ~text & bare & (((F.col("component") == "Image") & lacks) | ((F.col("component") == "Rectangle") & childless))
    hole = F.col("name").rlike(DEFERRED_NAME) & ~text & bare & (F.col("w") >= HOLE_LEAST) & (F.col("h") >= HOLE_LEAST) & ~((F.col("component") == "Image") & ~lacks) & (childless | lacks)
    drawing, file = F.col("component") == "SVG", F.col("name").rlike(FILE_NAME) & F.col("component").isin("Rectangle", "Frame", "")
    avatar = (drawing | (file & ~text)) & bare & ~F.coalesce(fill, F.lit(False)) & (_small_circle("pw", "ph") | _small_circle("w", "h"))
    return F.when(slot, "empty image slot").when(hole, "deferred image").when(avatar, "avatar overlay")


def node_defects(nodes: DataFrame) -> DataFrame:
    """Zero size, and of the others: hidden variant, empty frame or named section over 40 px, empty image slot, loose empty stroke of 1 to 2 px."""
    p = nodes.select("site", F.col("node_id").alias("parent_id"), F.col("w").alias("pw"), F.col("h").alias("ph"))
    n = nodes.join(p, ["site", "parent_id"], "left")
    others = F.array_compact(F.array(
        F.when((F.col("w") <= 2) & (F.col("h") > 800), "hidden variant"),
        F.when((F.col("component") == "Frame") & (F.col("children") == 0) & ~F.col("filled") & (F.col("w") > 40) & (F.col("h") > 40),
               F.when(F.col("name").rlike(r"^\d{2}\s*·"), "empty named section").otherwise("empty frame")),
        _empty_image(nodes),
        F.when(_loose() & (F.col("children") == 0) & (F.col("component") != "Text") & (F.col("stroke") > 0) & (F.col("stroke") <= 2) & (F.col("w") > 8) & (F.col("h") > 8)
               & ((F.col("insets") >= 3) | F.coalesce(_covers(), F.lit(False))), "loose decoration"),
    ))
    kinds = F.when((F.col("w") <= 0) | (F.col("h") <= 0), F.array(F.lit("zero size"))).otherwise(others)
    return n.select("site", "board", "node_id", F.explode(kinds).alias("kind"))


def overflow(nodes: DataFrame) -> DataFrame:
    """Children past the right or bottom edge of a parent that does not show overflow."""
    p = nodes.filter("NOT overflow_visible").select("site", F.col("node_id").alias("parent_id"), *[F.col(c).alias(f"p{c}") for c in "xywh"])
    right = F.col("x") + F.col("w") - F.col("px") - F.col("pw")
    down = F.col("y") + F.col("h") - F.col("py") - F.col("ph")
    return nodes.join(p, ["site", "parent_id"]).filter((right > SLACK) | (down > SLACK)).select(
        "site", "board", "node_id", "parent_id", F.greatest(right, F.lit(0.0)).alias("right"), F.greatest(down, F.lit(0.0)).alias("down")
    )


def sibling_overlap(nodes: DataFrame, cell: int = CELL) -> DataFrame:
    """In-flow siblings that intersect by more than 2px both ways.

    Boxes meet in a grid of several levels (``operators/intervals``): each lies in at most four cells of the level of its
    size, so a box of any size costs a few rows.
    """
    flow = nodes.filter(~_loose() & (F.col("w") > 0) & (F.col("h") > 0)).select("site", "board", "parent_id", "node_id", *"xywh")
    met = overlapping_boxes(flow, ["site", "parent_id"], "node_id", cell)
    wide = F.least(F.col("a.x") + F.col("a.w"), F.col("b.x") + F.col("b.w")) - F.greatest("a.x", "b.x")
    tall = F.least(F.col("a.y") + F.col("a.h"), F.col("b.y") + F.col("b.h")) - F.greatest("a.y", "b.y")
    return met.filter((wide > SLACK) & (tall > SLACK)).select("site", "a.board", F.col("a.node_id").alias("a"), F.col("b.node_id").alias("b"), wide.alias("wide"), tall.alias("tall"))


def vertical_gaps(nodes: DataFrame, limit: float = 240) -> DataFrame:
    """Gap to the previous in-flow sibling above the limit, to the nearest px."""
    flow = nodes.filter(~_loose() & F.col("w").isNotNull() & F.col("h").isNotNull()).select("site", "board", "parent_id", "y", "node_id", "h")
    rows = running(flow, ["site", "parent_id"], ["y", "node_id"], {"before": ("lag", F.col("y") + F.col("h")), "prev": ("lag", F.col("node_id"))}, "gaps")
    gap = F.floor(F.col("y") - F.col("before") + 0.5).cast("double")
    return rows.filter(gap > limit).select("site", "board", "parent_id", "prev", "node_id", gap.alias("gap"))


def placement(sections: DataFrame, top: float = 80) -> DataFrame:
    """Named sections of a board: space left above the first, name order against y order, and gaps over max(400, 1.15·h)."""
    by_y = running(sections.select("site", "board", "y", "node_id", "name", "h"), ["site", "board"], ["y", "node_id"], {
        "y_rank": ("row_number", None), "before": ("lag", F.col("y") + F.col("h")), "prev_h": ("lag", F.col("h"))}, "by-y")
    by_name = running(sections.select("site", "board", "name", "node_id"), ["site", "board"], ["name", "node_id"], {"n_rank": ("row_number", None)}, "by-name")
    rows = by_y.join(by_name.select("site", "board", "node_id", "n_rank"), ["site", "board", "node_id"])
    gap = F.col("y") - F.col("before")
    kinds = F.array_compact(F.array(
        F.when((F.col("y_rank") == 1) & (F.col("y") > top), "space above first"),
        F.when(F.col("y_rank") != F.col("n_rank"), "out of order"),
        F.when(gap > F.greatest(F.lit(400.0), 1.15 * F.col("prev_h")), "gap too large"),
    ))
    return rows.select("site", "board", "node_id", F.explode(kinds).alias("kind"))


def overlay_order(nodes: DataFrame) -> DataFrame:
    """Filled, childless full-bleed siblings outside the flow, where one of them comes after the first text sibling.

    Then all of a parent's overlays move, in their order, to the place after the last image; ``target`` counts the
    siblings before it that are no overlays.
    """
    p = nodes.select("site", F.col("node_id").alias("parent_id"), F.col("w").alias("pw"), F.col("h").alias("ph"))
    able = _loose() & ~F.col("component").isin("Text", "Image") & F.col("filled") & (F.col("children") == 0)
    kids = nodes.join(p, ["site", "parent_id"]).withColumn("_over", F.coalesce(able & _covers(), F.lit(False))).select("site", "board", "parent_id", "node_id", "ord", "component", "_over")
    facts = kids.groupBy("site", "parent_id").agg(
        F.min(F.when(F.col("component") == "Text", F.col("ord"))).alias("first_text"), F.max(F.when(F.col("_over"), F.col("ord"))).alias("_last_over"),
        F.max(F.when(F.col("component") == "Image", F.struct("ord", "node_id"))).alias("_image")).filter("_last_over > first_text")
    moved = kids.join(facts, ["site", "parent_id"])
    before = moved.groupBy("site", "parent_id").agg(F.count_if(~F.col("_over") & (F.struct("ord", "node_id") <= F.col("_image"))).alias("target"))
    return moved.filter("_over").join(before, ["site", "parent_id"]).select("site", "board", "node_id", "ord", "first_text", "target")


# Names and components of headings, their decoration and what is no text or frame; limits in px.
HEADING_CONTEXT = r"(?i)\b(heading|headline|title|display|h1)\b"
HEADING_DECOR = "(?i)scribble|underline|oval|highlight|decoration|swirl|stroke|squiggle"
SVG_PART = "(?i)^(svg|path|svgvisualelement|circle|rect|ellipse|line|polygon|polyline|g|use)$"
CONTROL_NAME = r"(?i)\b(button|cta|navlink|footerlink)\b"
DISPLAY_PX, SIZE_SLACK, LINE_GAP, SIDE_OVERLAP, SIDE_RISE, WRAP_SHARE, WRAP_SLACK, NAMED_ABOVE = 28, 4, 48, 8, 0.4, 0.7, 4, 6
LARGE, BUCKETS, DEEPEST = 200_000, 16_384, 40  # children that one task sorts; hash buckets of parents; rounds, each twice as deep as the last


def ancestors(nodes: DataFrame, items: DataFrame, most: int | None = None) -> DataFrame:
    """``site, node_id, above, steps``: what lies above each of ``items(site, node_id)``, by pointer jumping.

    Each round doubles the jump every node knows and the distance the items have covered, so rounds grow with the
    logarithm of the depth. ``most`` bounds the steps that are wanted. A parent that is no node ends a chain.
    """
    known = nodes.select("site", F.col("node_id").alias("_n"))
    jump = materialize(nodes.filter("parent_id IS NOT NULL").select("site", F.col("node_id").alias("from"), F.col("parent_id").alias("to")).join(
        known, (F.col("to") == F.col("_n")) & nodes["site"].eqNullSafe(known["site"]), "left_semi"), "jumps")
    reached = materialize(items.select("site", "node_id").join(jump.withColumnRenamed("from", "node_id"), ["site", "node_id"]).select("site", "node_id", F.col("to").alias("above"), F.lit(1).alias("steps")), "above")
    length = 1
    while most is None or length < most:
        further = reached.join(jump.withColumnRenamed("from", "above"), ["site", "above"]).select("site", "node_id", F.col("to").alias("above"), (F.col("steps") + length).alias("steps"))
        further = materialize(further if most is None else further.filter(F.col("steps") <= most), "above")
        if further.isEmpty():
            break
        reached = reached.unionByName(further)
        second = jump.select("site", F.col("from").alias("to"), F.col("to").alias("next"))
        jump = materialize(jump.join(second, ["site", "to"]).select("site", "from", F.col("next").alias("to")), "jumps")
        length *= 2
    return reached


def _kinds(nodes: DataFrame) -> DataFrame:
    """Marks text, heading decoration, frames and other content."""
    component, name, said = F.lower(F.coalesce("component", F.lit(""))), F.coalesce("name", F.lit("")), F.trim(F.coalesce("text", F.lit("")))
    part = component.rlike(SVG_PART) | name.rlike(SVG_PART)
    control = name.rlike(CONTROL_NAME)
    text = ~component.isin("svg", "image", "artboard") & ~part & ~component.rlike("button|link|nav|input") & ~control & (
        component.isin("text", "p") | component.rlike("^h[1-6]$") | ((said != "") & (F.col("_kids") == 0)))
    decor = (component == "svg") | (~part & (F.col("_kids") == 0) & name.rlike(HEADING_DECOR))
    frame = ~text & ~decor & component.isin("frame", "div", "group", "") & ~control
    return nodes.withColumns({"_text": text, "_decor": decor, "_frame": frame, "_extra": ~text & ~decor & ~frame & ~part & ((F.col("component") == "Image") | (said != ""))})


def _alike(a, b) -> Column:
    """Same type style as far as both say it: size within 4 px, family, weight."""
    size = (a["size"] > 0) & (b["size"] > 0) & (F.abs(a["size"] - b["size"]) > SIZE_SLACK)
    other = lambda f: (a[f] != "") & (b[f] != "") & (a[f] != b[f])
    return ~(size | other("family") | other("weight"))


def _large_parents(kids: DataFrame, most: int) -> DataFrame:
    """``site, parent_id`` of more than ``most`` rows; only rows of hash buckets that hold so many are counted one by one."""
    bucket = F.pmod(F.xxhash64("site", "parent_id"), F.lit(BUCKETS))
    full = kids.groupBy(bucket.alias("_b")).agg(F.count("*").alias("c")).filter(F.col("c") > most).select("_b")
    return kids.select("site", "parent_id", bucket.alias("_b")).join(F.broadcast(full), "_b").groupBy("site", "parent_id").agg(F.count("*").alias("c")).filter(F.col("c") > most).select("site", "parent_id")


def _held(n: DataFrame) -> DataFrame:
    """``site, node_id, texts, extras, line``: what stands below each node, counted to two; ``line`` is the text where it is one.

    Each round adds to every node what its descendants twice as far below hold, so rounds grow with the logarithm of the
    depth and a round has a row a node at most.
    """
    known = n.select("site", F.col("node_id").alias("to")).distinct()
    jump = materialize(n.select("site", F.col("node_id").alias("from"), F.col("parent_id").alias("to")).join(known, ["site", "to"], "left_semi"), "jumps")
    text = F.col("_kind") == "text"
    own = n.filter("_kind IN ('text', 'extra')").select("site", "node_id", text.cast("int").alias("texts"), (~text).cast("int").alias("extras"), F.when(text, F.col("node_id")).alias("line"))
    total = lambda df: df.groupBy("site", "node_id").agg(F.least(F.sum("texts"), F.lit(2)).cast("int").alias("texts"), F.least(F.sum("extras"), F.lit(2)).cast("int").alias("extras"), F.min("line").alias("line"))
    below = None
    for _ in range(DEEPEST):
        all_of = own if below is None else own.unionByName(below)
        moved = materialize(total(all_of.join(jump.withColumnRenamed("from", "node_id"), ["site", "node_id"]).select("site", F.col("to").alias("node_id"), "texts", "extras", "line")), "moved")
        if moved.isEmpty():
            break
        below = moved if below is None else materialize(total(below.unionByName(moved)), "held")
        second = jump.select("site", F.col("from").alias("to"), F.col("to").alias("next"))
        jump = materialize(jump.join(second, ["site", "to"]).select("site", "from", F.col("next").alias("to")), "jumps")
    return below if below is not None else total(own).limit(0)


def _heading_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with their kinds, the style of texts and what they say; only nodes whose kind depends on it ask whether they have children."""
    one = F.when(F.col("_text"), "text").when(F.col("_decor"), "decor").when(F.col("_frame"), "frame").when(F.col("_extra"), "extra").otherwise("other")
    flags = ["_text", "_decor", "_frame", "_extra"]
    as_leaf = _kinds(nodes.withColumn("_kids", F.lit(0))).withColumn("_leaf", one).drop(*flags)
    both = _kinds(as_leaf.withColumn("_kids", F.lit(1))).withColumn("_stem", one)
    style = F.struct(F.coalesce(F.col("font_size").cast("double"), F.lit(0.0)).alias("size"), F.lower(F.trim(F.split_part(F.coalesce("font_family", F.lit("")), F.lit(","), F.lit(1)))).alias("family"),
                     F.trim(F.coalesce(F.col("font_weight").cast("string"), F.lit(""))).alias("weight"))
    text = ((F.col("_leaf") == "text") | (F.col("_stem") == "text")) & F.col("node_id").isNotNull()
    n = both.select("site", "board", "parent_id", "ord", "node_id", "x", "y", "w", "h", "max_width", "_leaf", "_stem", F.when(text, style).alias("style"),
                    F.when(text, F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))).alias("said"), F.coalesce(F.col("name").rlike(HEADING_CONTEXT), F.lit(False)).alias("_named"))
    n = materialize(n, "heading-nodes", "zstd")
    plain = [c for c in n.columns if c not in ("_leaf", "_stem")]
    unsure = n.filter("_leaf <> _stem")
    sure = n.filter("_leaf = _stem").select(*plain, F.col("_leaf").alias("_kind"))
    if unsure.isEmpty():
        return sure
    parents = n.select("site", F.col("parent_id").alias("node_id")).distinct().withColumn("_has", F.lit(True))
    told = unsure.join(parents, ["site", "node_id"], "left").withColumn("_kind", F.when(F.col("_has"), F.col("_stem")).otherwise(F.col("_leaf")))
    return materialize(sure.unionByName(told.select(*plain, "_kind")), "heading-nodes")


def _stacks(lines: DataFrame, small: bool) -> DataFrame:
    """The runs of ``lines`` that have one style, say different things and are stacked, with what the parent has yet to decide.

    A style is like the run's first where the extremes are: no row is joined to it.
    """
    box = ["x", "y", "w", "h"]
    lines = running(lines, ["site", "parent_id", "kind", "run"], ["y", "ord", "node_id"], {"_above": ("lag", F.struct(*box))}, "heading-stack", small)
    up, spot = F.col("_above"), F.struct("ord", "node_id")
    beside = (F.least(up["x"] + up["w"], F.col("x") + F.col("w")) - F.greatest(up["x"], F.col("x")) > SIDE_OVERLAP) & (F.abs(F.col("y") - up["y"]) < F.least(up["h"], F.col("h")) * SIDE_RISE)
    apart = F.coalesce(beside | (F.col("y") - up["y"] - up["h"] > LINE_GAP), F.lit(False))
    limit = lambda most, width: F.when((most > 0) & (width >= most - WRAP_SLACK), most)
    group = ["site", "board", "parent_id", "kind", "run"]
    size, lower = F.col("style.size"), F.when(F.col("said") != "", F.lower("said"))
    named = lambda f: F.when(F.col(f"style.{f}") != "", F.col(f"style.{f}"))
    told = [F.collect_list(F.struct("ord", "node_id", "said")).alias("_told")]
    runs = lines.groupBy(*group).agg(
        F.count("*").alias("parts"), F.min_by("style", spot).alias("_lead"), F.min(F.when(size > 0, size)).alias("_least"), F.max(F.when(size > 0, size)).alias("_most"),
        *[g(named(f)).alias(f"_{k}_{f}") for f in ("family", "weight") for k, g in (("lo", F.min), ("hi", F.max))], F.bool_or(apart).alias("_apart"), F.max(size).alias("_size"),
        F.min(F.least(limit(F.col("max_width"), F.col("w")), limit(F.col("_mw"), F.col("_tw")))).alias("_limit"), F.min(lower).alias("_lo"), F.max(lower).alias("_hi"), F.count(lower).alias("_said"),
        F.min_by("line", spot).alias("first"), F.max_by("line", spot).alias("last"), *(told if small else []))
    lead = F.col("_lead")
    unlike = (lead["size"] > 0) & ((F.abs(F.col("_least") - lead["size"]) > SIZE_SLACK) | (F.abs(F.col("_most") - lead["size"]) > SIZE_SLACK))
    for f in ("family", "weight"):
        unlike = unlike | ((lead[f] != "") & ((F.col(f"_lo_{f}") != lead[f]) | (F.col(f"_hi_{f}") != lead[f])))
    runs = runs.filter("parts >= 2 AND NOT _apart AND NOT (_said >= 2 AND _lo = _hi)").filter(~F.coalesce(unlike, F.lit(True)))
    if not small:
        runs = materialize(runs, "heading-runs")
        runs = runs.join(lines.join(runs.select(*group), group, "left_semi").groupBy(*group).agg(*told), group)
    return runs.select("site", "board", "parent_id", "kind", "parts", "first", "last", "_size", "_limit", "_told")


def _row_runs(rows: DataFrame, small: bool) -> DataFrame:
    """Rows that hold one text each, numbered by runs: next to each other and of one style from one to the next."""
    rows = running(rows, ["site", "parent_id"], ["ord", "node_id"], {"_before": ("lag", F.struct("_pos", "style"))}, "heading-rows", small)
    goes_on = (F.col("_pos") == F.col("_before._pos") + 1) & _alike(F.col("style"), F.col("_before.style"))
    rows = rows.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("bigint"))
    return running(rows, ["site", "parent_id"], ["ord", "node_id"], {"run": ("sum", F.col("_new"))}, "heading-styles", small).withColumn("kind", F.lit("rows"))


def _judged(n: DataFrame, kids: DataFrame, small: bool) -> DataFrame:
    """Runs that may merge among the children ``kids`` of some parents."""
    key, box = ["site", "parent_id"], ["x", "y", "w", "h", "max_width"]
    is_ = lambda kind: F.col("_kind") == kind
    at = running(kids, key, ["ord", "node_id"], {
        "_cut": ("sum", (~F.col("_kind").isin("text", "decor")).cast("bigint")), "_pos": ("row_number", None), "_up": ("lag", is_("frame")), "_down": ("lead", is_("frame"))}, "heading-kids", small)
    keep = ["site", "board", "parent_id", "ord", "node_id", *box, "style", "said"]
    texts = at.filter(is_("text")).select(*keep, F.col("node_id").alias("line"), F.lit(None).cast("double").alias("_mw"), F.lit(None).cast("double").alias("_tw"),
                                          F.lit("texts").alias("kind"), F.col("_cut").alias("run"))
    frames = at.filter(is_("frame") & (F.coalesce("_up", F.lit(False)) | F.coalesce("_down", F.lit(False)))).select(*keep, "_pos")
    parts = _stacks(texts, small).select(F.struct("*").alias("run")).unionByName(frames.select(F.struct("*").alias("frame")), allowMissingColumns=True)
    parts = materialize(parts, "heading-parts")  # one plan, so that both read one shuffle
    rows = _row_runs(_rows(n, parts.filter("frame IS NOT NULL").select("frame.*").drop("style", "said")), small)
    return parts.filter("run IS NOT NULL").select("run.*").unionByName(_stacks(rows.select(*texts.columns), small))


def _rows(n: DataFrame, frames: DataFrame) -> DataFrame:
    """The ``frames`` below which one text stands and nothing else that counts, with this text as ``line``."""
    is_ = lambda kind: F.col("_kind") == kind
    told = [F.col("node_id").alias("line"), "style", "said", F.col("max_width").alias("_mw"), F.col("w").alias("_tw")]
    content = n.filter("_kind IN ('text', 'extra') AND parent_id IS NOT NULL")
    only = content.groupBy("site", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("_n"), F.min(F.when(is_("text"), F.struct(*told))).alias("_line")).filter("_n = 1 AND _line IS NOT NULL")
    stems = n.select("site", "node_id", "parent_id").join(n.select("site", F.col("parent_id").alias("node_id")).distinct(), ["site", "node_id"], "left_semi")
    deep = stems.select("site", F.col("parent_id").alias("node_id")).distinct().withColumn("_deep", F.lit(True))
    rows = frames.join(only, ["site", "node_id"], "left").join(deep, ["site", "node_id"], "left").filter("_n = 1 OR _deep").select(*frames.columns, "_line.*", "_deep")
    rows = materialize(rows, "heading-rows")
    unclear = rows.filter("_deep").select(*frames.columns)
    if unclear.isEmpty():
        return rows.drop("_deep")
    one = _held(n).filter("texts = 1 AND extras = 0").select("site", "node_id", "line")  # something in the row has children of its own: all that is below it counts
    found = unclear.join(one, ["site", "node_id"]).join(n.filter(is_("text")).select("site", *told), ["site", "line"], "left")
    return rows.filter("_deep IS NULL").drop("_deep").unionByName(found)


def split_headings(nodes: DataFrame, large: int = LARGE) -> DataFrame:
    """Headings whose lines stand as stacked text siblings, or as rows that hold one text each: one merge group a run.

    ``nodes(site, board, node_id, parent_id, ord, component, name, text, x, y, w, h, font_size, font_family, font_weight,
    max_width)``. A run is made of consecutive children of one parent, with decoration between texts allowed. It merges if
    its texts have one type style, say different things, and are stacked: at most 48 px apart, none beside another. The
    parent or one of the five above it is named like a heading, or the type is 28 px or larger; and no text is held to
    less than 0.7 of the parent's width. Rows are cut where the style changes from one to the next.

    Gives ``site, board, parent_id, kind, parts, first, last, text``. Nodes are shuffled once by their parent; runs are cut
    and judged where they lie. Children of a parent that has more than ``large`` go by chunked running values instead.
    """
    n = _heading_nodes(nodes)
    kids = n.filter("parent_id IS NOT NULL AND site IS NOT NULL").drop("_named")
    heavy = materialize(_large_parents(kids, large), "heading-large")
    key = ["site", "parent_id"]
    if heavy.isEmpty():
        able = _judged(n, kids.repartition(*key), True)
    else:
        able = _judged(n, kids.join(F.broadcast(heavy), key, "left_anti").repartition(*key), True).unionByName(_judged(n, kids.join(F.broadcast(heavy), key, "left_semi"), False))
    able = materialize(able, "heading-runs")
    free = F.coalesce(F.col("_limit").isNull() & (F.col("_size") >= DISPLAY_PX), F.lit(False))
    above = n.select("site", F.col("node_id").alias("_at"), F.col("parent_id").alias("_next"), F.col("_named").alias("_is"), F.col("w").alias("_pw"))
    places = able.filter(~free).select(*key, F.col("parent_id").alias("_next"), F.lit(False).alias("_titled"), F.lit(None).cast("double").alias("_width")).distinct()
    for step in range(NAMED_ABOVE):  # one plan: the nodes are shuffled once for all steps
        places = places.withColumnRenamed("_next", "_at").join(above, ["site", "_at"], "left").select(
            *key, F.when(~F.coalesce("_is", F.lit(False)), F.col("_next")).alias("_next"), (F.col("_titled") | F.coalesce("_is", F.lit(False))).alias("_titled"),
            (F.col("_width") if step else F.col("_pw")).alias("_width"))
    asked = able.filter(~free).join(places.drop("_next"), key).filter(((F.col("_size") >= DISPLAY_PX) | F.col("_titled")) & ~F.coalesce(F.col("_limit") < F.col("_width") * WRAP_SHARE, F.lit(False)))
    glued = F.transform(F.array_sort("_told"), lambda p: F.when(p["said"].rlike(r"^[,.;:!?)]") | (p["said"] == ""), p["said"]).otherwise(F.concat(F.lit(" "), p["said"])))
    return able.filter(free).unionByName(asked.drop("_titled", "_width")).select("site", "board", "parent_id", "kind", "parts", "first", "last", F.trim(F.array_join(glued, "")).alias("text"))


def chrome_bars(nodes: DataFrame, boards: DataFrame, viewport_height: int = VIEWPORT_HEIGHT) -> DataFrame:
    """Bars near the top, as wide as four fifths of the board, 32 px to 28 percent of the viewport high; and boards where no node looks like a navigation bar."""
    b = boards.select("site", "board", F.col("w").alias("bw"))
    tallest = min(BAR_HEIGHT, int(viewport_height * 0.28 + 0.5))
    bars = nodes.join(b, ["site", "board"]).filter((F.col("w") >= 0.8 * F.col("bw")) & F.col("h").between(32, tallest) & (F.col("y") <= BAR_TOP))
    name = F.coalesce("name", F.lit(""))
    navbar = name.rlike(NAVBAR_NAME) | ((F.col("h") > 0) & (F.col("h") <= BAR_HEIGHT) & name.rlike(NAVBAR_PART) & ~name.rlike(NOT_NAVBAR))
    lost = b.join(nodes.filter(navbar).select("site", "board").distinct(), ["site", "board"], "left_anti")
    return bars.select("site", "board", "node_id", F.lit("bar").alias("kind")).unionByName(lost.select("site", "board", F.lit(None).cast("bigint").alias("node_id"), F.lit("no navbar").alias("kind")))


def missing_elements(capture: DataFrame, canvas: DataFrame) -> DataFrame:
    """``capture(site, page, slug, h, words, blank)`` against ``canvas(site, page, slug, h, children, hidden, text_nodes, words)``."""
    c = canvas.select("site", "page", "slug", *[F.col(x).alias(f"c_{x}") for x in ("h", "children", "hidden", "text_nodes", "words")])
    j = capture.join(c, ["site", "page", "slug"], "left")
    have = F.col("c_h").isNotNull()
    kinds = F.array_compact(F.array(
        F.when(~have & F.col("slug").isin("header", "footer", "navbar"), "missing chrome"), F.when(~have & ~F.col("slug").isin("header", "footer", "navbar"), "missing section"),
        F.when(have & (F.col("c_children") == 0), "empty section"), F.when(F.col("c_hidden"), "hidden stack"),
        F.when((F.col("c_text_nodes") > 0) & (F.col("c_words") == 0) & (F.col("words") > 0), "dead text"),
        F.when((F.col("c_children") == 0) & (F.col("c_h") < 0.4 * F.col("h")), "hollow section"), F.when(F.col("blank"), "blank source"),
    ))
    return j.select("site", "page", "slug", F.explode(kinds).alias("kind"))


# Severity per finding kind.
SEVERITY = {"zero size": "high", "hidden variant": "high", "empty frame": "low", "empty named section": "high", "empty image slot": "high", "deferred image": "high", "avatar overlay": "high", "loose decoration": "high",
            "missing chrome": "high", "missing section": "high", "empty section": "high", "hidden stack": "medium", "dead text": "high", "hollow section": "high", "blank source": "low"}


def rank_findings(findings: DataFrame, applied: DataFrame) -> DataFrame:
    """``findings(site, pos, kind, section, symptom)``: first per kind, section and symptom, with severity, running id and status."""
    one = dedupe_first(findings, ["site", "kind", "section", "symptom"], ["pos"])
    sev = F.coalesce(F.create_map(*[x for k, v in SEVERITY.items() for x in (F.lit(k), F.lit(v))])[F.col("kind")], F.lit("medium"))
    order = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    rows = one.withColumn("severity", sev).withColumn("_o", order)
    ranked = running(rows, ["site"], ["_o", "pos", "kind", "section", "symptom"], {"id": ("row_number", None)}, "finding-ids")
    done = applied.select("site", "kind", "section", F.lit("applied").alias("status")).distinct()
    return ranked.join(done, ["site", "kind", "section"], "left").select("site", "id", "kind", "section", "symptom", "severity", F.coalesce("status", F.lit("open")).alias("status"))


def severity_counts(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("site").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")], F.count_if(F.col("status") == "applied").alias("applied"))


def breakpoint_image_gaps(boards: DataFrame) -> DataFrame:
    """``boards(site, family, width, section, images)``: sections where a narrower board has fewer filled images than the widest."""
    widest = boards.groupBy("site", "family").agg(F.max("width").alias("_w"))
    top = boards.join(widest, ["site", "family"]).filter("width = _w").groupBy("site", "family", "section").agg(F.max("images").alias("wanted"))
    return boards.join(widest, ["site", "family"]).filter("width < _w").join(top, ["site", "family", "section"]).filter("images < wanted").select("site", "family", "section", "width", "images", "wanted")
