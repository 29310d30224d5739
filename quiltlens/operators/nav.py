"""Navigation menus: what a source promises and what a built page wires."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quiltlens.functions import markup as M
from quiltlens.operators import elements as E
from quiltlens.operators.inventory import dedupe_first

# Class words of menus and logos, and the longest labels of builder menus.
DROPDOWN_CLASS = r"(?i)\b(dropdown|has-submenu|nav-dropdown|menu-item-has-children|submenu)\b"
LOGO = r"(?i)\b(logo|brand|wordmark|site-logo)\b"
TRIGGER_MAX, ITEM_MAX = 40, 60


def label_key(text: Column) -> Column:
    """Lower-cased letters and digits only, a leading ``nav:`` / ``menu -`` / ``link:`` dropped."""
    bare = F.regexp_replace(text, r"(?i)^(nav|menu|link)\s*[-–—:]\s*", "")
    return F.regexp_replace(F.lower(bare), "[^a-z0-9]+", "")


def _first(found: Column) -> Column:
    return F.get(found, F.lit(0))


def _links(panel: Column) -> Column:
    """Words of the links in a panel, in order."""
    return F.filter(F.transform(F.filter(E.inside(panel), lambda d: d["tag"] == "a"), lambda d: E.words(d)), lambda t: t != "")


def _controls(found: Column) -> Column:
    return F.filter(found, lambda d: d["tag"].isin("a", "button"))


def _is_logo(e: Column) -> Column:
    return F.concat_ws(" ", E.attr(e, "class"), E.attr(e, "aria-label"), E.words(e)).rlike(LOGO)


def _is_panel(e: Column) -> Column:
    """What follows a trigger holds its items: two links or more, or one where it is marked as a panel."""
    links, called = F.size(_links(e)), E.attr(e, "class").rlike(DROPDOWN_CLASS) | (e["tag"] == "ul")
    drawer = E.under(e, E.NAV_PANEL) | (E.attr(e, "id") == E.NAV_PANEL)
    return F.coalesce(~drawer & F.when(called, links >= 2).when(E.has_attr(e, "data-nav-dropdown-panel"), links >= 1).otherwise(e["tag"].isin("div", "nav") & (links >= 2)), F.lit(False))


def _panel_of(t: Column) -> Column:
    """The panel of a trigger: the list in its list item, what follows it, or what its dropdown holds elsewhere."""
    parent = E.at(t["parent"])
    listed = F.when(parent["tag"] == "li", _first(F.filter(E.inside(parent), lambda d: d["tag"] == "ul")))
    after = _first(F.filter(E.children(parent), lambda d: d["i"] > t["last"]))
    host = E.at(F.coalesce(t["near"]["dropdown"], t["parent"]))
    marked = F.coalesce(_first(F.filter(E.inside(host), lambda d: E.has_attr(d, "data-nav-dropdown-panel"))), _first(F.filter(E.inside(host), lambda d: d["tag"] == "ul")))
    calls = (E.attr(t, "aria-haspopup") != "") | E.attr(t, "class").rlike(DROPDOWN_CLASS)
    return F.coalesce(listed, F.when(_is_panel(after), after), F.when(calls & ~host["tag"].isin("header", "nav", "body"), marked))


def _menu(label: Column, items: Column) -> Column:
    return F.struct(label.alias("label"), items.alias("items"))


def nav_menus(pages: DataFrame) -> DataFrame:
    """Menus of ``page_elements``: triggers with two items or more, the first per normalised label on a page.

    Read from the page's header, else its nav, else what stands for one. List items that hold a trigger and a list come
    first, then triggers whose panel follows them or is marked in the same dropdown. Pages without navigation can have
    builder menus: named panels, whose trigger is the nearest control without a target before them.
    """
    scope = F.coalesce(
        _first(E.of_tag("header")), _first(E.of_tag("nav")), _first(F.filter("els", lambda e: E.attr(e, "role") == "navigation")),
        _first(F.filter("els", lambda e: E.attr(e, "id").rlike("(?i)nav"))))
    able = pages.withColumn("_scope", scope).withColumn("_in", F.coalesce(E.inside(F.col("_scope")), F.slice("els", 1, 0)))
    lists = F.transform(F.filter("_in", lambda e: e["tag"] == "li"), lambda e: F.struct(
        F.coalesce(_first(_controls(E.children(e))), _first(_controls(E.inside(e)))).alias("t"), _first(F.filter(E.inside(e), lambda d: d["tag"] == "ul")).alias("panel")))
    lists = F.transform(F.filter(lists, lambda m: m["t"].isNotNull() & m["panel"].isNotNull()), lambda m: _menu(E.words(m["t"]), _links(m["panel"])))
    asked = F.filter(_controls(F.col("_in")), lambda t: ~E.under(t, E.NAV_PANEL) & ~_is_logo(t) & (E.words(t) != ""))
    asked = F.filter(F.transform(asked, lambda t: F.struct(t.alias("t"), _panel_of(t).alias("panel"))), lambda m: m["panel"].isNotNull())
    asked = F.transform(asked, lambda m: _menu(E.words(m["t"]), F.transform(
        F.filter(E.inside(m["panel"]), lambda d: (d["tag"] == "a") & (d["i"] != m["t"]["i"]) & (E.words(d) != "")), lambda d: E.words(d))))
    named = lambda e: F.exists(F.array(*[E.attr(e, n) for n in E.BUILDER_NAMES]), lambda v: v.rlike(f"(?i){E.PANEL_NAME.pattern}"))
    panels = F.filter("els", lambda e: named(e) & ~E.under(e, "panel", "footer"))
    built = F.transform(panels, lambda p: F.struct(p.alias("p"), F.element_at(F.filter(
        _controls(F.slice("els", 1, p["i"])), lambda t: (E.attr(t, "href") == "") & ~E.under(t, "panel") & ~_is_logo(t) & F.char_length(E.words(t)).between(1, TRIGGER_MAX)), -1).alias("t")))
    built = F.transform(F.filter(built, lambda m: m["t"].isNotNull()), lambda m: _menu(E.words(m["t"]), F.filter(_links(m["p"]), lambda i: (F.char_length(i) <= ITEM_MAX) & (label_key(i) != ""))))
    found = F.when(F.col("_scope").isNull(), built).otherwise(F.concat(lists, asked))
    rows = able.select("site", "page_id", F.posexplode(found).alias("_m", "menu")).select("site", "page_id", "_m", "menu.*").withColumn("key", label_key(F.col("label")))
    kept = F.filter("items", lambda i: label_key(i) != F.col("key"))
    rows = rows.withColumn("items", kept).filter((F.col("key") != "") & (F.size("items") >= 2))
    return dedupe_first(rows, ["page_id", "key"], ["_m"]).select("site", "page_id", "label", "key", "items")


def nav_inventory(evidence: DataFrame, pages: DataFrame) -> DataFrame:
    """``evidence(site, page_id, home, kind, trigger, items, source)`` → expected items per page.

    Rows of the home page apply to every page of the site. Item sets and sources of the
    same (page, kind, key) are merged; these sets are bounded by the menus of two pages.
    """
    told = evidence.withColumn("key", label_key(F.col("trigger"))).filter("key <> ''")
    shared = told.filter("home").drop("page_id", "home").join(pages.select("site", "page_id"), "site")
    own = told.filter("NOT home").drop("home")
    rows = own.unionByName(shared.select(own.columns))
    items = rows.select("site", "page_id", "kind", "key", "trigger", "source", F.explode_outer("items").alias("item"))
    return items.groupBy("site", "page_id", "kind", "key").agg(
        F.min("trigger").alias("trigger"),
        F.array_sort(F.collect_set("item")).alias("items"),
        F.array_join(F.array_sort(F.collect_set("source")), "; ").alias("evidence"),
    )


def nav_state(expected: DataFrame, built: DataFrame) -> DataFrame:
    """``wired``, ``unwired`` or ``missing`` for every expected item.

    ``built(site, page_id, key, has_panel, items)`` is what the built navigation holds.
    """
    joined = expected.join(
        built.select("site", "page_id", "key", F.col("has_panel").alias("_panel"), F.col("items").alias("_built")),
        ["site", "page_id", "key"], "left",
    )
    wanted = F.filter("items", lambda i: label_key(i) != "")
    have = F.transform(F.coalesce("_built", F.array().cast("array<string>")), label_key)
    absent = F.filter(wanted, lambda i: ~F.array_contains(have, label_key(i)))
    state = (
        F.when(F.col("_panel").isNull(), "missing").when(~F.col("_panel"), "unwired")
        .when((F.size(wanted) > 0) & (F.size(absent) == F.size(wanted)), "unwired").otherwise("wired")
    )
    return joined.select(
        "site", "page_id", "kind", "key", "trigger", "evidence", state.alias("state"),
        F.when(F.col("_panel"), F.array_join(absent, ", ")).otherwise("").alias("absent"),
    )


def structure_print(html: Column) -> Column:
    """Hash of the markup with comments out and reference values blanked."""
    bare = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    bare = F.regexp_replace(bare, r"""(?i)\b(href|src|action)\s*=\s*["'][^'"]*["']""", '$1="#"')
    return F.sha2(M.squeeze(bare), 256)


def nav_audit(pages: DataFrame, states: DataFrame) -> DataFrame:
    """Per page: broken items, whether it passes, its structure print, and whether it had any evidence."""
    broken = F.when(F.col("state") != "wired", F.concat_ws(" ", "kind", F.col("trigger"), F.lit("is"), "state"))
    per_page = states.groupBy("site", "page_id").agg(
        F.count("*").alias("items"),
        F.count_if(F.col("state") != "wired").alias("broken"),
        F.array_join(F.array_sort(F.collect_list(broken)), "; ").alias("detail"),
    )
    return pages.select("site", "page_id", structure_print(F.col("html")).alias("print")).join(
        per_page, ["site", "page_id"], "left"
    ).select(
        "site", "page_id", "print",
        F.coalesce("items", F.lit(0).cast("bigint")).alias("items"),
        F.coalesce("broken", F.lit(0).cast("bigint")).alias("broken"),
        F.coalesce("detail", F.lit("")).alias("detail"),
        F.col("items").isNull().alias("skipped"),
    )
