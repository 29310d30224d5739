"""Exact rules on small literal inputs."""

from pyspark.sql import functions as F

from quiltlens.functions import colors as C
from quiltlens.operators import assets, geometry as K, graph, inventory as I, links as L, similarity as S, snapshots as J, tokens as H, validation as V
from quiltlens.operators.ordered import running
from quiltlens.sources import receipts as R
from quiltlens.sources.corpus import page_corpus
from quiltlens.streaming import journal as N


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_urls_drop_root_duplicates_assets_and_other_sites(spark):
    urls = ["https://a.com/", "https://a.com/about/", "https://a.com/about", "https://a.com/pricing?x=1", "https://b.com/x", "https://a.com/logo.png", "https://a.com/cdn-cgi/l"]
    df = spark.createDataFrame([("https://a.com", u, i) for i, u in enumerate(urls)], "site string, url string, pos long")
    got = I.dedupe_first(I.normalize_urls(df), ["site", "path"], ["pos"])
    assert rows(got, "path", "pos") == [("/about", 1), ("/pricing", 3)]


def test_templates_keep_one_sample_and_lose_nothing(spark):
    paths = ["/blog/a", "/blog/b", "/blog/c", "/about", "/x/1", "/x/2"]
    df = spark.createDataFrame([("s", p, i) for i, p in enumerate(paths)], "site string, path string, pos long")
    got = I.collapse_templates(df)
    assert got.count() == len(paths)
    assert rows(got.filter("state = 'collapsed'"), "path") == [("/blog/b",), ("/blog/c",)]
    assert rows(got.filter("template_sample"), "path", "template") == [("/blog/a", "/blog/*")]


def test_sitemap_child_is_followed_once(spark):
    seeds = spark.createDataFrame([("s", "s/sitemap.xml"), ("s", "s/c.xml")], "site string, url string")
    maps = spark.createDataFrame(
        [("s/sitemap.xml", "<sitemapindex><loc>s/c.xml</loc><loc>s/sitemap.xml</loc></sitemapindex>"), ("s/c.xml", "<urlset><loc> s/1 </loc><loc>s/2</loc></urlset>")],
        "url string, body string",
    )
    assert rows(I.expand_sitemaps(seeds, maps), "url", "pos") == [("s/1", 0), ("s/2", 1)]


def test_links_resolve_by_path_file_template_and_placeholder(spark):
    inv = spark.createDataFrame([("s", 1, "/about", "about", "About", None), ("s", 2, "/blog/a", "blog-a", "A", "/blog/*")], "site string, pos long, path string, slug string, title string, template string")
    hrefs = ["#", "mailto:x@y", "/", "about.html", "./about/", "/blog/zzz", "/about/", "nowhere"]
    links = spark.createDataFrame([("s", h) for h in hrefs], "site string, href string")
    got = dict(rows(L.resolve_hrefs(links, L.route_map(inv)), "href", "dest"))
    assert got == {"#": None, "mailto:x@y": "#", "/": "/", "about.html": "/about/", "./about/": "/about/", "/blog/zzz": "/blog-a/", "/about/": None, "nowhere": None}


def test_running_values_equal_plain_windows_even_when_one_key_fills_all_chunks(spark):
    df = spark.range(0, 3000, numPartitions=7).select(F.when(F.col("id") < 2900, 0).otherwise(F.col("id") % 5).alias("k"), F.col("id").alias("o"), (F.col("id") * 37 % 101).alias("v"))
    df = df.withColumn("v", F.when(F.col("v") % 3 != 0, F.col("v")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = running(df, ["k"], ["o"], {"a": ("lag", F.col("v")), "b": ("sum", F.col("v")), "c": ("max_before", F.col("v")), "d": ("last", F.col("v")), "e": ("next", F.col("v")), "f": ("row_number", None), "g": ("lead", F.col("v"))})
        got = rows(got.na.fill(-1).na.fill(0, ["b"]), "k", "o", "a", "c", "d", "e", "f", "g")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    df.createOrReplaceTempView("t_running")
    want = spark.sql("""SELECT k, o, lag(v) OVER w a, max(v) OVER (PARTITION BY k ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) c, last(v, true) OVER (PARTITION BY k ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) d,
        first(v, true) OVER (PARTITION BY k ORDER BY o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) e, row_number() OVER w f, lead(v) OVER w g FROM t_running WINDOW w AS (PARTITION BY k ORDER BY o)""")
    assert got == rows(want.na.fill(-1), "k", "o", "a", "c", "d", "e", "f", "g")


def test_components_on_a_long_chain_and_a_hub(spark):
    edges = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)] + [("h000", f"h{i:03d}") for i in range(1, 30)]
    got = graph.components(spark.createDataFrame(edges, "u string, v string"))
    assert got.count() == 71
    assert {r["root"] for r in got.collect()} == {"c000", "h000"}


def _groups(spark, bands):
    df = spark.createDataFrame(bands, "site string, page long, home boolean, ord long, name string, section_id string, html string")
    return S.connected_groups(S.signature_nodes(S.usable(S.signatures(df))))


def test_grouping_variants_copies_and_one_offs(spark):
    text = " ".join(f"word{i}" for i in range(30))
    near = text.replace("word29", "other")
    bands = [("s", 0, True, 1, "hero", "", f"<p>{text}</p>"), ("s", 1, False, 1, "band-01", "", text), ("s", 2, False, 1, "copy", "", near), ("s", 3, False, 1, "alone", "", " ".join(f"solo{i}" for i in range(30)))]
    groups = _groups(spark, bands)
    assert rows(groups, "page") == [(0,), (1,), (2,)]
    anchors = S.group_anchor(groups)
    assert rows(anchors, "page", "origin", "group_name") == [(0, "home", "HeroSection")]
    assert rows(S.group_members(groups, anchors), "page", "match")[2] == (2, "identical")


def test_grouping_equals_brute_force_over_all_pairs(spark):
    import itertools
    import random

    rnd = random.Random(7)
    base = [[f"w{rnd.randrange(60)}" for _ in range(24)] for _ in range(6)]
    bands = []
    for page in range(60):
        words = list(base[page % 6])
        for _ in range(rnd.randrange(6)):
            words[rnd.randrange(24)] = f"w{rnd.randrange(60)}"
        bands.append(("s", page // 2, False, page % 2, f"n{page}", "", " ".join(words)))
    sigs = [{" ".join(b[6].split()[i:i + 3]) for i in range(22)} for b in bands]
    parent = list(range(60))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(60), 2):
        inter = len(sigs[i] & sigs[j])
        if bands[i][1] != bands[j][1] and inter and inter / len(sigs[i] | sigs[j]) >= 0.5 and inter / min(len(sigs[i]), len(sigs[j])) >= 0.7:
            parent[find(i)] = find(j)
    want = {}
    for i in range(60):
        if len(sigs[i]) >= 12:
            want.setdefault(find(i), set()).add((bands[i][1], bands[i][3]))
    want = {frozenset(v) for v in want.values() if len({p for p, _ in v}) > 1}
    got = {}
    for r in _groups(spark, bands).collect():
        got.setdefault(r["gid"], set()).add((r["page"], r["ord"]))
    assert {frozenset(v) for v in got.values()} == want and want


def test_colours_and_units(spark):
    df = spark.createDataFrame([("#abc",), ("#E11D2E1A",), ("rgba(1, 2, 3, 0.5)",), ("nope",)], "v string").select("v", C.parse(F.col("v")).alias("c"))
    got = {r["v"]: tuple(r["c"]) if r["c"] else None for r in df.collect()}
    assert got == {"#abc": (170, 187, 204, 255), "#E11D2E1A": (225, 29, 46, 26), "rgba(1, 2, 3, 0.5)": (1, 2, 3, 128), "nope": None}
    u = spark.createDataFrame([("1.2", "16px"), ("24px", "16px"), ("1.15em", "16px"), ("normal", "16px")], "v string, s string")
    assert [r[0] for r in u.select(H.line_height_percent(F.col("v"), F.col("s"))).collect()] == ["120%", "150%", "115%", None]
    t = spark.createDataFrame([("-0.8px", "40px"), ("0.02em", "40px"), ("normal", "16px")], "v string, s string")
    assert [r[0] for r in t.select(H.letter_spacing_rem(F.col("v"), F.col("s"))).collect()] == ["-0.05rem", "0.05rem", "0rem"]


def test_snap_ties_go_to_the_larger_step(spark):
    df = spark.createDataFrame([(15.0,), (22.0,)], "px double")
    assert rows(H.snap_to_scale(df, {"a": 14, "b": 16, "c": 20, "d": 24}), "px", "step") == [(15.0, "b"), (22.0, "d")]


def test_upsert_plan_with_duplicates(spark):
    want = spark.createDataFrame([("s", "--a", "1")], "site string, name string, value string")
    have = spark.createDataFrame([("s", "--a", "0"), ("s", "--a", "2")], "site string, name string, value string")
    assert rows(H.token_upsert_plan(want, have), "action") == [("update",)]
    assert rows(H.token_upsert_plan(want, have, replace=True), "action") == [("create",), ("delete",), ("delete",)]


def test_snapshot_of_a_table_with_itself_is_empty_and_labels_do_not_count(spark):
    a = page_corpus(spark.createDataFrame([(1, "https://a.com/x", '<div class="k" role="main">Hi  there</div>')], "page_id long, url string, html string"))
    b = page_corpus(spark.createDataFrame([(1, "https://a.com/x", '<div aria-label="z" class="k">Hi there</div>')], "page_id long, url string, html string"))
    none = spark.createDataFrame([], "site string, path string")
    assert J.verify_snapshot(J.content_signature(a), J.content_signature(b), none).count() == 0


def test_original_images_unwrap_and_strip(spark):
    html = '<img src="https://c.x/a.png?scale-down-to=512&v=1"><img src="https://c.x/_next/image?url=https%3A%2F%2Fc.x%2Fb.jpg%3Fw%3D9&w=64">'
    corpus = page_corpus(spark.createDataFrame([(1, "https://a.com/x", html)], "page_id long, url string, html string"))
    assert rows(assets.original_images(corpus), "name", "url") == [("a.png", "https://c.x/a.png?v=1"), ("b.jpg", "https://c.x/b.jpg")]


def test_threshold_colour_distance(spark):
    df = spark.createDataFrame([("r", "s", "i", "strict", "color", 0.0, 0.0, (50.0, 1.0, 1.0), (50.0, 1.0, 5.0))], "run_id string, site string, id string, profile string, check_type string, expected double, actual double, lab1 struct<l:double,a:double,b:double>, lab2 struct<l:double,a:double,b:double>")
    got = V.threshold_checks(df).first()
    assert got["value"] == 4.0 and got["threshold"] == 1.5 and got["pass"] is False


SHOT = "site string, band int, scope string, source_white double, built_white double, children int"


def test_shot_verdicts_by_scope(spark):
    df = spark.createDataFrame([("s", 1, "section", 0.7, 0.7, 0), ("s", 2, "section", 0.5, 0.9, 3), ("s", 3, "section", 0.6, 0.9, 3), ("s", 4, "board", 0.4, 0.8, 0), ("s", 5, "board", 0.5, 0.9, 9)], SHOT)
    assert rows(V.shot_verdicts(df), "band", "verdict") == [(1, "empty frame"), (2, "white ratio differs"), (4, "board displaced")]


def test_seed_verdicts_order_and_capped_shots(spark):
    base = dict(site="s", source_white=0.3, built_white=0.3, children=3, source_sat=0.5, built_sat=0.5, coverage=0.1, source_coverage=0.1, system_font=False, source_w=1600.0, built_w=1600.0,
                source_h=900.0, built_h=900.0, **{f"{a}_{c}": 100.0 for a in ("source", "built") for c in "rgb"})
    cases = [{}, dict(built_sat=0.2), dict(source_sat=0.1, built_sat=0.3, coverage=0.3), dict(built_r=191.0), dict(built_r=190.0), dict(system_font=True), dict(built_h=400.0),
             dict(source_h=8000.0, built_h=2000.0, built_w=400.0), dict(source_h=8000.0, built_h=2000.0), dict(source_sat=None)]
    df = spark.createDataFrame([{**base, **c, "band": i} for i, c in enumerate(cases)], "site string, band int, children int, system_font boolean, " + ", ".join(f"{c} double" for c, v in base.items() if isinstance(v, float)))
    assert rows(V.seed_verdicts(df), "band", "verdict") == [(1, "colour wash"), (2, "colour spill"), (3, "colour shift"), (5, "system font"), (6, "layout shift"), (8, "layout shift"), (9, "colour shift")]


def test_issue_delta_closed_statuses(spark):
    p = spark.createDataFrame([("r", 1, "open"), ("r", 2, "fixed"), ("r", 3, "open"), ("r", 4, "open")], "run_id string, issue int, status string")
    c = spark.createDataFrame([("r", 1, "accepted_by_user"), ("r", 2, "open"), ("r", 3, "open"), ("r", 5, "fixed")], "run_id string, issue int, status string")
    assert rows(V.issue_delta(p, c), "issue", "delta") == [(1, "resolved"), (2, "regressed"), (3, "unchanged"), (4, "other"), (5, "new")]


def test_latin_faces_keep_unranged_and_weights_prefer_long_words(spark):
    faces = spark.createDataFrame([("s", 1, i, 0, f, "400", "normal", r, "u") for i, (f, r) in enumerate([("A", ""), ("a", ""), ("A", "U+0000-00FF"), ("A", "U+0460-052F"), ("A", "U+0000-0030")])],
                                  "site string, page int, pos int, i int, family string, weight string, style string, unicode_range string, url string")
    assert rows(assets.latin_faces(faces), "pos", "family", "unicode_range") == [(0, "A", ""), (1, "a", ""), (2, "A", "U+0000-00FF")]  # families that differ in case are two
    css = spark.createDataFrame([("s", 1, 0, "@font-face{font-family:A;src:url(a.woff2?x)} @font-face{font-family:B;src:local(B)} @font-face{src:url(c.woff)} @font-face{font-family:D;src:url(d.svg)} @font-face{font-family:'E';src:url('e.otf')}")],
                                "site string, page int, pos int, css string")
    assert rows(assets.font_faces(css), "family", "url") == [("A", "a.woff2?x"), ("E", "e.otf")]
    lib = spark.createDataFrame([("s", "Inter", 0), ("s", "-apple-system", 1), ("s", "Emoji", 2)], "site string, family string, pos int")
    files = spark.createDataFrame([("s", "inter", f"x-{w}.woff2") for w in ("Ultralight", "DemiBold", "UltraBold", "Heavy", "Book")], "site string, family string, file string")
    assert rows(assets.font_roster(lib, lib.limit(0), files), "family", "weight") == [("Inter", w) for w in (200, 400, 600, 800, 900)]


def test_gaps_and_overlap_leave_out_loose_nodes_only(spark):
    cols = "site string, board int, parent_id int, node_id int, x double, y double, w double, h double, position string"
    df = spark.createDataFrame([("s", 1, 0, 1, 0.0, 0.0, 10.0, 10.0, None), ("s", 1, 0, 2, 0.0, 5.0, 10.0, 10.0, "fixed"), ("s", 1, 0, 3, 0.0, 250.4, 10.0, 10.0, "relative"), ("s", 1, 0, 4, 0.0, 502.0, 10.0, 10.0, "static")], cols)
    assert rows(K.vertical_gaps(df), "prev", "node_id", "gap") == [(3, 4, 242.0)]
    assert K.sibling_overlap(df).count() == 0


def test_token_colours_with_digits_and_types_by_name(spark):
    css = spark.createDataFrame([("s", 0, ":root { --token-a1: #00ff00; --token-b: rgb(1, 2, 3); --text-lg: 4px; --font-weight-x: 700; gap: 4 }")], "site string, pos int, css string")
    assert rows(H.mine_css_tokens(css), "kind", "value") == [("color", "#00ff00"), ("color", "#010203"), ("spacing", "4px")]
    assert [r["type"] for r in H.css_custom_props(css).orderBy("i").collect()] == [None, None, "fontSize", "fontWeight"]


LINES = [
    '{"seq":1,"id":"a","type":"generate","event":{"type":"generate","count":3,"pageUrl":"u"}}', '{"seq":2,"id":"a","type":"variants_ready","event":{"type":"variants_ready","file":"f"}}',
    '{"seq":3,"id":"a","type":"checkpoint","event":{"type":"checkpoint","revision":2,"phase":"editing"}}', '{"seq":4,"id":"a","type":"checkpoint","event":{"type":"checkpoint","revision":1,"phase":"old"}}',
    "not json", '{"seq":5,"id":"a","type":"accept","event":{"type":"accept","variantId":2}}', '{"seq":6,"id":"a","type":"complete","event":{"type":"complete"}}',
]


def test_journal_fold_stale_checkpoint_and_bad_line(spark):
    events, bad = R.parse_journal(spark.createDataFrame([(x,) for x in LINES], "value string"))
    snap = N.session_state(events).first()
    assert (snap["phase"], snap["expected"], snap["arrived"], snap["revision"], snap["variant"], snap["pending_seq"], snap["diagnostics"]) == ("completed", 3, 3, 2, 2, None, 1)
    assert [r["text"] for r in bad.collect()] == ["not json"]
    assert N.active_sessions(N.session_state(events)).count() == 0


def test_all_overlays_of_a_parent_move_when_one_covers_text(spark):
    kind = "site string, board int, node_id int, parent_id int, ord int, component string, x double, y double, w double, h double, position string, filled boolean, children int"
    node = lambda i, ord_, component, loose=False: ("s", 1, i, 0, ord_, component, 0.0, 0.0, 100.0, 100.0, "absolute" if loose else None, True, 0)
    parent = ("s", 1, 0, None, 0, "Frame", 0.0, 0.0, 100.0, 100.0, None, True, 9)
    df = spark.createDataFrame([parent, node(1, 0, "Rectangle", True), node(2, 1, "Image"), node(3, 2, "Text"), node(4, 3, "Rectangle", True), node(5, 4, "Image"), node(6, 5, "Text")], kind)
    # without the two overlays the last image is third from the front, so its place counts images and texts only
    assert rows(K.overlay_order(df), "node_id", "ord", "first_text", "target") == [(1, 0, 2, 3), (4, 3, 2, 3)]
    assert K.overlay_order(df.filter("node_id <> 4")).count() == 0


def test_node_defects_and_empty_image_slots(spark):
    kind = "site string, node_id int, parent_id int, board int, component string, name string, w double, h double, position string, filled boolean, children int, stroke int, insets int, text string, image_fill boolean"
    def node(i, component="Rectangle", name="n", w=100.0, h=100.0, parent=0, filled=False, children=0, text=None, fill=None):  # noqa: E306
        return ("s", i, parent, 1, component, name, w, h, None, filled, children, 0, 0, text, fill)
    rows_ = [node(1, "Frame", w=0.0, h=900.0), node(2, w=2.0, h=900.0), node(3), node(4, w=79.0), node(5, text="x"), node(6, children=1), node(7, "Image", fill=False), node(8, "Image"), node(9, filled=True),
             node(10, "Group", "my deferred-image", 8.0, 8.0), node(11, "Image", "deferred-image", 20.0, 20.0, fill=True), node(12, "SVG", w=50.0, h=60.0), node(13, "SVG", w=10.0, h=10.0, parent=20), node(14, "SVG", w=10.0, h=10.0),
             node(15, "Frame", "File", 39.0, 39.0, parent=20), node(16, "Frame", "file", 40.0, 40.0, text="t"), node(20, "Ellipse", w=64.0, h=64.0)]
    got = rows(K.node_defects(spark.createDataFrame(rows_, kind)), "node_id", "kind")
    assert got == [(1, "zero size"), (2, "hidden variant"), (3, "empty image slot"), (7, "empty image slot"), (10, "deferred image"), (12, "avatar overlay"), (13, "avatar overlay"), (15, "avatar overlay")]
