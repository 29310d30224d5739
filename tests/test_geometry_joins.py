"""Split headings, ancestor chains and overlap joins, on literals and against plain loops."""

import random

from pyspark.sql import functions as F

from quiltlens.operators import components as I, geometry as K, intervals as V

NODE = "site string, board string, node_id string, parent_id string, ord long, component string, name string, text string, x double, y double, w double, h double, font_size double, font_family string, font_weight string, max_width double"


def frame(i, parent, ord_, name, x=0, y=0, w=800, h=300, component="Frame", mw=None):
    return ("s", "b", i, parent, ord_, component, name, None, float(x), float(y), float(w), float(h), None, None, None, mw)


def text(i, parent, ord_, said, x, y, w, h=72, size=72.0, weight="700", mw=None, family="Satoshi"):
    return ("s", "b", i, parent, ord_, "Text", said, said, float(x), float(y), float(w), float(h), size, family, weight, mw)


TAKE = [text("2UP-0", "{}", 0, "Take", 310, 20, 180), text("2UR-0", "{}", 1, "control", 260, 100, 280), text("2UW-0", "{}", 3, "of your personal spending today.", 40, 180, 720)]
SCRIBBLE = frame("2UT-0", "{}", 2, "scribble", 480, 140, 120, 24, "SVG")


def hung(row, parent, site="s", board="b"):
    return (site, board, row[2], parent, *row[4:])


def merges(spark, **boards):
    """Merge groups by board; every board is a site of its own."""
    rows = [(b, b, *r[2:]) for b, nodes in boards.items() for r in nodes]
    out = {b: [] for b in boards}
    for r in K.split_headings(spark.createDataFrame(rows, NODE)).orderBy("kind", "first").collect():
        out[r.site].append((r.parent_id, r.kind, r.parts, r.first, r.last, r.text))
    return out


def test_split_headings(spark):
    hero = frame("2UH-0", None, 0, "01 · hero")
    stacked = [hero, *[hung(r, "2UH-0") for r in [*TAKE, SCRIBBLE]]]
    rows = [frame("2UN-0", None, 0, "heading"), frame("2UO-0", "2UN-0", 0, "line-1", 310, 20, 180, 72), hung(TAKE[0], "2UO-0"), frame("2UQ-0", "2UN-0", 1, "line-2", 200, 100, 400, 72), hung(TAKE[1], "2UQ-0"),
            frame("2US-0", "2UQ-0", 1, "scribble wrap", 480, 140, 120, 24), hung(SCRIBBLE, "2US-0"), frame("2UV-0", "2UN-0", 2, "line-3", 40, 180, 720, 72), hung(TAKE[2], "2UV-0")]
    eyebrow = [hero, text("eye", "2UH-0", 0, "New", 370, 20, 60, 20, 14.0, "600"), text("title", "2UH-0", 1, "Take control", 200, 56, 400)]
    narrow = [hero, text("a", "2UH-0", 0, "Designed line one", 280, 20, 240, 48, 32.0, mw=240.0), text("b", "2UH-0", 1, "Designed line two", 280, 80, 240, 48, 32.0, mw=240.0)]
    small = lambda name: [frame("top", None, 0, name), *[frame(f"f{i}", "top" if i == 0 else f"f{i - 1}", 0, "box") for i in range(5)], text("a", "f4", 0, "One", 0, 0, 90, 20, 16.0), text("b", "f4", 1, ", two", 0, 24, 90, 20, 18.0)]
    deep = small("page title")
    said = "Take control of your personal spending today."
    got = merges(
        spark, stacked=stacked, rows=rows, eyebrow=eyebrow, narrow=narrow, named=small("page title"), plain=small("band"), far=[("s", "b", "up", None, *frame("up", None, 0, "page title")[4:]), hung(deep[0], "up")[:6] + ("band",) + deep[0][7:], *deep[1:]],
        same=[hero, text("a", "2UH-0", 0, "Twice", 0, 0, 300), text("b", "2UH-0", 1, "twice ", 0, 80, 300)],
        beside=[hero, text("a", "2UH-0", 0, "Left", 0, 0, 300), text("b", "2UH-0", 1, "right", 100, 10, 300)],
        apart=[hero, text("a", "2UH-0", 0, "Up", 0, 0, 300), text("b", "2UH-0", 1, "down", 0, 121, 300)],
        cut=[hero, text("a", "2UH-0", 0, "One", 0, 0, 300), frame("i", "2UH-0", 1, "pic", component="Image"), text("b", "2UH-0", 2, "two", 0, 80, 300), text("c", "2UH-0", 3, "three", 0, 160, 300)],
        null=[("s", "b", "x", None, *text("x", None, 0, "No", 0, 0, 9)[4:]), ("s", "b", "y", None, *text("y", None, 1, "parent", 0, 80, 9)[4:])],
    )
    assert got == {
        "stacked": [("2UH-0", "texts", 3, "2UP-0", "2UW-0", said)], "rows": [("2UN-0", "rows", 3, "2UP-0", "2UW-0", said)], "eyebrow": [], "narrow": [], "named": [("f4", "texts", 2, "a", "b", "One, two")], "plain": [],
        "far": [], "same": [], "beside": [], "apart": [], "cut": [("2UH-0", "texts", 2, "b", "c", "two three")], "null": [],
    }


def test_split_headings_of_large_parents_and_deep_rows(spark):
    hero = frame("h", None, 0, "hero heading")
    lines = lambda n: [text(f"t{i:03}", "h", i, f"line {i}", 0, 80 * i, 300) for i in range(n)]
    chain = lambda k, n: [frame(f"{k}0", "h", ord(k), "row", 0, 80 * ord(k), 800, 72), *[frame(f"{k}{i}", f"{k}{i - 1}", 0, "box") for i in range(1, n)], text(f"{k}t", f"{k}{n - 1}", 0, f"say {k}", 0, 80 * ord(k), 300)]
    worded = lambda i, parent, said: ("s", "b", i, parent, 0, "Card", said, said, 0.0, 0.0, 9.0, 9.0, None, None, None, None)
    rows = lambda nodes: spark.createDataFrame(nodes, NODE)
    told = lambda nodes, **kw: sorted((r.kind, r.parts, r.first, r.last, r.text) for r in K.split_headings(rows(nodes), **kw).collect())
    broken = [hero, *lines(5), frame("x", "h", 5, "pic", component="Image"), *[r[:3] + ("h", r[4] + 6) + r[5:] for r in [text(f"u{i}", "h", i, f"more {i}", 0, 600 + 80 * i, 300) for i in range(4)]]]
    want = [("texts", 4, "u0", "u3", "more 0 more 1 more 2 more 3"), ("texts", 5, "t000", "t004", "line 0 line 1 line 2 line 3 line 4")]
    assert told(broken) == want and told(broken, large=3) == want  # small parents in one task, larger ones by running values
    deep = [hero, *chain("A", 6), *chain("B", 3), *chain("C", 1)]
    assert told(deep) == told(deep, large=2) == [("rows", 3, "At", "Ct", "say A say B say C")]
    assert told([*deep, text("Bx", "B1", 1, "second", 0, 0, 9)]) == []  # two texts at different depths: no row, and none beside it
    assert told([*deep, worded("Aw", "A5", "card"), text("Awt", "Aw", 0, "held by a card", 0, 0, 9)]) == [("rows", 2, "Bt", "Ct", "say B say C")]  # words with children are no text


def test_split_headings_shuffles_nodes_once(spark):
    nodes = [r for b in range(40) for r in [("s", str(b), f"{b}p", None, *frame("p", None, 0, "title")[4:]), *[("s", str(b), f"{b}l{i}", f"{b}p", *text("l", "p", i, f"line {i}", 0, 80 * i, 300)[4:]) for i in range(3)]]]
    seen, old = [], K.materialize
    K.materialize = lambda df, label, *codec: (seen.append(label), old(df, label, *codec))[1]
    try:
        assert K.split_headings(spark.createDataFrame(nodes, NODE)).count() == 40
    finally:
        K.materialize = old
    assert len(seen) <= 5 and "above" not in seen  # was 20: ancestors of all texts and a chunked table for each running value


def test_ancestors_by_pointer_jumping(spark):
    n = 37
    nodes = spark.createDataFrame([("s", i, i - 1 if i else None) for i in range(n)] + [("s", 100, 99)], "site string, node_id long, parent_id long")
    items = nodes.filter("node_id IN (0, 5, 36, 100)")
    want = {(i, a, i - a) for i in (5, 36) for a in range(i)}
    assert {(r.node_id, r.above, r.steps) for r in K.ancestors(nodes, items).collect()} == want
    assert {(r.node_id, r.above, r.steps) for r in K.ancestors(nodes, items, 6).collect()} == {w for w in want if w[2] <= 6}


def _boxes(seed, n):
    r = random.Random(seed)
    side = lambda: r.choice([0.0, 3.0, 40.0, 256.0, 257.0, 1024.0, 5000.0, 1e8])
    return [(i % 2, i, float(r.randrange(-3000, 3000)), float(r.randrange(-3000, 3000)), side(), side()) for i in range(n)]


def test_overlapping_boxes_of_all_sizes(spark):
    rows = _boxes(3, 160)
    df = spark.createDataFrame(rows, "site long, id long, x double, y double, w double, h double")
    got = [(r.a.id, r.b.id) for r in V.overlapping_boxes(df, ["site"], "id").collect()]
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and all(a[k] < b[k] + b[k + 2] and b[k] < a[k] + a[k + 2] for k in (2, 3))}
    assert len(got) == len(set(got)) and set(got) == want


def test_a_box_of_any_size_costs_a_few_rows(spark):
    axes = [("x", "w"), ("y", "h")]
    one = spark.createDataFrame([(1, 0.0, 0.0, 1e8, 1e8)], "id long, x double, y double, w double, h double")
    placed, _ = V._filed(one, [], axes, 256)
    assert V._in_cells(placed.withColumn("_at", F.col("_level")), axes, 256).count() <= 4
    rects = spark.createDataFrame([("s", "p", 1, 10.0, 1e8), ("s", "p", 2, -5.0, 5.0), ("s", "p", 3, 90.0, 20.0)], "site string, page string, rect long, y double, h double")
    sections = spark.createDataFrame([("s", "p", 0, "a", 0.0, 100.0), ("s", "p", 1, "b", 100.0, 5e7), ("s", "p", 2, "c", 100.0, 5e7)], "site string, page string, pos long, section string, y double, h double")
    got = {r.rect: (r.section, r.overlap) for r in I.section_of_rect(rects, sections).collect()}
    assert got == {1: ("b", 5e7), 2: (None, None), 3: ("a", 10.0)}


def test_spans_equal_plain_loops(spark):
    r = random.Random(9)
    spans = lambda n: [(r.randrange(2), i, float(r.randrange(-2000, 2000)), r.choice([0.0, 10.0, 600.0, 40_000.0])) for i in range(n)]
    left, right = spans(70), spans(50)
    kind = "k long, id long, at double, size double"
    got = [(x.a.id, x.b.id) for x in V.overlapping_spans(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind), ["k"]).collect()]
    want = {(a[1], b[1]) for a in left for b in right if a[0] == b[0] and a[2] < b[2] + b[3] and b[2] < a[2] + a[3]}
    assert len(got) == len(set(got)) and set(got) == want
