"""The element table and the rules that read it, on literal pages."""

from html.parser import HTMLParser

from hypothesis import given, settings, strategies as st

from quiltlens.functions.markup import VOID_TAGS
from quiltlens.operators import audit as A, components as I, elements as E, nav as N

CHROME = '<header><nav aria-label="Primary"><a href="/">Home</a></nav></header>'
FOOT = '<footer><a href="#hero">Home</a></footer>'
HERO = '<section id="hero"><h1 class="text-6xl">Welcome</h1><p>Hello there.</p></section>'


def pages_of(spark, *htmls):
    df = spark.createDataFrame([("s", i, h) for i, h in enumerate(htmls)], "site string, page_id long, html string")
    return E.page_elements(df)


def found(spark, *bodies):
    """The findings of each page, all pages in one run."""
    out = [[] for _ in bodies]
    for r in A.audit_findings(pages_of(spark, *[f"<html><body>{b}</body></html>" for b in bodies])).collect():
        out[r.page_id].append((r.check, r.kind, r.detail))
    return [sorted(f) for f in out]


def page(inner="", main='<main id="main-content">'):
    return f"{CHROME}{main}{HERO}{inner}</main>{FOOT}"


def check(spark, of, cases):
    """``cases``: page and the findings of check ``of`` (None: all) it must have."""
    got = found(spark, *[body for body, _ in cases])
    for (body, want), own in zip(cases, got):
        assert [f if of is None else f[2] for f in own if of in (None, f[0])] == want, body


def test_complete_page_passes_and_each_defect_is_found_alone(spark):
    bare = '<div id="announce">Free shipping</div><nav><a href="/">Home</a></nav><section id="hero"><h1>Welcome</h1></section><div>© 2026 All rights reserved</div>'
    check(spark, None, [
        (page(), []),
        (page('<section id="about"><h1>Second title</h1></section>'), [("heading", ">1 h1", "")]),
        (page('<input type="email" name="email">'), [("input", "unlabeled input", "email")]),
        (page('<label>Mail <input type="email"></label><label for="q">Q</label><input id="q"><input type="hidden"><textarea title="T"></textarea>'), []),
        (page(main='<main id="x">'), [("landmark", "main has wrong id", "x")]),
        (bare, [("footer", "no footer", ""), *[("landmark", k, "") for k in ("footer missing", "main missing", "nav without header", "unlabeled nav")]]),
    ])


def test_card_clusters(spark):
    section = lambda names, kids: page(f"<section {names}>{kids}</section>")
    two = '<div class="card"><h3>Design</h3><p>We design.</p></div><div class="card"><h3>Build</h3><p>We build.</p></div>'
    plain = "<ul><li><h3>A</h3><p>a</p></li><li><h3>B</h3><img alt=''></li></ul>"
    check(spark, "card", [
        (section('id="services"', "<h2>Services</h2>" + two), ["#services 2"]),
        (section('data-paper-section="work"', two), ["#work 2"]),
        (section("", '<div class="grid">' + two.replace("div", "article") + "</div>"), []),
        # unnamed cards count in a section named like a cluster, and the nearest section decides
        (section('id="team"', plain), ["#team 2"]),
        (section('id="team"', f'<section id="other">{plain}</section>'), []),
        (section('id="other"', plain), []),
        (section('id="team"', "<ul><li><article><h3>A</h3><p>a</p></article></li><li><article><h3>B</h3><p>b</p></article></li></ul>"), []),
        (section("", '<div class="card">x</div><div class="cards">y</div>'), []),  # different words
        (section('id="x"', '<section id="team"><p>t</p></section>' + plain), []),  # a section that closed before doesn't lend its name
    ])


def test_images_in_decoration_need_no_alt(spark):
    imgs = '<div data-decorative="true"><span><img src="a.png"></span></div><img src="b.png"><img src="c.png" alt=""><img src="tick.svg"><img src="d.png" data-name="bg-graphic"><img src="e.png" alt>'
    check(spark, None, [(page(imgs), [("image", "missing alt", "b.png")])])


def test_section_titles(spark):
    body = lambda title: page(f"<section><div><div>{title}</div></div></section>")
    check(spark, "title", [
        (body('<div class="text-5xl">Our work</div>'), ["div Our work"]),
        (body('<div class="text-5xl">Our work</div><h2 class="text-6xl">Bigger</h2>'), []),
        (body('<div class="text-5xl">99%</div>'), []),
        (body('<div class="font-bold">Label</div>'), []),
        (body('<div data-name="card heading">Named</div>'), ["div Named"]),
        (body('<a><span class="text-5xl">In a link</span></a>'), []),
        (body(f'<div class="text-5xl">{"x" * 81}</div>'), []),
        (body(f'<div class="text-5xl">{"x " * 40}</div>'), [f"div {('x ' * 40).strip()}"]),
    ])


def test_type_census_reads_wrappers(spark):
    html = ('<body class="text-9xl text-right"><div class="text-xl" style="text-align: left"><div><p>two up</p></div><div><div><p>three up</p></div></div></div><h2 class="text-sm text-lg" style="text-align:RIGHT">own</h2>'
            '<div class="justify-center"><p style="--x: --text-2xl">centred</p></div><p> </p><p>' + "y" * 201 + "</p></body>")
    got = [(r.text, r.align, r["size"], r.pos) for r in A.type_census(pages_of(spark, html)).orderBy("pos").collect()]
    assert got == [("two up", "start", "text-xl", 0), ("three up", "start", None, 1), ("own", "end", "text-lg", 2), ("centred", "center", "text-2xl", 3)]


def test_menus(spark):
    two = "<a>One</a><a>Two</a>"
    cases = [
        ('<nav><ul><li><a href="#">Shop</a><ul><li><a>Men</a></li><li><a>Women</a></li></ul></li></ul></nav>', [("Shop", ["Men", "Women"])]),
        (f"<nav><button>More</button><div>{two}</div></nav>", [("More", ["One", "Two"])]),
        (f"<nav><button>More</button><p>between</p><div>{two}</div></nav>", []),
        # the panel lies elsewhere in the trigger's dropdown
        ('<nav><div data-nav-dropdown><span><a aria-haspopup="true">Menu: Far</a></span><p>x</p><div data-nav-dropdown-panel><a>One</a><b><a>Two</a></b><a>far</a></div></div></nav>', [("Menu: Far", ["One", "Two"])]),
        (f'<nav><a class="logo">Acme</a><div>{two}</div><div id="nav-panel"><button>In drawer</button><ul><li><a>One</a></li><li><a>Two</a></li></ul></div></nav>', []),
        (f"<header><nav></nav></header><nav><button>Other</button><div>{two}</div></nav>", []),  # only the first scope is read
        ('<div><a>All Pages</a><p>t</p><div data-framer-name="Mega Menu"><a href="/a">One</a><a href="/b">Two</a></div></div>', [("All Pages", ["One", "Two"])]),
        ("<nav><button>Solo</button><ul><li><a>One</a></li></ul></nav>", []),
        ("", []),
    ]
    got = {i: [] for i in range(len(cases))}
    for r in N.nav_menus(pages_of(spark, *[h for h, _ in cases])).orderBy("label").collect():
        got[r.page_id].append((r.label, r["items"]))
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_component_census(spark):
    none = spark.createDataFrame([], "site string, name string")
    nominated = spark.createDataFrame([("s", "Price Table")], "site string, name string")
    htmls = ['<!-- component: promo-box --><div><a class="btn-primary">x</a></div><header><a class="pill">y</a></header>',
             '<button class="price-table">z</button><a class="other">-</a><button data-component="Own thing">w</button><!-- component: void --><img><a class="navbar-link">n</a><div class="x">no block</div>']
    got = sorted((r.name, r.tag, r.uses, r.pages, r.reason) for r in I.component_census(pages_of(spark, *htmls), nominated, none).collect())
    assert got == [("BtnPrimary", "a", 1, 1, "nominated"), ("Header", "header", 1, 1, "chrome"), ("OwnThing", "button", 1, 1, "backed"), ("PriceTable", "button", 1, 1, "nominated"), ("PromoBox", "div", 1, 1, "comment")]


def test_reports_and_rollup(spark):
    pages = pages_of(
        spark, f'{CHROME}<main id="main-content">{HERO}</main>{FOOT}', '<a class="skip-link" href="#m">x</a><img src="a.png"><img src="b.png">')
    findings = A.audit_findings(pages)
    got = {r.page_id: (r.ok, r.findings, r.failed, r.h1, r.skip_link, r.main_id) for r in A.page_reports(pages, findings).collect()}
    assert got == {0: (True, 0, "", 1, False, "main-content"), 1: (False, 4, "heading:1;image:2;footer:1", 0, True, "")}
    rolled = {(r.site, r.check): (r.pages, r.failing_pages, r.findings, r.pass_rate) for r in A.audit_rollup(pages, findings).collect()}
    assert rolled == {("s", "all"): (2, 1, 4, 0.5), ("all", "all"): (2, 1, 4, 0.5), ("s", "heading"): (2, 1, 1, 0.5), ("s", "image"): (2, 1, 2, 0.5), ("s", "footer"): (2, 1, 1, 0.5)}


def test_null_and_odd_markup(spark):
    pages = pages_of(spark, None, "", "no tags", "<", "<p", "</div>", '<a href="x>y', "<div <p>>t")
    assert [len(r.els) for r in pages.orderBy("page_id").collect()][:6] == [0] * 6
    assert A.audit_findings(pages).count() > 0 and A.type_census(pages).count() == 0 and N.nav_menus(pages).count() == 0
    kept = E.page_elements(spark.createDataFrame([(1, "<b>x</b>", "mine")], "page_id long, html string, els string"))
    assert kept.columns == ["page_id", "said", "els"] and E.element_rows(kept).collect()[0].text == "x"


class _Tree(HTMLParser):
    """The same nesting, built by the standard library's tokeniser."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.open, self.seen = [], []

    def handle_starttag(self, tag, attrs):
        self.seen.append((tag, self.open[-1][1] if self.open else -1, dict(attrs).get("id") or ""))
        if tag not in VOID_TAGS:
            self.open.append((tag, len(self.seen) - 1))

    def handle_startendtag(self, tag, attrs):
        self.seen.append((tag, self.open[-1][1] if self.open else -1, dict(attrs).get("id") or ""))

    def handle_endtag(self, tag):
        for d in range(len(self.open) - 1, -1, -1):
            if self.open[d][0] == tag:
                del self.open[d:]
                break


TOKENS = ["<div>", "<p>", "</p>", "</div>", "<br>", "<img id='i'>", "<b/>", "<ul id=u>", "<li>", "</li>", "</ul>", "text ", "</b>", '<a id="a>b">', "</a>", " more", "<H2 ID=h>", "</H2>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(TOKENS), max_size=25).map("".join))
def test_nesting_equals_the_standard_parser(html):
    tree = _Tree()
    tree.feed(html)
    tree.close()
    said, els = E.tokenise(html)
    assert [(e[1], e[5], e[11].get("id", "")) for e in els] == tree.seen
    for e in els:  # descendants are a run after the element, and their words lie inside its words
        kin = [d for d in els if e[0] < d[0] <= e[6]]
        assert all(e[7] <= d[7] <= d[8] <= e[8] for d in kin) and all(d[5] == e[0] or any(d[5] == k[0] for k in kin) for d in kin)
