"""Element table: the tags of a page as nested intervals, from one tokenising pass.

Every page is one row with an array of elements in document order. An element knows its parent, its last descendant and,
for the kinds that rules ask about, its nearest ancestor, so that rules on ancestors and descendants are filters inside
the row: no shuffle, no second look at the markup.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quiltlens.functions.markup import VOID_TAGS

# Ancestors that elements remember: tags, and under a name of its own anything with an attribute.
NEAR_TAGS = ["header", "nav", "main", "footer", "section", "article", "label", "a", "button", "input", "textarea", "select", "li", "form"]
NEAR_ATTRS = {"data-decorative": "decorative", "data-nav-dropdown": "dropdown"}
NAV_PANEL = "nav-panel"  # the id of the drawer that repeats the navigation
# How builders name the panel of a menu, and where they put names.
PANEL_NAME = re.compile(r"mega\s*-?\s*menu|drop\s*-?\s*down|sub\s*-?\s*menu|menu\s*panel", re.I)
BUILDER_NAMES = ["data-framer-name", "data-w-id-name", "data-name"]
COMMENT = "!"

ELEMENT = (
    "i int, tag string, start int, stop int, level int, parent int, last int, t0 int, t1 int, own boolean, shut boolean, "
    "attrs map<string, string>, near map<string, int>"
)
_TOKEN = re.compile(
    r"<!--(?P<note>.*?)-->|<(?P<raw>script|style|noscript)\b[^>]*>.*?</(?P=raw)\s*>|</(?P<end>[a-z][\w:-]*)[^>]*>"
    r"|<(?P<tag>[a-z][\w:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<odd>[a-z][\w:-]*)(?P<odd_attrs>[^>]*)>|<![^>]*>",
    re.I | re.S,
)
_ATTR = re.compile(r"""([^\s=/>"'][^\s=/>]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_MAP = pa.map_(pa.string(), pa.string())
_NEAR = pa.map_(pa.string(), pa.int32())
_FIELDS = [pa.field(n, t) for n, t in (
    ("i", pa.int32()), ("tag", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("level", pa.int32()), ("parent", pa.int32()), ("last", pa.int32()),
    ("t0", pa.int32()), ("t1", pa.int32()), ("own", pa.bool_()), ("shut", pa.bool_()), ("attrs", _MAP), ("near", _NEAR))]


def named_panel(attrs: dict[str, str]) -> bool:
    return any(PANEL_NAME.search(attrs[n]) for n in BUILDER_NAMES if n in attrs)


def tokenise(html: str) -> tuple[str, list[list]]:
    """The page's words, and its elements as ``ELEMENT`` lists.

    An end tag closes the innermost open element of its name and all that opened inside; one that closes nothing is
    left out. Void and self-closed tags hold nothing; what is never closed ends with its parent (``shut`` is false).
    Comments are elements named ``!`` with their text as attribute ''. The content of script, style and noscript is gone.
    """
    els: list[list] = []
    stack: list[int] = []
    near: dict[str, list[int]] = {}
    said: list[str] = []
    size = at = 0

    def text(chunk: str) -> None:
        nonlocal size
        words = " ".join(chunk.split())
        if words:
            size += len(words) + bool(said)
            said.append(words)
            if stack:
                els[stack[-1]][9] = True

    def close(i: int, stop: int, shut: bool) -> None:
        e = els[i]
        e[3], e[6], e[8], e[10] = stop, len(els) - 1, size, shut
        for k in e[13]:
            near[k].pop()

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            text(html[at:m.start()])
        at = m.end()
        if (end := m["end"]) is not None:
            name = end.lower()
            hit = next((d for d in range(len(stack) - 1, -1, -1) if els[stack[d]][1] == name), None)
            if hit is not None:
                for d in range(len(stack) - 1, hit, -1):
                    close(stack[d], m.start(), False)
                close(stack[hit], at, True)
                del stack[hit:]
            continue
        name, src = (m["tag"] or m["odd"] or "").lower(), m["attrs"] or m["odd_attrs"] or ""
        if m["note"] is not None:
            name, attrs = COMMENT, {"": m["note"]}
        elif name:
            attrs = {k.lower(): a or b or c or "" for k, a, b, c in _ATTR.findall(src)}
        else:
            continue
        parent = stack[-1] if stack else -1
        els.append([len(els), name, m.start(), at, len(stack), parent, len(els), size, size, False, False, attrs, {k: v[-1] for k, v in near.items() if v}, ()])
        if name == COMMENT or name in VOID_TAGS or src.rstrip().endswith("/"):
            continue
        kinds = [name] if name in NEAR_TAGS else []
        kinds += [kind for attr, kind in NEAR_ATTRS.items() if attr in attrs]
        kinds += [NAV_PANEL] if attrs.get("id") == NAV_PANEL else []
        kinds += ["panel"] if named_panel(attrs) else []
        els[-1][13] = kinds
        for k in kinds:
            near.setdefault(k, []).append(len(els) - 1)
        stack.append(len(els) - 1)
    if at < len(html):
        text(html[at:])
    for i in reversed(stack):
        close(i, len(html), False)
    return " ".join(said), els


def page_elements(corpus: DataFrame, html_col: str = "html") -> DataFrame:
    """``corpus`` with ``said`` (the words of the page) and ``els`` (its elements in document order) instead of the markup.

    ``i`` is an element's place in ``els``; ``start`` and ``stop`` are its offsets in the markup; ``parent`` (-1: none) and
    ``last`` (its last descendant, itself without any) are places; ``t0`` and ``t1`` bound its words in ``said``; ``own``
    says that it has words of its own; ``near`` maps a kind of ancestor to the place of the nearest one. Null markup has
    no elements. One narrow pass: pages are never shuffled and a task holds a few pages at a time.
    """
    rest = [c for c in corpus.columns if c not in (html_col, "said", "els")]

    def read(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                piece = batch.slice(start, 64)
                pages = [tokenise(h or "") for h in piece.column(html_col).to_pylist()]
                offsets, flat = [0], []
                for _, els in pages:
                    flat += els
                    offsets.append(len(flat))
                columns = list(zip(*flat)) or [()] * 14
                arrays = [pa.array([list(v.items()) for v in c] if pa.types.is_map(f.type) else c, f.type) for f, c in zip(_FIELDS, columns)]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(arrays, fields=_FIELDS))
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in rest), pa.array([p[0] for p in pages], pa.string()), lists], names=[*rest, "said", "els"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in corpus.schema if f.name in rest)
    return corpus.select(*rest, html_col).mapInArrow(read, f"{kinds}, said string, els array<struct<{ELEMENT.replace(' ', ':').replace(',:', ', ').replace('map<string, ', 'map<string,')}>>")


def element_rows(pages: DataFrame) -> DataFrame:
    """One row per element of ``page_elements``: the page's columns and the element's."""
    rest = [c for c in pages.columns if c not in ("said", "els")]
    rows = pages.select(*rest, "said", F.explode("els").alias("e"))
    return rows.select(*rest, "e.*", words(F.col("e")).alias("text"))


def attr(e: Column, name: str) -> Column:
    return F.coalesce(e["attrs"][name], F.lit(""))


def has_attr(e: Column, name: str) -> Column:
    return e["attrs"][name].isNotNull()


def words(e: Column, said: str = "said") -> Column:
    """The words inside an element, one space between any two."""
    return F.trim(F.substring(F.col(said), e["t0"] + 1, e["t1"] - e["t0"]))


def under(e: Column, *kinds: str) -> Column:
    """The element lies inside one of these kinds."""
    out = F.lit(False)
    for k in kinds:
        out = out | e["near"][k].isNotNull()
    return out


def inside(e: Column, els: str = "els") -> Column:
    """The descendants of an element, without comments."""
    return F.filter(F.slice(F.col(els), e["i"] + 2, F.greatest(e["last"] - e["i"], F.lit(0))), lambda d: d["tag"] != COMMENT)


def children(e: Column, els: str = "els") -> Column:
    return F.filter(inside(e, els), lambda d: d["parent"] == e["i"])


def at(i: Column, els: str = "els") -> Column:
    """The element at a place; null for -1 or null."""
    return F.get(F.col(els), i)


def of_tag(*tags: str, els: str = "els") -> Column:
    return F.filter(F.col(els), lambda e: e["tag"].isin(*tags))


def blob(e: Column, *names: str) -> Column:
    """The values of the named attributes, in this order, with spaces between them."""
    return F.concat_ws(" ", *[attr(e, n) for n in names])
