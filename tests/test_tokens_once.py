"""Styles are counted once for all tokens of a query, values are read once, and nodes meet a site's tokens as they are."""

import pytest

from quiltlens.operators import tokens as H
from quiltlens.plans import load_all, registry, tokens as P

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["propose_tokens", "token_contract", "bind_tokens", "bind_qa"])
def test_styles_are_counted_once(spark, monkeypatch, name):
    load_all()
    counted, merged = [], []
    monkeypatch.setattr(P, "counts", lambda s, d, f=P.counts: counted.append(d) or f(s, d))
    monkeypatch.setattr(H, "merge_near_colors", lambda *a, f=H.merge_near_colors: merged.append(a) or f(*a))
    registry.QUERIES[name](spark, DIR)
    assert (len(counted), len(merged)) == (1, 1)


@pytest.mark.parametrize("limit", [2_000, 2, 0])
def test_values_are_bound_by_what_they_say(spark, monkeypatch, limit):
    monkeypatch.setattr(H, "SITE_TOKENS", limit)
    tokens = [("a", "color", "--c2", "#111", 5), ("a", "color", "--c1", "#111111", 5), ("a", "color", "--bad", "no colour", 9), ("a", "fontFamily", "--f", "Inter-Bold", 1), ("a", "color", "--clear", "rgba(0,0,0,0)", 1),
              ("b", "fontSize", "--s", "2rem", 1), ("b", "fontSize", "--t", "99px", 1), (None, "color", "--n", "#111", 1)]
    rows = [("a", 1, "color", "color", "rgb(17, 17, 17)", "--c1", "change", ""), ("a", 2, "color", "color", " transparent", None, "skip", "transparent"), ("a", 2, "fill", "color", "rgba(0,0,0,0)", None, "skip", "transparent"),
            ("a", 3, "color", "color", "blurple", None, "leftover", "unreadable value"), ("a", 4, "fontFamily", "fontFamily", "inter, serif", "--f", "change", ""), ("a", 4, "fontFamily", "fontFamily", "inter, serif", "--f", "change", ""),
            ("a", 5, "fontSize", "fontSize", "32px", None, "leftover", "no token of this type"), ("b", 6, "fontSize", "fontSize", "32px", "--s", "change", ""), ("b", 7, "fontSize", "fontSize", "31px", None, "leftover", "no token with this value"),
            ("b", 8, "color", "color", "VAR(--x)", None, "skip", "already bound"), ("c", 9, "color", "color", "#111", None, "leftover", "no token of this type"), ("a", 10, "color", "color", None, None, "leftover", "unreadable value"),
            (None, 11, "color", "color", "#111", None, "leftover", "no token of this type"), ("a", 12, "x", None, "#111", None, "leftover", "no token of this type")]
    styles = spark.createDataFrame([r[:5] for r in rows], "site string, node_id long, prop string, type string, value string")
    t = spark.createDataFrame(tokens, "site string, type string, name string, value string, uses long")
    assert sorted(map(str, map(tuple, H.bind_tokens(styles, t).collect()))) == sorted(map(str, rows))
    nodes = spark.createDataFrame([("a", 1, "#111", None), ("b", 2, "#111", "2rem")], "site string, node_id long, ink string, size string")
    props = [("color", "color", "ink"), ("fontSize", "fontSize", "size")]
    values = spark.createDataFrame([("color", "#111"), ("fontSize", "2rem"), ("fontSize", None)], "type string, value string")
    got = sorted((r.node_id, r.prop, r.token, r.reason) for r in H.bind_nodes(nodes, t, props, values).collect())
    assert got == [(1, "color", "--c1", ""), (1, "fontSize", None, "unreadable value"), (2, "color", None, "no token of this type"), (2, "fontSize", "--s", "")]


def test_written_lengths_are_counted_by_what_they_say(spark):
    nodes = spark.createDataFrame([("a", "24px", "normal", "16px"), ("a", "1.5", "0rem", "20px"), ("a", None, "-0.8px", "16px"), ("b", "1.5", "x", None)], "site string, lead string, track string, size string")
    got = sorted((r.site, r.kind, r.value, r.uses) for r in H.leading_tracking_counts(nodes).collect())
    assert got == [("a", "leading", "150%", 2), ("a", "tracking", "-0.05rem", 1), ("a", "tracking", "0rem", 2), ("b", "leading", "150%", 1)]
