"""Containment, colour merging, variable chains, digest trees and receipt files against plain loops and literals."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quiltlens.operators import components as I, containment as N, snapshots as J, tokens as H
from quiltlens.sources import receipts as R


def test_containment_equals_plain_loops(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("ab c") for _ in range(r.choice([0, 1, 2, 3, 4, 6, 11])))
    texts = [(r.randrange(2), word()) for _ in range(60)]
    rows = [(r.randrange(2), word(), i) for i in range(80)]
    t, v = spark.createDataFrame(texts, "k long, text string"), spark.createDataFrame(rows, "k long, text string, v long")
    for name, holds in (("around", lambda a, b: a in b), ("within", lambda a, b: b in a)):
        want = {}
        for k, a in texts:
            hits = [i for kk, b, i in rows if a and b and k == kk and holds(a, b)]
            if hits:
                want[k, a] = (min(hits), max(hits))
        got = {(x.k, x.text): (x.lo, x.hi) for x in getattr(N, name)(t, v, ["k"], "v").collect()}
        assert got == want, name


def test_a_long_label_costs_its_length(spark):
    long = " ".join(f"w{i % 890}" for i in range(2200))[:10_000]
    index = N._index(spark.createDataFrame([("s", long)], "site string, text string"), ["site"])
    assert index.count() <= 3 * len(long)
    controls = spark.createDataFrame([("s", 1, "a", "", ["x"], "w7 w8"), ("s", 2, "a", "", ["x"], "no such"), ("s", 3, "a", "", ["x"], long + " and more")], "site string, control long, tag string, id string, classes array<string>, text string")
    rules = spark.createDataFrame([("s", 1, ".x:hover", "color", "red")], "site string, pos long, selector string, prop string, value string")
    buttons = spark.createDataFrame([("s", 10, long), ("s", 11, "zzz")], "site string, button long, label string")
    got = {x.button: (x.control, x.status) for x in I.hover_recipes(rules, controls, buttons).collect()}
    assert got == {10: (1, "applied"), 11: (None, "no control")}


def _greedy(counts, threshold):
    out = {}
    for site in {s for s, *_ in counts}:
        kept = []
        for _, value, uses, c in sorted((x for x in counts if x[0] == site), key=lambda x: (-x[2], x[1])):
            near = next((k for k in kept if sum(abs(a - b) for a, b in zip(c, k[1])) <= threshold), None)
            if near:
                out[site, near[0]] = (out[site, near[0]][0] + uses, out[site, near[0]][1] + 1)
            else:
                kept.append((value, c))
                out[site, value] = (uses, 0)
    return out


@pytest.mark.parametrize("giant", [20_000, 3])
def test_colours_merge_greedily_in_rank_order(spark, giant):
    r = random.Random(5)
    chain = [tuple([20 + 7 * i] * 1 + [40, 40]) for i in range(30)]  # each near the next, so that ranks decide
    colours = chain + [(r.randrange(40), r.randrange(40), r.randrange(40)) for _ in range(60)]
    counts = [(s, "#%02X%02X%02X" % c, r.randrange(1, 30), (*c, 255)) for s in ("a", "b") for c in dict.fromkeys(colours)]
    counts += [("a", "#28282880", 3, (40, 40, 40, 128)), ("a", "rgb(40, 40, 40)", 3, (40, 40, 40, 255))]
    df = spark.createDataFrame([(s, v, u) for s, v, u, _ in counts] + [("a", "none", 9)], "site string, value string, uses long")
    got = {(x.site, x.value): (x.uses, x.merged) for x in H.merge_near_colors(df, giant=giant).collect()}
    assert got == _greedy(counts, 12)


def _followed(tokens):
    out = {}
    for site, name, value in tokens:
        table = {n: v for s, n, v in tokens if s == site}
        seen, v = [], value
        while v.startswith("var(") and (ref := v[4:-1]) in table and ref not in seen:
            seen.append(ref)
            v = table[ref]
        out[site, name] = (v, len(seen))
    return out


def test_variable_chains_and_cycles(spark):
    tokens = [("a", f"--c{i}", f"var(--c{i + 1})") for i in range(70)] + [("a", "--c70", "#111")]
    tokens += [("a", f"--r{i}", f"var(--r{(i + 1) % 5})") for i in range(5)] + [("a", f"--t{i}", f"var(--t{i + 1})") for i in range(9)] + [("a", "--t9", "var(--r2)")]
    tokens += [("a", "--self", "var(--self)"), ("a", "--to-self", "var(--self)"), ("a", "--lost", "var(--nowhere)"), ("a", "--x", "var(--lost)"), ("b", "--c0", "var(--r0)"), ("b", "--r0", "var(--c0)"), ("b", "--p", "1px")]
    df = spark.createDataFrame(tokens, "site string, name string, value string")
    got = {(x.site, x.name): (x.value, x.hops) for x in H.resolve_vars(df).collect()}
    assert got == _followed(tokens)
    assert H.resolve_vars(df.limit(0)).count() == 0 and H.resolve_vars(df.filter("name = '--p'")).count() == 1


def _digest(lines, leaf, depth=None, prefix=""):
    """Top down: a node is its lines, or the digests of its sixteen parts."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if depth is None:
        depth = 0
        while len(lines) > leaf * 16**depth:
            depth += 1
    if len(prefix) == depth:
        return sha("\n".join(sorted(f"{line} {n}" for line, n in lines.items())))
    parts = {}
    for line, n in lines.items():
        parts.setdefault(sha(line)[:len(prefix) + 1], {})[line] = n
    return sha("\n".join(sorted(f"{p} {_digest(own, leaf, depth, p)}" for p, own in parts.items())))


def test_digest_tree(spark):
    sizes = {"one": 1, "few": 4, "many": 300, "deep": 1500}
    files = [(1, phase, f"f/{i}", f"h{i % 9}", i) for phase, n in sizes.items() for i in range(n)] + [(1, "few", "f/0", "h0", 5), (None, "few", "x", "y", 1)]
    df = spark.createDataFrame(files, "run_id long, phase string, path string, sha256 string, bytes long")
    want = {}
    for run, phase, path, sha, _ in files:
        lines = want.setdefault((run, phase), {})
        lines[f"{path} {sha}"] = lines.get(f"{path} {sha}", 0) + 1
    got = {(x.run_id, x.phase): (x.digest, x.files) for x in J.manifest_digest(df.repartition(5), leaf=5).collect()}
    assert got == {k: (_digest(lines, 5), sum(lines.values())) for k, lines in want.items()}
    assert got == {(x.run_id, x.phase): (x.digest, x.files) for x in J.manifest_digest(df.orderBy(F.desc("path")), leaf=5).collect()}


def test_a_broken_file_among_good_ones(spark, tmp_path):
    good = '{"seq": %d, "id": "s", "type": "t", "event": {"count": %d}}'
    for name, text in (("a.json", good % (1, 7)), ("sub/b.json", "[%s,\n %s]" % (good % (2, 8), good % (3, 9))), ("cut.json", "[" + good % (4, 1)), ("kind.json", '[{"seq": 5}, {"seq": "six"}]'), ("text.json", "no json"), ("empty.json", "")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    rows, bad = R.read_receipt_files(spark, str(tmp_path), R.EVENT_SCHEMA)
    assert sorted((r.file.rsplit("/", 1)[1], r.seq, r.event["count"]) for r in rows.collect()) == [("a.json", 1, 7), ("b.json", 2, 8), ("b.json", 3, 9)]
    assert sorted(r.file.rsplit("/", 1)[1] for r in bad.collect()) == ["cut.json", "kind.json", "text.json"] and all(r.bytes and r.error for r in bad.collect())


def test_colours_of_usual_sites_move_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(H, "materialize", lambda df, label, f=H.materialize: written.append(label) or f(df, label))
    rows = [(f"s{i % 7}", "#%02X%02X%02X" % (i % 50, i % 41 * 5, i % 13), i % 9 + 1) for i in range(600)]
    merged = H.merge_near_colors(spark.createDataFrame(list({(s, v): (s, v, u) for s, v, u in rows}.values()), "site string, value string, uses long"))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert written == ["colours", "colour-sites"]
    assert merged.agg(F.sum("uses")).first()[0] == sum(u for _, _, u in {(s, v): (s, v, u) for s, v, u in rows}.values())


def test_dense_and_gridded_folds_agree():
    r = random.Random(8)
    rows = [("s", "#%03d" % i, 700 - i, r.randrange(60), r.randrange(60), r.randrange(60), 255) for i in range(H.DENSE)]
    dense = list(H._folded(iter(rows), 12))
    kept = {v: into for _, v, into in H._greedy(((s, 0, v, *c) for s, v, _, *c in rows), 12)}
    want = {v: [u, 0] for _, v, u, *_ in rows if kept[v] is None}
    for _, v, u, *_ in rows:
        if kept[v]:
            want[kept[v]][0] += u
            want[kept[v]][1] += 1
    assert dense == [("s", v, *x) for v, x in want.items()]


def test_semantic_roles_meet_the_brand_once(spark):
    pool = spark.createDataFrame([("s", "fill", "#FBFBFB", 3), ("s", "fill", "#F2F2F2", 2), ("s", "text", "#333333", 5), ("s", "text", "#111", 4), ("s", "fill", "#E11D2E", 9), ("s", "fill", "#0A0B70", 7)], "site string, kind string, value string, uses long")
    brand = spark.createDataFrame([("s", "--color-surface", "#FAFAFA"), ("s", "--color-accent", "#E11D2E")], "site string, name string, value string")
    out = H.semantic_roles(pool, brand)
    assert "brand" not in out._jdf.queryExecution().optimizedPlan().toString()  # the joined colours are read, not worked out again
    assert {(r.name, r.value) for r in out.collect()} == {("--color-surface-muted", "#F2F2F2"), ("--color-ink-soft", "#333333"), ("--color-ink-strong", "#111")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    from pyspark.sql import functions as F

    from quiltlens.session import _CLEANUP, materialize

    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before, setting = tracker.shuffleStatuses().size(), spark.conf.get(_CLEANUP, None)
    kept = [materialize(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")), "kept") for _ in range(3)]
    assert all(k.count() == 7 for k in kept) and spark.conf.get(_CLEANUP, None) == setting
    held = lambda: tracker.shuffleStatuses().size() - before
    assert held() <= 3  # a shuffle for each count; was one more for each write
