"""Design-token mining: tally, rank, merge, name, bind.

Styles are mined as counts first, so everything after ``tally`` works on distinct values per
site. Top-k lists are ranked under a limit that Spark applies before the shuffle.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quiltlens.functions import colors as C, markup as M
from quiltlens.operators.inventory import dedupe_first
from quiltlens.session import materialize, spread

MIN_USES = 3
NEAR = 12
CLAIMED = 4
TRANSPARENT = r"(?i)^\s*(transparent|none|rgba\(\s*0\s*,\s*0\s*,\s*0\s*,\s*0\s*\))\s*$"


def _once(value: Column) -> Column:
    """A one-row generator: later filters read the finished column instead of repeating its expression."""
    return F.explode(F.array(value))


def unpivot_styles(nodes: DataFrame) -> DataFrame:
    """``nodes(site, board, node_id, name, style MAP)`` → one row per node and property."""
    return nodes.select("site", "board", "node_id", "name", F.explode("style").alias("prop", "value"))


def _px(value: Column) -> Column:
    number = F.regexp_extract(value, r"^\s*([-+]?[0-9]*\.?[0-9]+)", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(value, r"([a-z%]*)\s*$", 1))
    size = C.let(unit, lambda u: F.when(u == "rem", number * 16).when(u.isin("px", ""), number))
    return F.when(value.contains("var("), F.lit(None)).otherwise(size)


def _measured(value: Column, font_size: Column, text: Callable[[Column, Column, Column], Column]) -> Column:
    """``text(v, number, fs)`` over the trimmed value, the number it starts with and the font size in px, each worked out once."""
    number = lambda v: F.regexp_extract(v, r"^([-+]?[0-9]*\.?[0-9]+)", 1).try_cast("double")
    staged = C.let(F.lower(F.trim(value)), lambda v: F.struct(v.alias("v"), number(v).alias("number"), _px(font_size).alias("fs")))
    return C.let(staged, lambda s: F.when(~s["v"].contains("var("), text(s["v"], s["number"], s["fs"])))


def line_height_percent(value: Column, font_size: Column) -> Column:
    """Unitless, px, rem, em and % line heights as whole percents of the font size."""
    def text(v, number, fs):
        share = (
            F.when(v.rlike("%$"), number).when(v.rlike("px$"), number / fs * 100).when(v.rlike("rem$"), number * 16 / fs * 100)
            .when(v.rlike("em$"), number * 100).when(v.rlike(r"^[0-9]*\.?[0-9]+$"), number * 100)
        )
        return C.let(share, lambda x: F.when(x > 0, F.concat(F.round(x).cast("bigint").cast("string"), F.lit("%"))))

    return _measured(value, font_size, text)


def letter_spacing_rem(value: Column, font_size: Column) -> Column:
    def text(v, number, fs):
        rem = (
            F.when(v == "normal", F.lit(0.0)).when(v.rlike("rem$"), number)
            .when(v.rlike("em$"), F.when(fs > 0, number * fs / 16).otherwise(number))
            .when(v.rlike(r"px$|^[-+]?[0-9]*\.?[0-9]+$"), number / 16)
        )
        # null numbers are not written out
        shown = C.let(rem, lambda x: F.when(x.isNotNull(), F.regexp_replace(F.format_string("%.3f", F.round(x, 3) + F.lit(0.0)), r"\.?0+$", "")))
        return C.let(shown, lambda t: F.concat(F.when(t.isin("-0", ""), "0").otherwise(t), F.lit("rem")))

    return _measured(value, font_size, text)


def tally(styles: DataFrame, min_uses: int = MIN_USES) -> DataFrame:
    """``styles(site, node_id, name, kind, value)`` → ranked counts with up to four example names.

    Counts are a partial aggregate; examples come from a top-4 limit, never from a full list.
    """
    counts = styles.groupBy("site", "kind", "value").agg(F.count("*").alias("uses")).filter(F.col("uses") >= min_uses)
    w = W.partitionBy("site", "kind", "value").orderBy("node_id")
    few = styles.select("site", "kind", "value", "node_id", "name").withColumn("_n", F.row_number().over(w)).filter("_n <= 4")
    examples = few.groupBy("site", "kind", "value").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "name"))), lambda e: e["name"]), "|").alias("examples")
    )
    return counts.join(examples, ["site", "kind", "value"])


def top_k(rows: DataFrame, keys: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("bigint")).filter(F.col(name) <= k)


GIANT = 20_000  # colours of one site or component that are folded in one piece; larger components are settled in rounds
CHANNELS = ["r", "g", "b", "al"]


def _rows(batches, *columns):
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def _batches(rows, schema: pa.Schema, size: int = 20_000):
    while held := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_STEPS = list(itertools.product((-1, 0, 1), repeat=4))


def _cell_components(rows):
    """``(site, r, g, b, al, part)`` for occupied cells ``(site, r, g, b, al)`` in the order of their sites.

    Cells that touch, corners included, are one part. A site has at most as many cells as the colour cube.
    """
    for site, own in itertools.groupby(rows, key=itemgetter(0)):
        spots = dict.fromkeys((c[1:] for c in own), -1)
        number = 0
        for spot in spots:
            if spots[spot] >= 0:
                continue
            spots[spot], stack = number, [spot]
            while stack:
                r, g, b, al = stack.pop()
                for dr, dg, db, da in _STEPS:
                    near = (r + dr, g + dg, b + db, al + da)
                    if spots.get(near, 0) < 0:
                        spots[near] = number
                        stack.append(near)
            number += 1
        for spot, part in spots.items():
            yield site, *spot, part


def _greedy(rows, threshold: int):
    """``(site, value, into)`` for colours ``(site, part, value, r, g, b, al)`` that come part by part in rank order.

    Each colour joins the first kept one that is near, or is kept. Only the kept colours of one part are held.
    """
    for (site, _), own in itertools.groupby(rows, key=itemgetter(0, 1)):
        kept: dict[tuple, list[tuple]] = {}
        for rank, (_, _, value, *c) in enumerate(own):
            r, g, b, al = (x // threshold for x in c)
            near = kept and [k for dr, dg, db, da in _STEPS for k in kept.get((r + dr, g + dg, b + db, al + da), ()) if sum(abs(x - y) for x, y in zip(c, k[2])) <= threshold]
            if near:
                yield site, value, min(near)[1]
            else:
                kept.setdefault((r, g, b, al), []).append((rank, value, c))
                yield site, value, None


DENSE = 512  # colours of a site up to which all its distances are taken at once


def _nearest_kept(channels: np.ndarray, threshold: int) -> list[int]:
    """For colours in rank order the index of the first kept one that is near, or -1: the colour is kept."""
    apart = np.zeros((len(channels), len(channels)), dtype=np.int16)  # four channels of up to 255 each
    for c in channels.T:
        apart += np.abs(c[:, None] - c[None, :])
    near = apart <= threshold
    into = [-1] * len(channels)
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1)))):  # by i, then by j: i is settled when its turn comes
        if into[i] < 0 and into[j] < 0:
            into[j] = i
    return into


def _folded(rows, threshold: int):
    """``(site, value, uses, merged)`` for colours ``(site, value, uses, r, g, b, al)`` that come site by site in rank order.

    A site's colours are held; their uses and the number of colours that joined go to the kept one.
    """
    for site, own in itertools.groupby(rows, key=itemgetter(0)):
        own = list(own)
        if len(own) <= DENSE:
            into = _nearest_kept(np.array([r[3:] for r in own], dtype=np.int16), threshold)
        else:
            rank = {r[1]: i for i, r in enumerate(own)}
            into = [-1 if kept is None else rank[kept] for _, _, kept in _greedy(((site, 0, r[1], *r[3:]) for r in own), threshold)]
        uses, merged = [r[2] for r in own], [0] * len(own)
        for j, i in enumerate(into):
            if i >= 0:
                uses[i] += own[j][2]
                merged[i] += 1
        yield from ((site, own[i][1], uses[i], merged[i]) for i, at in enumerate(into) if at < 0)


def merge_near_colors(counts: DataFrame, threshold: int = NEAR, giant: int = GIANT) -> DataFrame:
    """Greedy merge by rank: a colour joins the first kept colour within ``threshold``.

    Sites of up to ``giant`` colours, which are nearly all, are folded in one sorted stream that gives their result; their
    colours move once. Of larger sites, colours can only meet within a component of touching grid cells. The cells of a
    site, no more than the colour cube has, are labelled in one piece; then each component of up to ``giant`` colours is
    folded in rank order, all in one job. Larger ones are settled in rounds: a colour is kept once every near colour ranked
    before it was absorbed, and absorbed once one of them is kept.
    """
    parsed = counts.withColumn("c", _once(C.parse(F.col("value")))).filter("c IS NOT NULL")
    colours = materialize(parsed.select("site", "value", "uses", *[F.col(f"c.{ch}").cast("int").alias(ch) for ch in CHANNELS]), "colours")
    site, kind = colours.schema["site"].dataType.simpleString(), to_arrow_type(colours.schema["site"].dataType)
    crowded = materialize(colours.groupBy("site").agg(F.count("*").alias("n")).filter(F.col("n") > giant).select("site"), "colour-sites")
    some = not crowded.isEmpty()
    usual = colours.join(crowded, colours["site"].eqNullSafe(crowded["site"]), "left_anti") if some else colours
    ranked = usual.repartition("site").sortWithinPartitions("site", F.desc("uses"), "value")
    told = pa.schema([("site", kind), ("value", pa.string()), ("uses", pa.int64()), ("merged", pa.int64())])
    out = ranked.mapInArrow(lambda batches: _batches(_folded(_rows(batches, "site", "value", "uses", *CHANNELS), threshold), told), f"site {site}, value string, uses bigint, merged bigint")
    return out.unionByName(_merge_crowded(colours.join(crowded, colours["site"].eqNullSafe(crowded["site"]), "left_semi"), threshold, giant)) if some else out


def _merge_crowded(colours: DataFrame, threshold: int, giant: int) -> DataFrame:
    """The merge of sites with many colours ``(site, value, uses, r, g, b, al)``, component by component."""
    channels = CHANNELS
    colours = materialize(colours, "colours-crowded")
    site, kind = colours.schema["site"].dataType.simpleString(), to_arrow_type(colours.schema["site"].dataType)
    told = pa.schema([("site", kind), *[(ch, pa.int32()) for ch in channels], ("part", pa.int32())])
    cells = colours.select("site", *[F.floor(F.col(ch) / threshold).cast("int").alias(ch) for ch in channels]).distinct().repartition("site").sortWithinPartitions("site")
    cells = cells.mapInArrow(lambda batches: _batches(_cell_components(_rows(batches, "site", *channels)), told), f"site {site}, r int, g int, b int, al int, part int")
    spots = cells.select(F.col("site").alias("_site"), "part", *[F.col(ch).alias(f"_{ch}") for ch in ("r", "g", "b", "al")])
    on = colours["site"].eqNullSafe(spots["_site"])
    for ch in ("r", "g", "b", "al"):
        on = on & (F.floor(colours[ch] / threshold) == spots[f"_{ch}"])
    placed = materialize(colours.join(spots, on).select("site", "part", "value", "uses", "r", "g", "b", "al"), "colour-parts")
    large = materialize(placed.groupBy("site", "part").agg(F.count("*").alias("n")).filter(F.col("n") > giant).select("site", "part"), "colour-giants")
    ranked = placed.join(large, ["site", "part"], "left_anti").repartition("site", "part").sortWithinPartitions("site", "part", F.desc("uses"), "value")
    joined = pa.schema([("site", kind), ("value", pa.string()), ("into", pa.string())])
    into = ranked.select("site", "part", "value", *channels).mapInArrow(
        lambda batches: _batches(_greedy(_rows(batches, "site", "part", "value", *channels), threshold), joined), f"site {site}, value string, into string")
    if not large.isEmpty():
        into = into.unionByName(_settled(placed.join(large, ["site", "part"], "left_semi"), threshold))
    return (
        colours.join(into, ["site", "value"]).groupBy("site", F.coalesce("into", "value").alias("value"))
        .agg(F.sum("uses").alias("uses"), F.count_if(F.col("into").isNotNull()).alias("merged"))
    )


def _settled(colours: DataFrame, threshold: int) -> DataFrame:
    """``site, value, into`` by rounds over the near pairs, which come from a grid join."""
    cell = lambda ch: F.floor(F.col(ch) / threshold).cast("int")
    spread, rgb = F.array(*[F.lit(i) for i in (-1, 0, 1)]), ("r", "g", "b")
    packed = F.struct("r", "g", "b", "al")
    own = colours.select("site", F.col("value").alias("v1"), F.col("uses").alias("u1"), packed.alias("c1"), *[cell(ch).alias(f"_{ch}") for ch in rgb])
    seen = colours.select("site", F.col("value").alias("v2"), F.col("uses").alias("u2"), packed.alias("c2"), *[cell(ch).alias(f"_{ch}") for ch in rgb])
    for ch in rgb:
        seen = seen.withColumn("_d", F.explode(spread)).withColumn(f"_{ch}", F.col(f"_{ch}") + F.col("_d")).drop("_d")
    near = own.join(seen, ["site", *[f"_{ch}" for ch in rgb]]).filter(
        ((F.col("u2") > F.col("u1")) | ((F.col("u2") == F.col("u1")) & (F.col("v2") < F.col("v1")))) & (C.distance(F.col("c1"), F.col("c2")) <= threshold)
    )
    near = materialize(near.select("site", F.col("v1").alias("value"), F.col("v2").alias("before"), F.col("u2").alias("before_uses")), "near-colours")
    state = materialize(colours.join(near.select("site", "value").distinct().withColumn("_has", F.lit(True)), ["site", "value"], "left").select("site", "value", F.when(F.col("_has").isNull(), "kept").otherwise("open").alias("state")), "colour-state")
    while not state.filter("state = 'open'").isEmpty():
        facts = near.join(state.select("site", F.col("value").alias("before"), F.col("state").alias("s")), ["site", "before"]).groupBy("site", "value").agg(
            F.bool_or(F.col("s") == "kept").alias("_k"), F.bool_or(F.col("s") == "open").alias("_o")
        )
        nxt = F.when(F.col("state") != "open", F.col("state")).when(F.col("_k"), "absorbed").when(~F.col("_o"), "kept").otherwise("open")
        state = materialize(state.join(facts, ["site", "value"], "left").select("site", "value", nxt.alias("state")), "colour-state")
    kept = state.filter("state = 'kept'").select("site", F.col("value").alias("before"))
    into = near.join(kept, ["site", "before"]).join(state.filter("state = 'absorbed'").select("site", "value"), ["site", "value"]).groupBy("site", "value").agg(
        F.min_by("before", F.struct(-F.col("before_uses"), F.col("before"))).alias("into")
    )
    return colours.select("site", "value").join(into, ["site", "value"], "left")


def _role(kind: str, c) -> Column:
    lum, sat = C.luminance(c), C.saturation(c)
    alpha = c["al"] < 255
    if kind == "text":
        return (
            F.when(alpha, F.when(sat >= 0.30, "accent-soft").otherwise("muted")).when(lum <= 0.28, "default")
            .when(lum >= 0.85, "inverse").when(sat >= 0.30, "accent").otherwise("muted")
        )
    return (
        F.when(alpha, F.when(sat >= 0.35, "accent-soft").when(lum >= 0.75, "subtle").otherwise("wash")).when(lum >= 0.93, "surface")
        .when(lum <= 0.18, "ink").when(sat >= 0.35, "accent").when(lum >= 0.75, "subtle").otherwise("neutral")
    )


def color_roles(merged: DataFrame, k: int, prefix: str = "--color", kind: str = "surface") -> DataFrame:
    """Name the top ``k`` colours per site by luminance and saturation; repeats get ``-2``, ``-3``; opaque ones first."""
    top = top_k(merged, ["site"], [F.desc("uses"), "value"], k)
    parsed = top.withColumn("c", _once(C.parse(F.col("value"))))
    named = parsed.withColumn("role", _role(kind, F.col("c"))).withColumn("_alpha", (F.col("c.al") < 255).cast("int"))
    n = F.row_number().over(W.partitionBy("site", "role").orderBy("_alpha", "rank"))
    return named.withColumn("_n", n).select(
        "site", F.lit("color").alias("type"),
        F.concat(F.lit(prefix + "-"), "role", F.when(F.col("_n") > 1, F.concat(F.lit("-"), F.col("_n").cast("string"))).otherwise("")).alias("name"),
        "value", "uses", F.lit("mined").alias("source"),
    )


# Semantic roles, their target colours and where they may be found.
ROLE_TARGETS = [
    (1, "--color-surface-alt", "fill", ["#FBFBFB"]), (2, "--color-surface-muted", "fill", ["#F2F2F2"]),
    (3, "--color-danger", "any", ["#E11D2E", "#EF4444", "#DC2626"]), (4, "--color-warning", "any", ["#F59E0B", "#FBBF24", "#D97706"]),
    (5, "--color-success", "any", ["#22C55E", "#16A34A", "#10B981"]), (6, "--color-info", "any", ["#3B82F6", "#2563EB", "#0EA5E9"]),
    (7, "--color-muted", "any", ["#6B7280", "#737373", "#9CA3AF"]), (8, "--color-text-subtle", "text", ["#999999"]),
    (9, "--color-text-secondary", "text", ["#666666"]), (10, "--color-overlay", "fill", ["#1D2B19B3", "#1D2B1999", "#1D2B19"]),
    (11, "ink-a", "any", ["#333333"]), (12, "ink-b", "any", ["#111111"]),
]


def semantic_roles(pool: DataFrame, brand: DataFrame) -> DataFrame:
    """``pool(site, kind fill|text, value, uses)`` colours no brand token claims, nearest to each fixed target."""
    spark = pool.sparkSession
    targets = spark.createDataFrame([(o, n, p, t) for o, n, p, ts in ROLE_TARGETS for t in ts], "role_ord int, role string, pool string, target string").withColumn("t", _once(C.parse(F.col("target"))))
    # the target table is a constant of under forty rows; few colours are near a target, so the others never meet the brand
    # colours repeat from site to site, so each is read and measured once
    values = pool.select("kind", "value").distinct().withColumn("c", _once(C.parse(F.col("value")))).filter("c IS NOT NULL")
    close = values.join(F.broadcast(targets), (F.col("pool") == "any") | (F.col("pool") == F.col("kind"))).withColumn("d", C.rgb_distance(F.col("c"), F.col("t")))
    close = materialize(close.filter(F.col("d") <= NEAR).select("kind", "value", "c", "role", "d"), "target-colours")
    hits = pool.select("site", "kind", "value", "uses").join(close, ["kind", "value"])
    claimed = brand.groupBy("site").agg(F.collect_list(C.parse(F.col("value"))).alias("brand"), F.max(F.when(F.col("name") == "--color-surface", F.col("value"))).alias("surface"))
    hits = hits.select("site", "kind", "value", "uses", "c", "role", "d").join(claimed, "site", "left")
    opaque = F.col("c.al") == 255
    near = lambda t: F.when(opaque, (t["al"] == 255) & (C.rgb_distance(t, F.col("c")) <= CLAIMED)).otherwise(C.distance(t, F.col("c")) <= CLAIMED)
    hits = hits.filter(~F.coalesce(F.exists("brand", near), F.lit(False)))
    score = F.col("d") - F.when((F.col("role") == "--color-overlay") & ~opaque, 0.5).otherwise(0.0)
    best = hits.groupBy("site", "role").agg(
        F.min_by(F.struct("value", "uses", "c", "surface"), F.struct(score, -F.col("uses"), F.col("value"))).alias("h")
    ).select("site", "role", "h.*")
    best = materialize(best, "semantic-best")  # read twice; a few rows a site
    near_surface = (F.col("role") == "--color-surface-alt") & F.coalesce(C.rgb_distance(F.col("c"), C.parse(F.col("surface"))) <= CLAIMED, F.lit(False))
    plain = best.filter(~F.col("role").startswith("ink-") & ~near_surface)
    ink = best.filter(F.col("role").startswith("ink-")).withColumn("lum", C.luminance(F.col("c")))
    ink = dedupe_first(ink, ["site", "value"], ["role"]).withColumn("_n", F.row_number().over(W.partitionBy("site").orderBy(F.desc("lum"))))
    ink = ink.withColumn("role", F.when(F.col("_n") == 1, "--color-ink-soft").otherwise("--color-ink-strong"))
    return plain.select("site", "role", "value", "uses").unionByName(ink.select("site", "role", "value", "uses")).select(
        "site", F.lit("color").alias("type"), F.col("role").alias("name"), "value", "uses", F.lit("semantic").alias("source")
    )


# Font words.
MONO = r"(?i)mono|code|courier|consolas|menlo"
SERIF = r"(?i)\b(serif|times|georgia|garamond|playfair|merriweather|lora)\b"
GENERIC = "(?i)^(system sans-serif|system serif|system-ui|ui-sans-serif|ui-serif|sans-serif|serif|monospace|cursive)$"
WEIGHT_NAMES = {100: "thin", 200: "extralight", 300: "light", 400: "regular", 500: "medium", 600: "semibold", 700: "bold", 800: "extrabold", 900: "black"}


def base_family(value: Column) -> Column:
    first = F.regexp_replace(F.split(F.trim(value), ",")[0], "[\"']", "")
    bare = F.trim(F.regexp_replace(first, "(?i)(-(thin|extralight|light|regular|book|medium|semibold|bold|extrabold|black|italic))+$", ""))
    return F.when(F.trim(value).rlike(r"(?i)^var\(--font-[^)]+\)$"), "").otherwise(bare)


def family_role(value: Column) -> Column:
    return F.when(value.rlike(MONO), "mono").when(base_family(value).rlike(SERIF), "serif").otherwise("sans")


def family_tokens(counts: DataFrame) -> DataFrame:
    """Families by role; generic stacks go when the role has a concrete face; top four per site."""
    rows = counts.withColumn("base", base_family(F.col("value"))).filter("base <> ''").withColumn("role", family_role(F.col("value")))
    fams = rows.groupBy("site", "role", F.lower("base").alias("key")).agg(
        F.sum("uses").alias("uses"), F.max_by(F.struct("value", "base"), F.struct("uses", "value")).alias("v")
    ).withColumn("generic", F.col("key").rlike(GENERIC))
    concrete = fams.groupBy("site", "role").agg(F.bool_or(~F.col("generic")).alias("_concrete"))
    kept = fams.join(concrete, ["site", "role"]).filter(~F.col("generic") | ~F.col("_concrete"))
    top = top_k(kept, ["site"], [F.desc("uses"), "role", "key"], 4)
    many = F.count("*").over(W.partitionBy("site", "role")) > 1
    return top.withColumn("_many", many).select(
        "site", F.lit("fontFamily").alias("type"),
        F.concat(F.lit("--font-"), "role", F.when(F.col("_many"), F.concat(F.lit("-"), F.regexp_replace("key", r"\s+", "-"))).otherwise("")).alias("name"),
        F.col("v.value").alias("value"), "uses", F.lit("mined").alias("source"),
    )


def weight_style_tokens(counts: DataFrame) -> DataFrame:
    """``counts(site, kind weight|style, value, uses)``: the five most used weights by name, and named styles."""
    names = F.create_map(*[x for k, v in WEIGHT_NAMES.items() for x in (F.lit(str(k)), F.lit(v))])
    top = top_k(counts.filter("kind = 'weight'"), ["site"], [F.desc("uses"), "value"], 5).filter(F.col("value").rlike("^[0-9]+$"))
    weights = top.select("site", F.lit("fontWeight").alias("type"), F.concat(F.lit("--font-weight-"), F.coalesce(names[F.col("value")], F.col("value"))).alias("name"), "value", "uses", F.lit("mined").alias("source"))
    styles = counts.filter("kind = 'style'").withColumn("value", F.lower("value")).filter(F.col("value").isin("italic", "oblique", "normal"))
    styles = styles.groupBy("site", "value").agg(F.sum("uses").alias("uses"))
    return weights.unionByName(styles.select("site", F.lit("fontStyle").alias("type"), F.concat(F.lit("--font-style-"), "value").alias("name"), "value", "uses", F.lit("mined").alias("source")))


def leading_tracking_counts(nodes: DataFrame) -> DataFrame:
    """``nodes(site, lead, track, size)`` → ``counts(site, kind leading|tracking, value %|rem, uses)``.

    Written values repeat from site to site, so each is read once with its font size, and nodes are only looked up.
    """
    pairs = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("written")) for kind, c in (("leading", "lead"), ("tracking", "track"))])
    rows = nodes.select("site", "size", F.inline(pairs)).filter("written IS NOT NULL")
    said = F.when(F.col("kind") == "leading", line_height_percent(F.col("written"), F.col("size"))).otherwise(letter_spacing_rem(F.col("written"), F.col("size")))
    words = materialize(rows.select("kind", "written", "size").distinct().select(F.col("kind").alias("_kind"), F.col("written").alias("_written"), F.col("size").alias("_size"), said.alias("value")), "written-lengths")
    same = (F.col("kind") == F.col("_kind")) & (F.col("written") == F.col("_written")) & F.col("size").eqNullSafe(F.col("_size"))
    return rows.join(words.filter("value IS NOT NULL"), same).groupBy("site", "kind", "value").agg(F.count("*").alias("uses"))


def leading_tracking_tokens(counts: DataFrame) -> DataFrame:
    """``counts(site, kind leading|tracking, value %|rem, uses)``: the 16 most used of each, as tokens."""
    top = top_k(counts.filter(F.col("kind").isin("leading", "tracking")), ["site", "kind"], [F.desc("uses"), "value"], 16)
    leading = F.col("kind") == "leading"
    number = F.regexp_extract("value", r"^(-?[0-9.]+)", 1)
    slug = F.regexp_replace(F.regexp_replace(number, "^-", "neg-"), r"\.", "_")
    return top.select(
        "site", F.when(leading, "lineHeight").otherwise("letterSpacing").alias("type"),
        F.when(leading, F.concat(F.lit("--line-height-"), number)).otherwise(F.concat(F.lit("--letter-spacing-"), slug)).alias("name"),
        "value", "uses", F.lit("mined").alias("source"),
    )


# Default type scale and spacing scale in px.
FONT_SCALE = {"xs": 12, "sm": 14, "base": 16, "lg": 18, "xl": 20, "2xl": 24, "3xl": 30, "4xl": 36, "5xl": 48, "6xl": 60, "7xl": 72, "8xl": 96, "9xl": 128, "10xl": 160, "11xl": 192, "12xl": 224}
SPACING_SCALE = {"px": 1, "0.5": 2, "1": 4, "1.5": 6, "2": 8, "2.5": 10, "3": 12, "3.5": 14, "4": 16, "5": 20, "6": 24, "7": 28, "8": 32, "9": 36, "10": 40, "11": 44, "12": 48, "14": 56, "16": 64, "20": 80, "24": 96, "28": 112, "32": 128}


def font_size_tokens(counts: DataFrame, lo: int = 10, hi: int = 240) -> DataFrame:
    """The default scale for every site, plus painted sizes off the scale; the default wins per px."""
    value = F.col("value")
    px = F.when(value.rlike("(?i)%$|[^r]em$"), F.lit(None)).otherwise(F.round(_px(value))).cast("bigint")
    extras = counts.withColumn("px", px).filter((F.col("px") >= lo) & (F.col("px") <= hi) & ~F.col("px").isin(*FONT_SCALE.values()))
    extras = extras.groupBy("site", "px").agg(F.max_by("uses", F.struct("uses", "value")).alias("uses"))
    defaults = counts.select("site").distinct().select("site", F.explode(F.create_map(*[x for k, v in FONT_SCALE.items() for x in (F.lit(k), F.lit(v).cast("bigint"))])).alias("step", "px"))
    row = lambda df, step, uses, source: df.select(
        "site", F.lit("fontSize").alias("type"), F.concat(F.lit("--text-"), step).alias("name"), F.concat(F.col("px").cast("string"), F.lit("px")).alias("value"), uses.alias("uses"), F.lit(source).alias("source")
    )
    return row(defaults, F.col("step"), F.lit(0).cast("bigint"), "default").unionByName(row(extras, F.col("px").cast("string"), F.col("uses"), "mined"))


def snap_to_scale(rows: DataFrame, scale: dict[str, float], px: str = "px", reject_over: float | None = None) -> DataFrame:
    """Nearest step of a fixed scale (a literal array, no join); ties go to the larger step."""
    steps = F.array(*[F.struct(F.lit(k).alias("step"), F.lit(float(v)).alias("px")) for k, v in scale.items()])
    best = F.array_min(F.transform(steps, lambda s: F.struct(F.abs(s["px"] - F.col(px)).alias("d"), (-s["px"]).alias("n"), s["step"].alias("step"))))
    out = rows.withColumn("_b", best).withColumn("step", F.col("_b.step")).withColumn("distance", F.col("_b.d")).drop("_b")
    return out if reject_over is None else out.withColumn("step", F.when(F.col("distance") <= reject_over, F.col("step")))


def proposed_rows(parts: list[DataFrame], sites: DataFrame) -> DataFrame:
    """All token rows of ``parts`` and the default spacing of every site."""
    spacing = sites.select("site", F.explode(F.create_map(*[x for k, v in SPACING_SCALE.items() for x in (F.lit(k), F.lit(f"{v}px"))])).alias("step", "value")).select(
        "site", F.lit("spacing").alias("type"), F.concat(F.lit("--spacing-"), F.regexp_replace("step", r"\.", "_")).alias("name"), "value", F.lit(0).cast("bigint").alias("uses"), F.lit("default").alias("source")
    )
    rows = spacing
    for p in parts:
        rows = rows.unionByName(p)
    return rows


def token_contract(rows: DataFrame, sites: DataFrame, required: list[str]) -> DataFrame:
    """``site, name``: required names a site lacks. Only rows of these names are shuffled."""
    wanted = sites.select("site", F.explode(F.array(*[F.lit(r) for r in required])).alias("name"))
    return wanted.join(rows.filter(F.col("name").isin(*required)).select("site", "name").distinct(), ["site", "name"], "left_anti")


def propose_tokens(parts: list[DataFrame], sites: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """All token rows with default spacing, and the contract check: required names a site lacks."""
    rows = proposed_rows(parts, sites)
    return rows, token_contract(rows, sites, required)


def _doubled(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Follow ``steps(site, name, to, n)`` by pointer doubling until no name newly reaches an end (a ``to`` that leads nowhere).

    Gives the names that reach one, with the end and the number of steps, and the names that go round for ever.
    """
    ended = None
    while True:
        nxt = steps.select("site", F.col("name").alias("to"), F.col("to").alias("_to"), F.col("n").alias("_n"))
        met = materialize(steps.join(nxt, ["site", "to"], "left").select("site", "name", F.coalesce("_to", "to").alias("to"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), F.col("_to").isNull().alias("_end")), "vars-step")
        new = met.filter("_end").drop("_end")
        if ended is not None:
            nxt_end = ended.select("site", F.col("name").alias("to"), F.col("to").alias("_to"), F.col("n").alias("_n"))
            more = met.filter("_end").join(nxt_end, ["site", "to"], "left")
            new = more.select("site", "name", F.coalesce("_to", "to").alias("to"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"))
        new = materialize(new, "vars-ended")
        if new.isEmpty():
            return (ended if ended is not None else new), met.filter("NOT _end").drop("_end")
        ended = new if ended is None else ended.unionByName(new)
        steps = met.filter("NOT _end").drop("_end")
        if steps.isEmpty():
            return ended, steps


def resolve_vars(tokens: DataFrame) -> DataFrame:
    """Follow ``var(--x)`` chains within a site; a cycle or an unknown name leaves the reference as it stands.

    Pointer doubling: every round a name learns what its target knows, so rounds grow with the logarithm of the longest
    chain. Names that never end go round: after as many doublings as their number has bits each points into its cycle,
    which marks the cycles; their smallest name and length come from one more doubling. A name on a cycle goes round it
    once; one that leads into a cycle stops before it would enter it again.
    """
    ref = F.regexp_extract("value", r"(?i)^\s*var\((--[^)]+)\)\s*$", 1)
    base = materialize(dedupe_first(tokens.select("site", "name", "value"), ["site", "name"], ["value"]).withColumn("_ref", ref), "vars")
    known = base.select("site", F.col("name").alias("to"))
    steps = materialize(base.filter("_ref <> ''").select("site", "name", F.col("_ref").alias("to"), F.lit(1).cast("bigint").alias("n")).join(known, ["site", "to"], "left_semi"), "vars-steps")
    still = base.join(steps.select("site", "name"), ["site", "name"], "left_anti").select("site", "name", F.trim("value").alias("value"), F.lit(0).cast("bigint").alias("hops"))
    if steps.isEmpty():
        return still
    said = base.select("site", F.col("name").alias("to"), F.trim("value").alias("value"))
    ended, round_ = _doubled(steps)
    out = still.unionByName(ended.join(said, ["site", "to"]).select("site", "name", "value", F.col("n").alias("hops")))
    looping = materialize(steps.join(round_.select("site", "name"), ["site", "name"], "left_semi"), "vars-looping")
    total = looping.count()
    if not total:
        return out
    # who lies on a cycle, and each cycle's smallest name
    far = looping.select("site", "name", "to", F.least("name", "to").alias("low"))
    for _ in range(max(1, total.bit_length())):
        nxt = far.select("site", F.col("name").alias("to"), F.col("to").alias("_to"), F.col("low").alias("_low"))
        far = materialize(far.join(nxt, ["site", "to"]).select("site", "name", F.col("_to").alias("to"), F.least("low", "_low").alias("low")), "vars-far")
    on = materialize(far.select("site", F.col("to").alias("name")).distinct(), "vars-cycles")
    cycles = far.join(on, ["site", "name"], "left_semi").select("site", "name", "low")
    length = cycles.groupBy("site", "low").agg(F.count("*").alias("around"))
    cycles = materialize(cycles.join(length, ["site", "low"]).select("site", "name", "around"), "vars-cycles")
    own = base.select("site", "name", F.trim("value").alias("value"))
    out = out.unionByName(cycles.join(own, ["site", "name"]).select("site", "name", "value", F.col("around").alias("hops")))
    tails = looping.join(on, ["site", "name"], "left_anti")
    if tails.isEmpty():
        return out
    led, _ = _doubled(tails)
    before = looping.join(on, ["site", "name"], "left_semi").join(own, ["site", "name"]).select("site", "to", F.col("value"))  # what leads on to an entry, inside its cycle
    entry = led.join(cycles.withColumnRenamed("name", "to"), ["site", "to"]).join(before, ["site", "to"])
    return out.unionByName(entry.select("site", "name", "value", (F.col("n") + F.col("around") - 1).alias("hops")))


def normal_value(type_: Column, value: Column) -> Column:
    """Comparable form: colours as hex with alpha, lengths as px numbers, families by base name."""
    colour = C.let(C.parse(value), lambda c: F.when(c.isNotNull(), F.format_string("#%02X%02X%02X%02X", c["r"], c["g"], c["b"], c["al"])))
    return F.when(type_ == "color", colour).when(type_ == "fontFamily", F.lower(base_family(value))).when(
        type_.isin("fontSize", "spacing", "radius"), _px(value).cast("string")
    ).otherwise(F.lower(F.trim(value)))


SITE_TOKENS = 2_000  # values with a token and types of a site up to which they are held as one map


def _bound(rows: DataFrame, tokens: DataFrame, values: DataFrame, props: list[tuple[str, str, str]] | None) -> DataFrame:
    """``bind_tokens`` for ``values(type, value)``, the values that occur; with ``props`` the rows are nodes, laid out after they met their site."""
    bound, clear = F.col("value").rlike(r"(?i)^\s*var\("), (F.col("type") == "color") & F.col("value").rlike(TRANSPARENT)
    why = F.when(bound, "already bound").when(clear, "transparent").when(F.col("key").isNull(), "unreadable value")
    # a written value repeats from site to site: each is read once
    words = materialize(values.distinct().withColumn("key", _once(normal_value(F.col("type"), F.col("value")))).withColumn("why", why), "written-values")
    tokens = tokens.select("site", "type", "name", "value", "uses")
    keyed = tokens.withColumn("key", _once(normal_value(F.col("type"), F.col("value"))))
    t = keyed.groupBy("site", "type", "key").agg(F.min_by("name", F.struct(-F.col("uses"), F.col("name"))).alias("token"))
    plain = words.filter("why IS NULL").select("type", "key", "value")
    # a token whose value no row has stays without a value: it tells that the site has tokens of its type
    known = materialize(t.join(plain, ["type", "key"], "left").select("site", "type", "value", "token"), "site-values")
    many = materialize(known.groupBy("site").agg(F.count("*").alias("_n")).filter(F.col("_n") > SITE_TOKENS).select("site"), "token-sites")
    some = not many.isEmpty()

    # one small map a site, by type and written value, so that nodes are shuffled once as they are
    own = known.join(many, "site", "left_anti") if some else known
    pairs = F.collect_list(F.when(F.col("value").isNotNull(), F.struct("value", "token")))
    by_type = own.filter("type IS NOT NULL").repartition("site").groupBy("site", "type").agg(F.map_from_entries(pairs).alias("_of"))
    maps = by_type.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("type", "_of"))).alias("_map"))
    laid = lambda df, *more: df.select("site", "node_id", *more, F.inline(F.array(*[F.struct(F.lit(p).alias("prop"), F.lit(k).alias("type"), F.col(c).alias("value")) for p, k, c in props]))) if props else df.select("site", "node_id", *more, "prop", "type", "value")
    usual = rows.join(many, "site", "left_anti") if some else rows
    of = F.col("_map")[F.col("type")]
    found = laid(usual.join(maps, "site", "left"), "_map").select("site", "node_id", "prop", "type", "value", of[F.col("value")].alias("token"), of.isNotNull().alias("_typed"))
    if some:
        crowded = laid(rows.join(many, "site", "left_semi"))
        named = known.join(many, "site", "left_semi")
        crowded = crowded.join(named.filter("value IS NOT NULL"), ["site", "type", "value"], "left").join(named.select("site", "type").distinct().withColumn("_typed", F.lit(True)), ["site", "type"], "left")
        found = found.unionByName(crowded.select("site", "node_id", "prop", "type", "value", "token", F.coalesce("_typed", F.lit(False)).alias("_typed")))
    odd = words.filter("why IS NOT NULL").select(F.col("type").alias("_t"), F.col("value").alias("_v"), "why")
    told = found.join(odd, F.col("type").eqNullSafe(F.col("_t")) & F.col("value").eqNullSafe(F.col("_v")), "left")
    status = F.when(F.col("why").isin("already bound", "transparent"), "skip").when(F.col("token").isNotNull(), "change").otherwise("leftover")
    reason = F.when(F.col("why").isNotNull(), F.col("why")).when(F.col("token").isNotNull(), "").when(~F.col("_typed"), "no token of this type").otherwise("no token with this value")
    return told.select("site", "node_id", "prop", "type", "value", "token", status.alias("status"), reason.alias("reason"))


def bind_tokens(styles: DataFrame, tokens: DataFrame) -> DataFrame:
    """``styles(site, node_id, prop, type, value)`` against tokens by exact normal value.

    ``change`` rows name the token (most used, then first name); ``leftover`` rows say why none fits;
    ``skip`` rows are already bound or transparent.
    """
    return _bound(styles, tokens, styles.select("type", "value"), None)


def bind_nodes(nodes: DataFrame, tokens: DataFrame, props: list[tuple[str, str, str]], values: DataFrame) -> DataFrame:
    """``bind_tokens`` of nodes with a column for each of ``props(prop, type, column)``; ``values(type, value)`` are all values they have.

    Nodes meet the tokens of their site before they are laid out as one row for each property.
    """
    return _bound(nodes.select("site", "node_id", *dict.fromkeys(c for _, _, c in props)), tokens, values, props)


def bind_qa(nodes: DataFrame, accounts: DataFrame, allowed: DataFrame) -> DataFrame:
    """Nodes without an account, and raw values that have a token but are neither bound nor listed as allowed."""
    lost = nodes.select("site", "node_id").distinct().join(accounts.select("site", "node_id").distinct(), ["site", "node_id"], "left_anti")
    raw = accounts.filter("token IS NOT NULL AND status <> 'bound'").join(allowed.select("site", "node_id", "prop"), ["site", "node_id", "prop"], "left_anti")
    return lost.select("site", "node_id", F.lit("").alias("prop"), F.lit("unaccounted").alias("defect")).unionByName(
        raw.select("site", "node_id", "prop", F.lit("raw value has a token").alias("defect"))
    )


def inherited_fills(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes that hold: not on nodes without own paint, and not repeating the parent's fill.

    ``nodes(site, node_id, parent_id, fill)``, ``changes(site, node_id, token)``.
    """
    child = nodes.filter("fill IS NOT NULL").select("site", "node_id", "parent_id", "fill")
    parent = nodes.select("site", F.col("node_id").alias("parent_id"), F.col("fill").alias("parent_fill"))
    same = child.join(parent, ["site", "parent_id"]).filter("fill = parent_fill").select("site", "node_id")
    return changes.join(child.select("site", "node_id"), ["site", "node_id"], "left_semi").join(same, ["site", "node_id"], "left_anti")


def token_upsert_plan(desired: DataFrame, existing: DataFrame, replace: bool = False) -> DataFrame:
    """``create`` / ``update`` / ``delete`` rows by name; existing duplicates never fan out an update."""
    want = dedupe_first(desired.select("site", "name", "value"), ["site", "name"], ["value"])
    act = lambda df, a: df.select("site", F.lit(a).alias("action"), "name", "value")
    if replace:
        return act(existing, "delete").unionByName(act(want, "create"))
    have = existing.select("site", "name")
    return act(want.join(have, ["site", "name"], "left_semi"), "update").unionByName(act(want.join(have, ["site", "name"], "left_anti"), "create"))


def paint_witness(captures: DataFrame, nodes: DataFrame) -> DataFrame:
    """Saturated captured fills, one colour per node or a conflict, laid over painted nodes only."""
    c = F.col("c")
    strong = captures.withColumn("c", _once(C.parse(F.col("value")))).filter(c.isNotNull() & (C.saturation(c) >= 0.35))
    seen = strong.groupBy("site", "node_id").agg(F.min(F.upper("value")).alias("_lo"), F.max(F.upper("value")).alias("_hi"))
    joined = nodes.filter("fill IS NOT NULL").join(seen, ["site", "node_id"])
    return joined.select(
        "site", "node_id", "fill", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("witness"),
        F.when(F.col("_lo") != F.col("_hi"), "conflict").when(F.col("_lo") == F.upper("fill"), "same").otherwise("overlay").alias("status"),
    )


def unbound_fonts(styles: DataFrame, tokens: DataFrame) -> DataFrame:
    """Text nodes on a generic or stacked family while the site has font tokens, with the token of the same role."""
    raw = styles.filter("prop = 'fontFamily'").filter(~F.col("value").rlike(r"(?i)^\s*var\("))
    loose = raw.filter(F.col("value").contains(",") | base_family(F.col("value")).rlike(GENERIC)).withColumn("role", family_role(F.col("value")))
    fonts = tokens.filter("type = 'fontFamily'").withColumn("role", family_role(F.col("value")))
    per_role = fonts.groupBy("site", "role").agg(F.min_by("name", F.struct(-F.col("uses"), F.col("name"))).alias("token"))
    any_token = fonts.groupBy("site").agg(F.min_by("name", F.struct(-F.col("uses"), F.col("name"))).alias("_any"))
    return loose.join(any_token, "site").join(per_role, ["site", "role"], "left").select("site", "node_id", "value", "role", F.coalesce("token", "_any").alias("token"))


# ---- stylesheets ------------------------------------------------------------------------------

# Token types by the start of the name, first hit wins; properties whose values form the spacing scale.
NAME_TYPES = [
    ("--color", "color"), ("--text-", "fontSize"), ("--spacing", "spacing"), ("--radius", "radius"), ("--font-weight", "fontWeight"),
    ("--font-style", "fontStyle"), ("--font-", "fontFamily"), ("--shadow", "shadow"),
]
SPACING_PROPS = ["padding", "padding-top", "padding-bottom", "padding-left", "padding-right", "margin", "gap", "row-gap", "column-gap"]


def css_custom_props(css: DataFrame) -> DataFrame:
    """``css(site, pos, css)`` → ``--name: value`` pairs; the start of the name gives the type (null for other names)."""
    decl = css.select("site", "pos", F.posexplode(M.all_matches(F.regexp_replace("css", r"(?s)/\*.*?\*/", ""), r"--[A-Za-z0-9_-]+\s*:\s*[^;{}]+")).alias("_i", "d"))
    name, value = F.regexp_extract("d", r"^(--[A-Za-z0-9_-]+)", 1), F.trim(F.regexp_replace("d", r"^--[A-Za-z0-9_-]+\s*:", ""))
    kind = F.lit(None).cast("string")
    for start, said in reversed(NAME_TYPES):
        kind = F.when(name.startswith(start), said).otherwise(kind)
    return decl.select("site", "pos", F.col("_i").cast("bigint").alias("i"), name.alias("name"), value.alias("value"), kind.alias("type"))


def mine_css_tokens(css: DataFrame) -> DataFrame:
    """Counts per site of token colours, families, spacings, radii, shadows from stylesheet declarations.

    Token colours are hex or ``rgb(r, g, b)`` values of ``--token-*`` names, the latter shown as hex. Spacings are single
    lengths; a bare number is px. Radii leave out ``0`` and ``inherit``.
    """
    d = spread(css).select("site", F.explode(M.all_matches(F.col("css"), r"[A-Za-z0-9_-]+\s*:\s*[^;{}]+")).alias("d"))
    name = F.lower(F.regexp_extract("d", r"^([A-Za-z0-9_-]+)\s*:", 1))
    d = d.select("site", "d", _once(name).alias("prop"))
    prop, value = F.col("prop"), F.col("value")
    d = d.filter(prop.startswith("--token-") | prop.isin("font-family", "border-radius", "box-shadow", *SPACING_PROPS))
    d = d.select("site", "prop", _once(F.trim(F.regexp_replace("d", r"^[A-Za-z0-9_-]+\s*:", ""))).alias("value"))
    rgb = r"(?i)^rgb\(\s*(\d+),\s*(\d+),\s*(\d+)\s*\)$"
    as_hex = F.format_string("#%02x%02x%02x", *[F.regexp_extract(value, rgb, i).try_cast("int") for i in (1, 2, 3)])
    colour = F.when(value.startswith("#"), F.when(value.rlike("(?i)^#[0-9a-f]{3,8}$"), value)).when(value.rlike(r"(?i)^rgb\([^)]+\)$"), F.when(value.rlike(rgb), as_hex).otherwise(value))
    length = F.when(value.rlike(r"^[\d.]+$"), F.concat(value, F.lit("px"))).when(value.rlike(r"^[\d.]+(px|rem|em|%)$"), value)
    said = lambda kind, shown: F.struct(F.lit(kind).alias("kind"), shown.alias("value"))
    told = (
        F.when(prop.startswith("--token-"), said("color", colour)).when(prop == "font-family", said("family", base_family(value))).when(prop.isin(*SPACING_PROPS), said("spacing", length))
        .when(prop == "border-radius", said("radius", F.when(~value.isin("0", "inherit"), value))).when(prop == "box-shadow", said("shadow", value))
    )
    return d.select("site", _once(told).alias("t")).select("site", "t.kind", "t.value").filter("value <> ''").groupBy("site", "kind", "value").agg(F.count("*").alias("uses"))


def folder_tokens(css: DataFrame, colours: int = 48, families: int = 16) -> DataFrame:
    """First distinct lower-cased colours and families per site, in order of appearance."""
    found = lambda kind, pattern, g: css.select("site", "pos", F.posexplode(M.all_matches(F.col("css"), pattern, g)).alias("i", "value")).select("site", "pos", "i", F.lit(kind).alias("kind"), F.lower(F.trim("value")).alias("value"))
    rows = found("color", r"#[0-9a-fA-F]{3,8}\b", 0).unionByName(found("family", r"(?i)font-family\s*:\s*([^;}{]+)", 1))
    first = rows.groupBy("site", "kind", "value").agg(F.min(F.struct("pos", "i")).alias("at"))
    ranked = top_k(first, ["site", "kind"], ["at"], max(colours, families))
    return ranked.filter(((F.col("kind") == "color") & (F.col("rank") <= colours)) | (F.col("rank") <= families)).select("site", "kind", "value", "rank")


def merge_tokens(source: DataFrame, computed: DataFrame) -> DataFrame:
    """``(site, name, value)`` twice: source wins per name, transparent values never count, the computed primary fills a missing accent."""
    clean = lambda df: dedupe_first(df.filter(~F.col("value").rlike(TRANSPARENT)), ["site", "name"], ["value"])
    s, c = clean(source).withColumnRenamed("value", "sv"), clean(computed).withColumnRenamed("value", "cv")
    both = s.join(c, ["site", "name"], "full_outer").select("site", "name", F.coalesce("sv", "cv").alias("value"), F.when(F.col("sv").isNotNull(), "source").otherwise("computed").alias("winner"))
    accents = both.filter("name = 'accent'").select("site")
    filled = both.filter("name = 'primary' AND winner = 'computed'").join(accents, "site", "left_anti").select("site", F.lit("accent").alias("name"), "value", F.lit("computed").alias("winner"))
    return both.unionByName(filled)


def token_comparison(source: DataFrame, computed: DataFrame, merged: DataFrame) -> DataFrame:
    """Source, computed and winning value per name, with whether the two agree."""
    s, c = source.groupBy("site", "name").agg(F.min("value").alias("source")), computed.groupBy("site", "name").agg(F.min("value").alias("computed"))
    both = s.join(c, ["site", "name"], "full_outer").join(merged.select("site", "name", F.col("value").alias("winner")), ["site", "name"], "full_outer")
    state = F.when(F.col("source").isNull(), "computed only").when(F.col("computed").isNull(), "source only").when(F.lower("source") == F.lower("computed"), "agree").otherwise("differ")
    return both.withColumn("state", state)


def export_tokens(tokens: DataFrame, fmt: str = "css") -> DataFrame:
    """One token row per output line, ordered: ``(site, ord, line)``; write with ``write.text`` per site.

    Lines stay rows instead of one string per site, so a site of any size streams to its file.
    """
    if fmt == "css":
        line = F.concat(F.lit("  "), "name", F.lit(": "), "value", F.lit(";"))
        first, last = ":root {", "}"
    elif fmt == "json":
        line = F.to_json(F.struct("name", F.struct(F.col("value").alias("$value"), F.col("type").alias("$type"), F.struct("uses").alias("$extensions")).alias("token")))
        first, last = None, None
    else:
        raise ValueError(f"unknown token format: {fmt}")
    rows = tokens.select("site", F.lit(1).alias("part"), "name", line.alias("line"))
    if first:
        sites = tokens.select("site").distinct()
        for part, text in ((0, first), (2, last)):
            rows = rows.unionByName(sites.select("site", F.lit(part).alias("part"), F.lit("").alias("name"), F.lit(text).alias("line")))
    return rows


def write_tokens(lines: DataFrame, path: str) -> None:
    """Sorted text files, one folder per site; a site may span several files in order."""
    lines.repartitionByRange("site", "part", "name").sortWithinPartitions("site", "part", "name").select("site", "line").write.partitionBy("site").mode("overwrite").text(path)
