"""MinHash near-dedup with an LSH forest: sorted signature orders, longest-common-prefix neighbours, exact confirmation."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from quiltlens.llm.rows import only, partitions, slices, word_cache
from quiltlens.operators.graph import components
from quiltlens.session import materialize

WORDS = 5
TREES, DEPTH = 16, 3  # 48 hash functions; each tree starts its order at another of them
HASHES = TREES * DEPTH
LEAF = 256
SLACK = 0.20  # candidates may be this far below the threshold by signature: four standard errors of 48 hashes
CACHE = 400_000

_rng = np.random.default_rng(20230711)
_ODD = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_WORDS = word_cache(_Words())


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


def shingle_sets(texts: list[bytes], k: int = WORDS) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit prints of its ``k``-word shingles, after lower-casing A-Z.

    Words are runs of bytes other than space and \\t to \\r. A text of 1 to k - 1 words has one shingle, all its words;
    a text without words has none.
    """
    only(_WORDS)
    words = [t.lower().split() for t in texts]  # bytes: only A-Z change, only ASCII white space splits
    counts = np.array([len(w) for w in words], dtype=np.int64)
    total = int(counts.sum())
    flat = np.fromiter((h for w in words for h in map(_WORDS.__getitem__, w)), dtype=np.uint64, count=total)
    rolled = np.zeros(max(0, total - k + 1), dtype=np.uint64)
    for j in range(k):
        rolled = rolled * _STEP + flat[j:total - k + 1 + j]
    rolled = _stir(rolled)
    out, start = [], 0
    for n in counts:
        if n >= k:
            out.append(np.unique(rolled[start:start + n - k + 1]))
        elif n:
            h = np.zeros(1, dtype=np.uint64)
            for w in flat[start:start + n]:
                h = h * _STEP + w
            out.append(_stir(h + np.uint64(n)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        start += n
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """``len(sets) x HASHES`` minima (32 bits); rows of empty sets are all ones."""
    sig = np.full((len(sets), HASHES), 0xFFFFFFFF, dtype=np.uint32)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    full = sizes > 0
    if full.any():
        flat = np.concatenate(sets)
        starts = (np.cumsum(sizes) - sizes)[full]
        for j in range(HASHES):
            sig[full, j] = np.minimum.reduceat(((flat * _ODD[j] + _ADD[j]) >> np.uint64(32)).astype(np.uint32), starts)
    return sig


def _describe(base: DataFrame, k: int) -> DataFrame:
    """``id, mark, n, print, sig``: one row per document; ``print`` is the 128-bit digest of its whole set."""

    def describe(batches):
        for batch in batches:
            texts = [t or b"" for t in batch["body"]]
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b], k)
                yield pd.DataFrame({
                    "id": batch["id"].iloc[a:b], "mark": batch["mark"].iloc[a:b], "n": [len(s) for s in sets],
                    "print": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                    "sig": [r.astype(">u4").tobytes() for r in signatures(sets)]})

    kind = base.schema["id"].dataType.simpleString()
    return base.mapInPandas(describe, f"id {kind}, mark long, n long, print binary, sig binary")


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def _neighbours(sig: np.ndarray, tree: np.ndarray, size: np.ndarray, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Adjacent rows of a sorted order whose common prefix has ``DEPTH`` hashes and whose signatures agree well enough."""
    if len(sig) < 2:
        return []
    ok = (tree[:-1] == tree[1:]) & (sig[:-1, :DEPTH] == sig[1:, :DEPTH]).all(axis=1) & (_alike(sig[:-1], sig[1:]) >= threshold - SLACK)
    ok &= np.minimum(size[:-1], size[1:]) >= threshold * np.maximum(size[:-1], size[1:])
    at = np.flatnonzero(ok)
    return [(at, at + 1)]


def _leaves(sig: np.ndarray, tree: np.ndarray, lo: int, hi: int, depth: int):
    """Regions of rows ``lo:hi``, each going deeper until it has at most ``LEAF`` rows or its signatures are all equal."""
    stack = [(lo, hi, depth)]
    while stack:
        lo, hi, depth = stack.pop()
        if hi - lo < 2:
            continue
        if hi - lo <= LEAF or depth >= HASHES:
            yield lo, hi
            continue
        cuts = lo + 1 + np.flatnonzero(sig[lo:hi - 1, depth] != sig[lo + 1:hi, depth])
        edges = [lo, *cuts.tolist(), hi]
        stack += [(a, b, depth + 1) for a, b in zip(edges[:-1], edges[1:])]


def _region_pairs(sig: np.ndarray, tree: np.ndarray, size: np.ndarray, comp: np.ndarray, threshold: float):
    """Pairs with the row of a leaf region that is most like all others, and of rows next to each other: few for each row.

    Only pairs in different components so far, whose signatures agree well enough.
    A leaf of more than ``LEAF`` equal signatures is walked in blocks that meet the block after them.
    """
    if len(sig) < 2:
        return
    new = (tree[:-1] != tree[1:]) | (sig[:-1, :DEPTH] != sig[1:, :DEPTH]).any(axis=1)
    edges = [0, *(1 + np.flatnonzero(new)).tolist(), len(sig)]
    for lo, hi in zip(edges[:-1], edges[1:]):
        for a, b in _leaves(sig, tree, lo, hi, DEPTH):
            if (comp[a:b] == comp[a]).all():
                continue
            for s in range(a, b, LEAF):
                first, both = slice(s, min(s + LEAF, b)), slice(s, min(s + 2 * LEAF, b))
                same = np.zeros((first.stop - s, both.stop - s), dtype=np.uint8)
                for j in range(HASHES):
                    same += sig[first, j, None] == sig[None, both, j]
                ok = (same >= HASHES * (threshold - SLACK)) & (comp[first, None] != comp[None, both])
                ok &= np.minimum(size[first, None], size[None, both]) >= threshold * np.maximum(size[first, None], size[None, both])
                hub = int(same.sum(axis=1, dtype=np.int64).argmax())
                few = np.eye(*ok.shape, k=1, dtype=bool)
                few[hub] = few[:, hub] = True
                i, j = np.nonzero(np.triu(ok & few, 1))
                yield i + s, j + s


def _candidates(crowded: DataFrame, comp: DataFrame | None, threshold: float, trees: int) -> DataFrame:
    """Pairs ``u < v`` of rows near each other in the first ``trees`` orders; with ``comp``, only across its components."""
    rows = crowded.filter(F.col("tree") < trees)
    rows = rows.join(comp, "uid", "left").withColumn("comp", F.coalesce("comp", "uid")) if comp is not None else rows.withColumn("comp", F.col("uid"))
    n = partitions(crowded.sparkSession)
    keyed = rows.withColumn("lead", F.substring("key", 1, 32)).repartitionByRange(n, "tree", "lead").sortWithinPartitions("tree", "key", "uid")
    regions = comp is not None

    def scan(batches):
        frames = list(batches)  # one range of the order: signatures of 192 bytes, no texts or sets
        if not frames:
            return
        rows = pd.concat(frames)
        uid, tree, size, own = (rows[c].to_numpy() for c in ("uid", "tree", "n", "comp"))
        sig = np.frombuffer(b"".join(rows["key"]), dtype=">u4").astype(np.uint32).reshape(-1, HASHES)
        for i, j in _region_pairs(sig, tree, size, own, threshold) if regions else _neighbours(sig, tree, size, threshold):
            if len(i):
                yield pd.DataFrame({"u": np.minimum(uid[i], uid[j]), "v": np.maximum(uid[i], uid[j])})

    return keyed.select("uid", "tree", "n", "comp", "key").mapInPandas(scan, "u long, v long").filter("u <> v").distinct()


def _rest(sets: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Every pair ``u, v`` of classes in different components whose sets may have 100 * intersection >= percent * union.

    The shingles of a set are ordered rarest first. Two sets that alike share one of their first n - ceil(percent * n / 100) + 1,
    and after the first one they share, enough must be left in both for the whole intersection. Shingles that only one
    set has, or whose sets are in one component, lead to no pair; so members of a large group that differ from each other
    by shingles of their own meet nobody.
    """

    def unpack(batches):
        for batch in batches:
            held = [np.frombuffer(b, dtype=np.int64) for b in batch["body"]]
            sizes = np.array([len(h) for h in held], dtype=np.int64)
            for a, b in slices(batch["body"].tolist(), 4_000_000):
                yield pd.DataFrame({"uid": np.repeat(batch["uid"].to_numpy()[a:b], sizes[a:b]), "n": np.repeat(sizes[a:b], sizes[a:b]), "item": np.concatenate(held[a:b])})

    items = sets.mapInPandas(unpack, "uid long, n long, item long")
    common = items.groupBy("item").agg(F.count("*").alias("df")).filter("df > 1")
    shared = items.join(common, "item").groupBy("uid", "n").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("items"))  # of one set
    own = F.col("n") - F.size("items")  # shingles of this set alone come first
    length = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1 - own
    heads = shared.filter(length > 0).select("uid", "n", own.alias("own"), F.posexplode(F.slice("items", F.lit(1), length.cast("int"))).alias("at", "head"))
    heads = heads.join(comp, "uid", "left").select(
        F.col("head.item").alias("item"), "uid", F.coalesce("comp", "uid").alias("comp"), "n", (F.col("n") - F.col("own") - F.col("at")).alias("left"))
    heads = materialize(heads, "heads")
    several = heads.groupBy("item").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("item")
    heads = heads.join(several, "item", "left_semi")
    x, y = heads.select("item", *[F.col(c).alias(f"{c}_x") for c in ("uid", "comp", "n", "left")]), heads.select("item", *[F.col(c).alias(f"{c}_y") for c in ("uid", "comp", "n", "left")])
    enough = (F.least("left_x", "left_y") * (100 + percent) >= percent * (F.col("n_x") + F.col("n_y")))
    met = x.join(y, (x["item"] == y["item"]) & (F.col("comp_x") < F.col("comp_y")) & enough)
    return met.select(F.least("uid_x", "uid_y").alias("u"), F.greatest("uid_x", "uid_y").alias("v")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets have 100 * intersection >= percent * union."""

    def meet(batches):
        for batch in batches:
            ok = np.zeros(len(batch), dtype=bool)
            for r, (x, y) in enumerate(zip(batch["a"], batch["b"])):
                a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok[r] = 100 * both >= percent * (len(a) + len(b) - both)
            yield batch.loc[ok, ["u", "v"]]

    with_a = pairs.join(sets.select(F.col("uid").alias("u"), F.col("body").alias("a")), "u")
    with_b = with_a.join(sets.select(F.col("uid").alias("v"), F.col("body").alias("b")), "v")
    return with_b.select("u", "v", "a", "b").mapInPandas(meet, "u long, v long")


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col, n_shingles, component_id, kept, text_mark`` (a 64-bit hash of the text).

    Documents with equal shingle sets are one class and linked. Classes meet as longest-common-prefix neighbours in 16
    sorted orders of their 48 minima; a region of one order that holds more than 256 classes goes one hash deeper, as
    often as it needs. First, neighbours in two orders are confirmed on the full sets and joined to components; then
    all 16 orders give neighbours and the pairs with each region's most central class. Both leave out pairs: those that a
    deeper cut parts, and most of a region. So last the classes that share any region are closed across components by
    their rarest shingles, with no limit on a region. A large group of near copies costs a few pairs a member. What is
    lost is a pair one of whose classes shares no region of three hashes with any class; at the threshold of 0.85 that
    has probability (1 - 0.85^3)^16 < 1e-6, at 0.8 1e-5. Links are exact: 100 * intersection >= percent * union.

    ``component_id`` is the smallest id reachable; null ids never name a component that has another; kept says
    that the id is the component's. Empty or null texts have no shingles and stay alone. Other columns are ignored.
    """
    base = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").cast("binary").alias("body")).withColumn("mark", F.xxhash64("body"))
    described = materialize(_describe(base, k), "minhash")
    classes = described.filter("n > 0").groupBy("print").agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "mark")).alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("uid"), "print", "rep.id", "rep.mark", "n", "sig"), "classes")
    crowded = _crowded(classes)
    if crowded.isEmpty():
        comp = classes.select("uid", F.col("uid").alias("comp")).limit(0)
    else:
        sets = _sets(base, classes.join(crowded.select("uid").distinct(), "uid", "left_semi"), k)
        links = _confirmed(_candidates(crowded, None, percent / 100, 2), sets, percent)
        comp = _components(links)
        for last in (False, True):
            more = _rest(sets, comp, percent) if last else _candidates(crowded, comp, percent / 100, TREES)
            comp = _components(comp.select(F.col("comp").alias("u"), F.col("uid").alias("v")).unionByName(_confirmed(more, sets, percent)))
    lowest = classes.join(comp, "uid", "inner")
    lowest = lowest.join(lowest.groupBy("comp").agg(F.min("id").alias("component_id")), "comp").select("print", "component_id")
    own = described.filter("n > 0").groupBy("print").agg(F.min("id").alias("own_id"))
    named = own.join(lowest, "print", "left").select("print", F.coalesce("component_id", "own_id").alias("component_id"))
    full = described.filter("n > 0").select("id", "mark", "n", "print").join(named, "print").select("id", "mark", "n", "component_id")
    every = full.unionByName(described.filter("n = 0").select("id", "mark", "n", F.col("id").alias("component_id")))
    return every.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
                        F.col("mark").alias("text_mark"))


def keep_one(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate group (0.8 or more); rows that repeat id and text count as one."""
    found = materialize(near_duplicates(docs, percent, id_col=id_col, text_col=text_col), "near")
    gone = found.filter(~F.col("kept")).select(F.col(id_col).alias("_id"), F.col("text_mark").alias("_mark")).distinct()
    marked = docs.withColumn("_own_mark", F.xxhash64(F.col(text_col).cast("string").cast("binary")))
    left = marked.join(gone, marked[id_col].eqNullSafe(gone["_id"]) & (marked["_own_mark"] == gone["_mark"]), "left_anti")
    if not found.groupBy(id_col, "text_mark").count().filter("count > 1").isEmpty():
        left = left.dropDuplicates([id_col, "_own_mark"])
    return left.drop("_own_mark")


def _crowded(classes: DataFrame) -> DataFrame:
    """``uid, tree, n, key``: the classes that share a region of ``DEPTH`` hashes in a tree; key is the tree's order of the signature."""
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    spots = classes.select("uid", "sig", trees).select("uid", "tree", F.expr(f"substring(sig, tree * {4 * DEPTH} + 1, {4 * DEPTH})").alias("region"))
    shared = spots.groupBy("tree", "region").agg(F.count("*").alias("c")).filter("c > 1").select("tree", "region")
    mine = spots.join(shared, ["tree", "region"], "left_semi").groupBy("uid").agg(F.collect_list("tree").alias("trees"))  # 16 at most
    rows = mine.join(classes.select("uid", "n", "sig"), "uid").select("uid", "n", "sig", F.explode("trees").alias("tree"))
    key = F.expr(f"concat(substring(sig, tree * {4 * DEPTH} + 1), substring(sig, 1, tree * {4 * DEPTH}))")
    return materialize(rows.select("uid", "tree", "n", key.alias("key")), "crowded")


def _sets(base: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``uid, body``: the whole shingle set of each wanted class, from the text of its first document."""

    def sets(batches):
        for batch in batches:
            texts = list(batch["body"])
            for a, b in slices(texts):
                yield pd.DataFrame({"uid": batch["uid"].iloc[a:b], "body": [s.tobytes() for s in shingle_sets(texts[a:b], k)]})

    w = wanted.select("uid", F.col("id").alias("rep_id"), F.col("mark").alias("rep_mark"))
    found = base.join(w, (base["mark"] == w["rep_mark"]) & base["id"].eqNullSafe(w["rep_id"])).select("uid", "body")
    return materialize(found.mapInPandas(sets, "uid long, body binary").dropDuplicates(["uid"]), "sets")


def _components(links: DataFrame) -> DataFrame:
    return materialize(components(materialize(links, "links")).select(F.col("node").alias("uid"), F.col("root").alias("comp")), "near-components")
