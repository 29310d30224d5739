"""Source divergence audit: single-pass in-memory indexing to term counts, then exact divergences by streamed pair corrections."""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left
from collections import Counter
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from quiltlens.llm.rows import partitions
from quiltlens.session import materialize

UNIT = 1_000_000_000  # a probability of one
LEAST_DOCS = 3
TOP_TERMS = 200
BLOCK_POSTINGS = 400_000  # a block spills at so many postings,
BLOCK_BYTES = 32_000_000  # or at so many bytes of terms
CHUNK = 4_096  # postings of a run that travel as one row
TOGETHER = 32  # chunks that are opened before what they close is folded
WINDOW = 1_000_000  # bytes of a text read at once
PAIRS = 500_000  # pair corrections computed at once
CELLS = 1_000_000  # sums of pairs held by a task before it hands them on
GROUP = ""  # the term under which a group is recorded, so that groups without terms are known; no term is empty

_READS_AS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))  # A-Z as a-z, what is in no term as a space
_RUN = "shard int, lang string, low binary, terms array<binary>, sources array<string>, counts array<long>, docs array<long>"


def windows(text: bytes):
    """The letters of a text in pieces of about ``WINDOW`` bytes, never cut inside a term; all else reads as spaces."""
    text = text.translate(_READS_AS)
    start = 0
    while len(text) - start > WINDOW:
        end = text.find(b" ", start + WINDOW)
        end = len(text) if end < 0 else end
        yield text[start:end]
        start = end
    yield text[start:]


class Block:
    """Postings of some documents: occurrences and documents of each term, per lang and source."""

    def __init__(self):
        self.counts: dict[tuple[str, str], Counter] = {}
        self.docs: dict[tuple[str, str], Counter] = {}
        self.size = self.held = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        counts = self.counts.get((lang, source))
        if counts is None:
            counts, self.docs[lang, source] = self.counts.setdefault((lang, source), Counter()), Counter()
            counts[GROUP.encode()] = 0
        before, seen = len(counts), set()
        for piece in windows(text):
            terms = piece.split()
            counts.update(terms)
            seen.update(terms)
        self.docs[lang, source].update(seen)
        new = len(counts) - before
        self.size += new
        self.held += min(len(text), sum(map(len, seen))) if new else 0

    @property
    def full(self) -> bool:
        return self.size >= BLOCK_POSTINGS or self.held >= BLOCK_BYTES

    def run(self, shards: int) -> pa.Table:
        """All postings, sorted by hash shard, lang, term and source."""
        parts = []
        for (lang, source), counts in self.counts.items():
            terms, docs = list(counts), self.docs[lang, source]
            shard = (np.fromiter(map(zlib.crc32, terms), dtype=np.uint32, count=len(terms)) ^ np.uint32(zlib.crc32(lang.encode()))) % shards
            parts.append(pa.table({
                "shard": pa.array(shard.astype(np.int32)), "lang": pa.repeat(pa.scalar(lang, pa.string()), len(terms)), "terms": pa.array(terms, pa.binary()),
                "sources": pa.repeat(pa.scalar(source, pa.string()), len(terms)), "counts": pa.array(list(counts.values()), pa.int64()),
                "docs": pa.array([docs[t] for t in terms], pa.int64())}))
        if not parts:
            return pa.table({})
        table = pa.concat_tables(parts)
        return table.take(pc.sort_indices(table, [(c, "ascending") for c in ("shard", "lang", "terms", "sources")])).combine_chunks()


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before; the first does."""
    return np.append(True, pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)) if len(column) else np.zeros(0, dtype=bool)


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _spilled(run: pa.Table):
    """A run as rows, one per chunk: the shard, the lang, the first term and the postings."""
    if not run.num_rows:
        return
    cols = {c: _one(run.column(c)) for c in run.column_names}
    edges = np.flatnonzero(_changes(cols["shard"]) | _changes(cols["lang"]))
    ends = np.append(edges[1:], run.num_rows)
    starts = np.concatenate([np.arange(a, b, CHUNK) for a, b in zip(edges, ends)])
    for i in range(0, len(starts), 64):
        own = starts[i:i + 64]
        end = starts[i + 64] if i + 64 < len(starts) else run.num_rows
        offsets = pa.array(np.append(own, end) - own[0], pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, cols[c][int(own[0]):int(end)]) for c in ("terms", "sources", "counts", "docs")]
        at = pa.array(own)
        yield pa.RecordBatch.from_arrays([cols["shard"].take(at), cols["lang"].take(at), cols["terms"].take(at), *lists], names=["shard", "lang", "low", "terms", "sources", "counts", "docs"])


def _index(docs: DataFrame, shards: int) -> DataFrame:
    """Sorted runs of all blocks: each task indexes its documents one by one and spills a block whenever it is full."""

    def build(batches):
        block = Block()
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("body")):
                block.add(lang, source, text.as_py())
                if block.full:
                    yield from _spilled(block.run(shards))
                    block = Block()
        yield from _spilled(block.run(shards))

    return docs.mapInArrow(build, _RUN)


def _fold(lang: str, closed: list[pa.Table], least_docs: int) -> pa.RecordBatch:
    """Sums of postings that are all there are of their terms, for the terms of enough documents."""
    t = pa.concat_tables(closed).combine_chunks()
    t = t.take(pc.sort_indices(t, [("terms", "ascending"), ("sources", "ascending")])).combine_chunks()
    terms, sources = _one(t.column("terms")), _one(t.column("sources"))
    n, docs = (t.column(c).to_numpy() for c in ("counts", "docs"))
    of_term = np.flatnonzero(_changes(terms))
    each = _changes(sources)
    each[of_term] = True
    each = np.flatnonzero(each)
    term_of = np.searchsorted(of_term, each, side="right") - 1
    kept = (np.add.reduceat(docs, of_term) >= least_docs) | (pc.binary_length(terms.take(pa.array(of_term))).to_numpy(zero_copy_only=False) == 0)
    first = np.append(True, term_of[1:] != term_of[:-1])
    all_n, n = np.add.reduceat(n, of_term)[term_of], np.add.reduceat(n, each)
    at = np.flatnonzero(kept[term_of])
    return pa.RecordBatch.from_arrays(
        [pa.repeat(pa.scalar(lang, pa.string()), len(at)), terms.take(pa.array(each[at])).cast(pa.string()), sources.take(pa.array(each[at])), pa.array(n[at]), pa.array(all_n[at]), pa.array(first[at])],
        names=["lang", "term", "source", "n", "all_n", "first"])


def merge(chunks, least_docs: int):
    """Heap-merge of one shard's runs into frequencies.

    ``chunks`` are ``(lang, first term, table)``, each sorted by term, in the order of lang and first term. Postings below
    the first one of the chunk that came last can't be added to any more: they are cut off the open chunks, smallest
    first, and folded. So only chunks that overlap are open at a time, at most one a run and a few more.
    """
    heap: list = []

    def fold_below(limit):
        closed: dict[str, list[pa.Table]] = {}
        while heap and (limit is None or heap[0][:2] < limit):
            lang, _, number, table = heap[0]
            terms = _one(table.column("terms"))
            cut = table.num_rows if limit is None or lang < limit[0] else bisect_left(range(len(terms)), limit[1], key=lambda i: terms[i].as_py())
            closed.setdefault(lang, []).append(table.slice(0, cut))
            if cut < table.num_rows:
                heapq.heapreplace(heap, (lang, terms[cut].as_py(), number, table.slice(cut)))
            else:
                heapq.heappop(heap)
        for lang, tables in closed.items():
            yield _fold(lang, tables, least_docs)

    number = 0
    for lang, low, table in chunks:
        if number % TOGETHER == 0:
            yield from fold_below((lang, low))
        heapq.heappush(heap, (lang, low, number, table))
        number += 1
    yield from fold_below(None)


def frequencies(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``lang, term, source, n, all_n, first`` from ``docs(lang, source, body)``: occurrences of every kept term in each
    source that has it, and in the whole lang.

    A term is kept in a lang if at least ``least_docs`` of the lang's documents have it. ``first`` marks one row per
    kept term. Every (lang, source) that occurs has a row with the empty term.
    """
    shards = partitions(docs.sparkSession)
    runs = _index(docs, shards).repartition(shards, "shard").sortWithinPartitions("shard", "lang", "low")

    def frequent(batches):
        def chunks():
            for batch in batches:
                lists = [batch.column(c) for c in ("terms", "sources", "counts", "docs")]
                for i, (shard, lang, low) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("shard", "lang", "low")))):
                    yield shard, (lang, low, pa.table([x[i].values for x in lists], names=["terms", "sources", "counts", "docs"]))

        for _, own in groupby(chunks(), key=itemgetter(0)):  # a task may get several shards, one after the other
            yield from merge(map(itemgetter(1), own), least_docs)

    return runs.mapInArrow(frequent, "lang string, term string, source string, n long, all_n long, first boolean")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + kept)), by long division in base 1,000: count + 1 is never above total + kept."""
    below, rest, out = total + kept, count + 1, F.lit(1).cast("long")
    for step in (1_000_000, 1_000, 1):
        out = out + F.call_function("div", rest * 1_000, below) * step
        rest = (rest * 1_000) % below
    return out


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); p and q are from 1 to a little over UNIT, so the square fits into 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _shared_terms(kept: DataFrame) -> DataFrame:
    """``lang, source, item, both``: what terms that both sources have add to a pair beyond their one-sided parts.

    Terms stream through each task; corrections are added up per pair and handed on when there are many.
    """
    n = partitions(kept.sparkSession)
    rows = kept.select("lang", "term", "source", "p", "p0").repartition(n, "lang", "term").sortWithinPartitions("lang", "term")

    def correct(batches):
        names: dict[tuple[str, str], int] = {}  # the groups this task has met
        held: list[tuple[np.ndarray, np.ndarray]] = []
        cells = 0
        for group, run, p, p0 in _whole_terms(batches, names):
            for pair, value in _corrections(group, run, p, p0):
                held.append((pair, value))
                cells += len(pair)
                if cells >= CELLS:
                    held = [_summed(held)]
                    if (cells := len(held[0][0])) >= CELLS // 2:
                        yield _handed(held[0], names)
                        held, cells = [], 0
        if held:
            yield _handed(_summed(held), names)

    return rows.mapInArrow(correct, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("both"))


def _whole_terms(batches, names: dict):
    """Numbers of the groups, begins of the terms, p and p0 of rows in which no term is cut off."""
    left = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([left, t]).combine_chunks() if left is not None else t
        new = np.flatnonzero(_changes(_one(t.column("lang"))) | _changes(_one(t.column("term"))))
        if not len(new):
            continue
        left, t = t.slice(new[-1]), t.slice(0, new[-1])
        if t.num_rows:
            yield _numbered(t, new[:-1], names)
    if left is not None:
        yield _numbered(left, np.zeros(1, dtype=np.int64), names)


def _numbered(t: pa.Table, new: np.ndarray, names: dict):
    group = np.fromiter((names.setdefault(k, len(names)) for k in zip(t.column("lang").to_pylist(), t.column("source").to_pylist())), dtype=np.int64, count=t.num_rows)
    return group, new, t.column("p").to_numpy(), t.column("p0").to_numpy()


def _corrections(group: np.ndarray, new: np.ndarray, p: np.ndarray, p0: np.ndarray):
    """``(pair, value)`` of the ordered pairs of rows of a term, some hundred thousand at a time."""
    sizes = np.diff(np.append(new, len(group)))
    first, partners = np.repeat(new, sizes), np.repeat(sizes, sizes)
    ends = np.cumsum(partners)
    a = 0
    while a < len(group):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, side="right")))
        many = partners[a:b]
        x = np.repeat(np.arange(a, b), many)
        y = np.repeat(first[a:b], many) + np.arange(len(x)) - np.repeat(np.cumsum(many) - many, many)
        x, y = x[x != y], y[x != y]
        yield (group[x] << 32) | group[y], _gap(p[x], p[y]) - _gap(p[x], p0[y]) - _gap(p0[x], p[y]) + _gap(p0[x], p0[y])
        a = b


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pair, value = (np.concatenate(c) for c in zip(*held))
    order = np.argsort(pair, kind="stable")
    pair, value = pair[order], value[order]
    new = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, dtype=np.int64)
    return pair[new], np.add.reduceat(value, new) if len(new) else value


def _handed(sums: tuple[np.ndarray, np.ndarray], names: dict) -> pa.RecordBatch:
    known, (pair, value) = list(names), sums
    own, other = [known[i] for i in pair >> 32], [known[i] for i in pair & 0xFFFFFFFF]
    return pa.RecordBatch.from_arrays([pa.array([g[0] for g in own], pa.string()), pa.array([g[1] for g in own], pa.string()), pa.array([g[1] for g in other], pa.string()), pa.array(value)],
                                      names=["lang", "source", "item", "value"])


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source of a lang is from every other one, and by which terms from the lang.

    Null text, lang and source count as ''. Terms are runs of ASCII letters and non-ASCII characters with A-Z lower-cased;
    a lang keeps the terms of at least ``least_docs`` of its documents. With V kept terms a group that has N of their
    occurrences gives each p = 1 + floor(10^9 (count + 1) / (N + V)). Part ``pair``: value is the sum of
    floor((p - q)^2 / q) over all kept terms, q from the other source. Part ``term``: the group's terms with p above the
    lang's q, the ``top_terms`` largest values. Ranks count from 1 per group and part, ties by item. A group without terms
    has its pairs, too; a lang with one source has none; a lang without kept terms has values of 0; no documents give no
    rows. Rows that repeat are documents of their own; other columns are ignored.

    Pairs are never computed term by term over all sources. Four parts make up the sum: the pair's value for terms that
    neither has, times V; for each of the two sources its terms against the other's value for absent terms, from the
    table of how many terms have which p; and a correction for terms that both have, streamed term by term.
    Documents are read once and never shuffled: only block postings are.
    """
    named = [F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]
    body = F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary").alias("body")
    found = materialize(frequencies(docs.select(*named, body), least_docs), "term-frequencies")
    of_terms = found.filter(F.col("term") != GROUP)
    sums = of_terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = of_terms.filter("first").groupBy("lang").agg(F.sum("all_n").alias("all_total"), F.count("*").alias("kept"))
    zero = F.lit(0).cast("long")
    groups = found.filter(F.col("term") == GROUP).select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "all_total", "kept")])
    groups = materialize(groups.withColumn("p0", F.when(F.col("kept") > 0, share(zero, F.col("total"), F.col("kept"))).otherwise(F.lit(1).cast("long"))), "term-groups")
    kept = of_terms.drop("first").join(groups, ["lang", "source"])
    kept = materialize(kept.withColumns({"p": share(F.col("n"), F.col("total"), F.col("kept")), "q": share(F.col("all_n"), F.col("all_total"), F.col("kept"))}), "term-shares")

    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    steps = kept.groupBy("lang", "source", "p").agg(F.count("*").alias("n"), F.first("p0").alias("p0"))  # all terms of one count, however many, are one row
    against = steps.join(other, "lang").filter("source <> item").withColumns({
        "mine": F.col("n") * (gap(F.col("p"), F.col("q0")) - gap(F.col("p0"), F.col("q0"))), "theirs": F.col("n") * (gap(F.col("q0"), F.col("p")) - gap(F.col("q0"), F.col("p0")))})
    one_sided = materialize(against.groupBy("lang", "source", "item").agg(F.sum("mine").alias("mine"), F.sum("theirs").alias("theirs")), "one-sided")
    turned = one_sided.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "theirs")
    keys = ["lang", "source", "item"]
    pairs = groups.join(other, "lang").filter("source <> item").withColumn("value", F.col("kept") * gap(F.col("p0"), F.col("q0")))
    pairs = pairs.join(one_sided.drop("theirs"), keys, "left").join(turned, keys, "left").join(_shared_terms(kept), keys, "left")
    pairs = pairs.select(*keys, F.lit("pair").alias("part"), F.expr("value + coalesce(mine, 0) + coalesce(theirs, 0) + coalesce(both, 0)").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    terms = kept.filter("p > q").select("lang", "source", F.col("term").alias("item"), F.lit("term").alias("part"), gap(F.col("p"), F.col("q")).alias("value"))
    best = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms)
    return ranked.unionByName(best).select("lang", "source", "part", "item", "value", "rank")
