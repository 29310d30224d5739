"""Substring dedup: an FM-index per shard, matching statistics by backward search over a wavelet matrix."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quiltlens.llm.rows import partitions, slices, word_prints
from quiltlens.session import materialize

WINDOW = 13  # words
SEED = 8  # words of the stretch that decides the shard of a window
KEY_BITS = 48  # keys that meet by chance only bring needless stretches, never other results
SHARD_WORDS = 1_000_000  # of distinct stretches that an index should hold
PART_BYTES = 12_000_000  # of texts whose stretches meet in a part
SEARCHED = 2_000_000  # words of pieces that are searched at once, with their padding
_STEP = np.uint64(0x9E3779B97F4A7C15)


def stretches(texts: list[bytes], window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(key, text, at, count)``: runs of windows of one text whose smallest seed is the same one, so that equal windows have equal keys."""
    codes, counts = word_prints(texts)
    n = len(codes) - window + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 4
    rolled = np.zeros(len(codes) - seed + 1, dtype=np.uint64)
    for j in range(seed):
        rolled = rolled * _STEP + codes[j:len(codes) - seed + 1 + j]
    rolled = (rolled ^ (rolled >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    rolled ^= rolled >> np.uint64(29)
    rolled >>= np.uint64(64 - KEY_BITS)
    low = rolled[:n].copy()
    for j in range(1, window - seed + 1):
        np.minimum(low, rolled[j:n + j], out=low)
    text = np.repeat(np.arange(len(texts)), counts)
    inside = np.flatnonzero(text[:n] == text[window - 1:])  # windows that don't cross texts
    low, text = low[inside], text[inside]
    first = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (text[1:] != text[:-1]))) if len(inside) else inside
    at = inside[first] - (np.cumsum(counts) - counts)[text[first]]
    return low[first].view(np.int64), text[first], at, np.diff(np.append(first, len(inside)))


class WaveletMatrix:
    """Symbols of ``bits`` bits, one packed bit vector per level with counts every 64 bits."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.n, self.bits, self.levels = len(symbols), bits, []
        for level in range(bits - 1, -1, -1):
            ones = ((symbols >> level) & 1).astype(np.uint8)
            words = np.packbits(np.append(ones, np.zeros(-self.n % 64 + 64, np.uint8)), bitorder="little").view(np.uint64)
            ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
            self.levels.append((level, words, ranks, self.n - int(ones.sum())))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])

    @staticmethod
    def _ones(words: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        return ranks[block] + np.bitwise_count(words[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        lo, hi = np.zeros_like(at), at
        for level, words, ranks, zeros in self.levels:
            bit = ((symbol >> level) & 1).astype(bool)
            a, b = self._ones(words, ranks, lo), self._ones(words, ranks, hi)
            lo, hi = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, hi - b)
        return hi - lo


class FMIndex:
    """Over the concatenation of ``pieces`` (each with an owner number), sorted as far as searches go (16 symbols)."""

    def __init__(self, pieces: list[np.ndarray], owners: np.ndarray, window: int = WINDOW):
        self.window = window
        self.alphabet, flat = np.unique(np.concatenate(pieces), return_inverse=True)
        sizes = np.array([len(p) for p in pieces])
        ends = np.cumsum(sizes + 1) - 1
        text = np.zeros(int(ends[-1]) + 1, dtype=np.int64)  # 0 ends a piece
        inner = np.ones(len(text), dtype=bool)
        inner[ends] = False
        text[inner] = flat.reshape(-1) + 1
        n, shift = len(text), np.int64(len(text) + 1)
        rank = {1: text}
        for k in (1, 2, 4, 8):
            ahead = np.append(rank[k][k:], np.zeros(min(k, n), dtype=np.int64))[:n]
            rank[2 * k] = np.unique(rank[k] * shift + ahead, return_inverse=True)[1].reshape(-1).astype(np.int64) + 1
        order = np.argsort(rank[16], kind="stable")
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.alphabet) + 1))])
        self.bwt = WaveletMatrix(text[order - 1], max(1, int(len(self.alphabet)).bit_length()))
        later = lambda k, by: np.append(rank[k], np.zeros(32, dtype=np.int64))[order + by]
        eight, four, last = rank[8][order], later(4, 8), later(1, 12)
        new12 = np.append(True, (eight[1:] != eight[:-1]) | (four[1:] != four[:-1]))
        self.starts12 = np.flatnonzero(new12)
        self.group12 = np.cumsum(new12) - 1
        self.ends12 = np.append(self.starts12[1:], n)
        starts13 = np.flatnonzero(new12 | np.append(True, last[1:] != last[:-1]))
        self.group13 = np.zeros(n, dtype=np.int64)
        self.group13[starts13[1:]] = 1
        self.group13 = np.cumsum(self.group13)
        piece = np.searchsorted(ends, order)
        self.lowest = np.minimum.reduceat(owners[piece], starts13)

    def lowest_owners(self, pieces: list[np.ndarray]) -> list[np.ndarray]:
        """Per piece, for each of its windows the smallest owner of an indexed piece that holds it.

        Words are taken from the right; each one extends the match by a backward step, and a match of 12 words or more
        is first cut back to its leading 12, so a step per word gives the statistics of every window.
        """
        sizes = np.array([len(p) for p in pieces])
        order, out, a = np.argsort(sizes, kind="stable"), [None] * len(pieces), 0
        while a < len(pieces):  # pieces of about the same length together
            b = a + 1
            while b < len(pieces) and (b + 1 - a) * sizes[order[b]] <= SEARCHED:
                b += 1
            for r, found in zip(order[a:b], self._search([pieces[r] for r in order[a:b]])):
                out[r] = found
            a = b
        return out

    def _search(self, pieces: list[np.ndarray]) -> list[np.ndarray]:
        sizes = np.array([len(p) for p in pieces])
        width = int(sizes.max())
        symbols = np.zeros((len(pieces), width), dtype=np.int64)
        symbols[np.arange(width) >= width - sizes[:, None]] = np.searchsorted(self.alphabet, np.concatenate(pieces)) + 1
        found = np.full((len(pieces), width), np.iinfo(np.int64).max)
        lo, hi = np.zeros(len(pieces), dtype=np.int64), np.full(len(pieces), self.bwt.n, dtype=np.int64)
        for step in range(1, width + 1):
            c = symbols[:, width - step]
            live = np.flatnonzero((c > 0) & (hi > lo))
            if step > self.window:  # the match has 13 words: keep the leading 12
                group = self.group12[lo[live]]
                lo[live], hi[live] = self.starts12[group], self.ends12[group]
            lo[live] = self.counts[c[live]] + self.bwt.rank(c[live], lo[live])
            hi[live] = self.counts[c[live]] + self.bwt.rank(c[live], hi[live])
            if step >= self.window:
                hit = live[hi[live] > lo[live]]
                found[hit, width - step] = self.lowest[self.group13[lo[hit]]]
        return [found[r, width - s:width - self.window + 1] for r, s in enumerate(sizes)]


def _shards(pieces: DataFrame) -> tuple[int, DataFrame]:
    """The number of shards, from the words of all stretches, and the keys whose distinct stretches have more than a quarter of a shard's words.

    These keys are fewer than four a shard; a shard holds about a million words whatever the input.
    """
    words = F.octet_length("words") / 8
    held = materialize(pieces.groupBy("key").agg(F.sum(words).alias("n")), "fm-sizes")
    total = held.agg(F.sum("n")).first()[0] or 0
    shards = max(2 * partitions(pieces.sparkSession), int(total / SHARD_WORDS) + 1)
    bound = max(total / shards, SHARD_WORDS / 16) / 4
    often = pieces.join(F.broadcast(held.filter(F.col("n") > bound).select("key")), "key")  # fewer than four a shard
    distinct = often.groupBy("key", "piece").agg(F.first(words).alias("n")).groupBy("key").agg(F.sum("n").alias("n"))
    return shards, materialize(distinct.filter(F.col("n") > bound).select("key"), "fm-hot")


def _in_shards(pieces: DataFrame, shards: int, hot: DataFrame) -> DataFrame:
    """``shard, words, id, uid, at, piece``: stretches by their key; those of a hot key window by window, each by its own words.

    Equal windows have equal words, so they meet in one shard either way: a seed in any number of contexts is spread.
    """
    marked = pieces.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "key", "left")
    whole = marked.filter("hot IS NULL").select(F.pmod("key", F.lit(shards)).alias("shard"), "words", "id", "uid", "at", "piece")
    windows = marked.filter("hot").select("words", "id", "uid", "at", F.explode(F.expr(f"sequence(0, octet_length(words) div 8 - {WINDOW})")).alias("by"))
    windows = windows.select(F.expr(f"substring(words, 8 * by + 1, {8 * WINDOW})").alias("words"), "id", "uid", (F.col("at") + F.col("by")).alias("at"))
    windows = windows.withColumn("piece", F.xxhash64("words")).select(F.pmod("piece", F.lit(shards)).alias("shard"), "words", "id", "uid", "at", "piece")
    return whole.unionByName(windows)


def _packed(values: np.ndarray) -> bytes:
    """Numbers from 0 on as byte planes, as many as the largest needs; alike bytes lie together, so shuffles compress them."""
    width = max(1, -(-int(values.max()).bit_length() // 8))
    return values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    planes = np.frombuffer(data, dtype=np.uint8).reshape(-1, n)
    out[:, :len(planes)] = planes.T
    return out.view("<i8").reshape(-1)


def _repeated(own: DataFrame) -> DataFrame:
    """``key, uid, at, n``: the stretches of ``own(uid, body)`` whose key another text has, too.

    Each batch deals its stretches to parts by key and sends a part as one row of packed numbers; the number of parts
    follows the bytes of all texts, so that a part has about a million stretches.
    """
    parts = max(partitions(own.sparkSession), int((own.agg(F.sum(F.octet_length("body"))).first()[0] or 0) / PART_BYTES) + 1)

    def deal(batches):
        for batch in batches:
            batch = batch.sort_values("uid")
            uids, bodies, found = batch["uid"].to_numpy(), list(batch["body"]), []
            for a, b in slices(bodies):
                key, text, at, n = stretches(bodies[a:b])
                found.append((key, uids[a:b][text], at, n))
            if not found:
                continue
            key, uid, at, n = (np.concatenate(x) for x in zip(*found))
            part = (key % parts).astype(np.uint16 if parts <= 1 << 16 else np.int64)
            order = np.argsort(part, kind="stable")
            key, uid, at, n = key[order], uid[order], at[order], n[order]
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            held = [(p, int(x), int(y)) for p, (x, y) in enumerate(zip(edges[:-1], edges[1:])) if y > x]
            yield pd.DataFrame([(p, y - x, int(uid[x]), *map(_packed, (np.diff(uid[x:y], prepend=uid[x]), key[x:y], at[x:y], n[x:y]))) for p, x, y in held],
                               columns=["part", "size", "first", "uids", "keys", "ats", "ns"])

    def meet(rows):
        cols = lambda name: np.concatenate([_unpacked(d, s) for d, s in zip(rows[name], rows["size"])])
        uid = np.concatenate([f + np.cumsum(_unpacked(d, s)) for f, d, s in zip(rows["first"], rows["uids"], rows["size"])])
        key = cols("keys")
        order = np.argsort(key, kind="stable")
        firsts = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        several = np.minimum.reduceat(uid[order], firsts) < np.maximum.reduceat(uid[order], firsts)
        kept = order[np.repeat(several, np.diff(np.append(firsts, len(order))))]
        return pd.DataFrame({"key": key[kept], "uid": uid[kept], "at": cols("ats")[kept], "n": cols("ns")[kept]})

    dealt = own.select("uid", "body").mapInPandas(deal, "part long, size long, first long, uids binary, keys binary, ats binary, ns binary")
    return dealt.groupBy("part").applyInPandas(meet, "key long, uid long, at int, n int")


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col, n_words, n_removed, kept_sha256, kept_text, spans`` (removed word ranges, end exclusive).

    Every word in a window of 13 words that also starts in a document with a smaller id goes; windows are judged on the
    input. Equal windows have the same smallest 8-word seed, which is their key: keys that only one text has are
    dropped; the stretches of the others go to the shard of their key, each distinct one once with its smallest id.
    The number of shards follows the words of stretches; a key with a large share of them is dealt window by window.
    A shard builds a compressed FM-index of its stretches and streams them through it by backward search. A passage
    with any number of copies is one stretch in its shard, so copies cost partial sums. Of equal texts only the one
    with the smallest id is indexed; the others are removed whole if they have 13 words.

    Null texts have no words. Rows with a null id remove nothing and lose nothing. Rows that share an id count as one
    document's texts: none removes words of another one. Other columns are ignored; an empty table gives an empty result.
    """
    if window != WINDOW:
        raise ValueError("the index is built for 13 words")
    spark = docs.sparkSession
    base = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary").alias("body")).withColumn("print", F.unhex(F.sha2("body", 256)))
    firsts = materialize(base.filter("id IS NOT NULL").groupBy("print").agg(F.min("id").alias("first")), "fm-texts")
    narrow = base.join(firsts.withColumnRenamed("first", "id"), ["print", "id"], "left_semi").dropDuplicates(["print", "id"]).select(F.monotonically_increasing_id().alias("uid"), "id", "print", "body")
    own = materialize(narrow, "fm-distinct")

    spots = _repeated(own)
    lists = spots.groupBy("uid").agg(F.collect_list(F.struct("at", "n", "key")).alias("spots"))  # of one text
    lists = lists.select("uid", "spots.at", "spots.n", "spots.key")

    def cut(batches):
        for batch in batches:
            ids, uids, bodies, ats, lengths, keys = (batch[c].to_numpy() for c in ("id", "uid", "body", "at", "n", "key"))
            for a, b in slices(list(bodies)):
                codes, counts = word_prints(list(bodies[a:b]))
                opens, sizes = np.cumsum(counts) - counts, [len(x) for x in ats[a:b]]
                text, at, n = np.repeat(np.arange(b - a), sizes), np.concatenate(ats[a:b]).astype(np.int64), np.concatenate(lengths[a:b])
                key, begin = np.concatenate(keys[a:b]), (opens[text] + at) * 8
                held = memoryview(codes.tobytes())
                words = [bytes(held[x:y]) for x, y in zip(begin.tolist(), (begin + 8 * (n + WINDOW - 1)).tolist())]
                digests = b"".join([hashlib.blake2b(w, digest_size=8).digest() for w in words])
                yield pd.DataFrame({"key": key, "words": words, "id": ids[a:b][text], "uid": uids[a:b][text], "at": at, "piece": np.frombuffer(digests, dtype=np.int64)})

    pieces = materialize(own.select("uid", "id", "body").join(lists, "uid").mapInPandas(cut, "key long, words binary, id long, uid long, at long, piece long"), "fm-pieces")
    shards, hot = _shards(pieces)
    pieces = _in_shards(pieces, shards, hot)

    def search(rows):
        stuff = [np.frombuffer(w, dtype=np.uint64) for w in rows["words"]]
        owners = rows["id"].to_numpy()
        index = FMIndex(stuff, owners)
        return pd.DataFrame({"shard": rows["shard"], "piece": rows["piece"], "owners": index.lowest_owners(stuff)})

    distinct = pieces.groupBy("shard", "piece", "words").agg(F.min("id").alias("id"))
    answers = distinct.groupBy("shard").applyInPandas(search, "shard long, piece long, owners array<long>")
    hits = pieces.select("shard", "piece", "id", "uid", "at").join(answers, ["shard", "piece"]).select("uid", "at", F.expr("transform(owners, o -> o < id)").alias("hit")).filter("array_contains(hit, true)")
    covers = materialize(hits.groupBy("uid").agg(F.collect_list(F.struct("at", "hit")).alias("covers")).select("uid", "covers.at", "covers.hit"), "fm-covers")  # of one text

    def strip(batches):
        for batch in batches:
            rows = []
            for i, text, first, ats, hits in zip(batch["id"], batch["body"], batch["first"], batch["at"], batch["hit"]):
                words = text.split()
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                if first == first and first is not None and i == i and i is not None and first < i and len(words) >= WINDOW:
                    gone[0], gone[-1] = 1, -1
                if ats is not None:
                    at = np.concatenate([x + np.flatnonzero(h) for x, h in zip(ats, hits)])
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + WINDOW, -1)
                off = np.cumsum(gone)[:-1] > 0
                kept = b" ".join([w for w, x in zip(words, off) if not x])
                edges = np.flatnonzero(np.diff(np.concatenate([[0], off.astype(np.int8), [0]])))
                rows.append((i, len(words), int(off.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace"), edges.reshape(-1, 2).tolist()))
            yield pd.DataFrame(rows, columns=[id_col, "n_words", "n_removed", "kept_sha256", "kept_text", "spans"])

    by_text = own.select("uid", "print", F.col("id").alias("first")).join(covers, "uid", "left").drop("uid")
    indexed = F.col("id") == F.col("first")  # rows of the text's smallest id; the others are copies
    all_rows = base.join(by_text, "print", "left").select("id", "body", "first", *[F.when(indexed, F.col(c)).alias(c) for c in ("at", "hit")])
    kind = docs.schema[id_col].dataType.simpleString()
    return all_rows.mapInPandas(
        strip, f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string, spans array<array<long>>")
